"""Queries of structure, consistency, numerals, names and the remaining corpus operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numerals as N
from ..functions import text as T
from ..operators import consistency as K
from ..operators import corpus as C
from ..operators import structure as S
from ..session import table
from .catalog import catalog
from .more_texts import contracts
from .search_plans import PARAS, paragraphs
from .views import documents, sql, words

query, QUERIES, SQL = catalog()


@query()
def txt_normalize(spark, sf):
    return S.normalized_blocks(documents(spark, sf)).select("id", "ordinal", "kind", "level", "char_offset", F.sha2("text", 256).alias("hash"))


@query()
def con_check(spark, sf):
    return K.check(documents(spark, sf)).select("id", "kind", "first", "variant")


@query(sql("""o AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, o_orderkey % 9 + 1 AS n FROM orders),
x AS (SELECT id, year(d) || '年' || month(d) || '月' || day(d) || '日' AS zh, strftime(d, '%Y-%m-%d') AS iso, n, substr('一二三四五六七八九', CAST(n AS INTEGER), 1) AS cn, year(d) AS y, month(d) AS m FROM o)
SELECT id, 'date' AS kind, zh AS first, iso AS variant FROM x WHERE id % 3 <> 0 UNION ALL SELECT id, 'number', n || '项', cn || '项' FROM x WHERE id % 2 = 0
UNION ALL SELECT id, 'date_order', y || '年' || m || '月至' || (y - 1) || '年' || m || '月', '' FROM x WHERE id % 5 = 0"""))
def con_contracts(spark, sf):
    """Contracts written from the orders: some name a date or a quantity in two ways or end before they begin."""
    return K.check(contracts(spark, sf)).select("id", "kind", "first", "variant")


@query(sql(PARAS + """, r AS (SELECT kind AS role, row_number() OVER (PARTITION BY kind ORDER BY id) AS nth, id AS reference_id, id % 3 AS l1 FROM paras WHERE doc_id % 2 = 0),
d AS (SELECT kind AS role, row_number() OVER (PARTITION BY kind ORDER BY id) AS nth, id AS draft_id, id % 3 AS l2 FROM paras WHERE doc_id % 2 = 1)
SELECT coalesce(r.role, d.role) AS role, CAST(coalesce(r.nth, d.nth) AS INTEGER) AS nth, CASE WHEN draft_id IS NULL THEN 'missing' WHEN reference_id IS NULL THEN 'extra' WHEN l1 <> l2 THEN 'level_mismatch' ELSE 'matched' END AS relation, reference_id, draft_id
FROM r FULL JOIN d ON r.role = d.role AND r.nth = d.nth"""))
def txt_align(spark, sf):
    p = paragraphs(spark, sf).select("id", "doc_id", F.col("kind").alias("role"), (F.col("id") % 3).alias("level"))
    return S.align(p.where("doc_id % 2 = 0"), p.where("doc_id % 2 = 1"))


@query(sql(PARAS + " SELECT id, CASE WHEN id % 3 = 0 THEN 'changed' WHEN doc_id % 7 = 0 THEN 'gone' ELSE 'same' END AS state FROM paras"))
def txt_reference_changed(spark, sf):
    p = paragraphs(spark, sf).withColumn("hash", F.sha2("content", 256))
    now = p.where("doc_id % 7 <> 0 or id % 3 = 0").select("id", F.when(F.col("id") % 3 == 0, "x").otherwise(F.col("hash")).alias("now"))
    j = p.select("id", "hash").join(now, "id", "left")
    return j.select("id", F.when(F.col("now").isNull(), "gone").when(F.col("now") != F.col("hash"), "changed").otherwise("same").alias("state"))


@query(sql("""i AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'stale' ELSE sha256(content) END AS h FROM docs WHERE id % 9 <> 0) SELECT docs.id, coalesce(i.h = sha256(content), false) AS fresh FROM docs LEFT JOIN i USING (id)"""))
def txt_index_fresh(spark, sf):
    d = documents(spark, sf).select("id", F.sha2("content", 256).alias("hash"))
    index = d.where("id % 9 <> 0").select("id", F.when(F.col("id") % 4 == 0, "stale").otherwise(F.col("hash")).alias("h"))
    return d.join(index, "id", "left").select("id", F.coalesce(F.col("h") == F.col("hash"), F.lit(False)).alias("fresh"))


@query()
def fn_clean(spark, sf):
    return documents(spark, sf).select("id", F.sha2(S.clean(F.col("content"))["text"], 256).alias("hash"))


@query(sql("SELECT id, CASE WHEN length(content) < 6 THEN NULL ELSE 5 END AS at FROM docs WHERE length(content) >= 6"))
def txt_anchor(spark, sf):
    d = documents(spark, sf).where(F.length("content") >= 6)
    return d.select("id", S.anchor(F.col("content"), F.substring("content", 6, 30), F.lit(5)).alias("at"))


@query()
def win_budget(spark, sf):
    return S.within_budget(documents(spark, sf).select("category", "id", F.col("word_count").cast("long").alias("word_count")), "category", "word_count", 50_000)


@query()
def win_heading_chain(spark, sf):
    import pandas as pd

    def run(frames):
        for pdf in frames:
            rows = []
            for i, t in zip(pdf["id"], pdf["content"], strict=True):
                rows += [(i, at, problem) for at, problem in S.heading_chain([(1 + len(x) % 3, len(x) % 5) for x in (t or "").split("\n")])]
            yield pd.DataFrame(rows, columns=["id", "position", "problem"])

    return documents(spark, sf).select("id", "content").mapInPandas(run, "id long, position int, problem string")


@query()
def fn_amount_cn(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), N.amount_in_words(F.format_string("%.2f", "o_totalprice")).alias("amount"))


@query(sql("SELECT o_orderkey AS id, translate(strftime(d, '%Y'), '0123456789', '〇一二三四五六七八九') || '年' || list_extract(n, month(d)) || '月' || list_extract(n, day(d)) || '日' AS date FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, ['一','二','三','四','五','六','七','八','九','十','十一','十二','十三','十四','十五','十六','十七','十八','十九','二十','二十一','二十二','二十三','二十四','二十五','二十六','二十七','二十八','二十九','三十','三十一'] AS n FROM orders)"))
def fn_date_cn(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), N.date_cn(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"))


@query()
def fn_cn_numbers(spark, sf):
    numerals = F.array(*map(F.lit, ["十二", "三百零五", "一万二千", "二〇二六", "三点五", "x"]))
    return table(spark, sf, "region").select("r_regionkey", F.explode(numerals).alias("s")).select("r_regionkey", "s", N.cn_number("s").alias("value"))


@query(sql(r"SELECT p_partkey AS id, left(regexp_replace(regexp_replace(p_name || '/' || p_type || '?. ', '[\\/:*?\"<>|]', '_', 'g'), '[. ]+$', ''), 80) AS name FROM part"))
def fn_safe_name(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), T.safe_name(F.concat("p_name", F.lit("/"), "p_type", F.lit("?. "))).alias("name"))


@query(sql("SELECT id, CASE WHEN title LIKE '%notice' THEN 'notice' WHEN ends_with(lower(title), '.') THEN '.' WHEN ends_with(lower(title), 'e.') THEN 'e.' ELSE '' END AS kind FROM docs"))
def fn_guess_doc_type(spark, sf):
    t = F.lower("title")
    return documents(spark, sf).select("id", F.when(F.col("title").endswith("notice"), "notice").when(t.endswith("."), ".").when(t.endswith("e."), "e.").otherwise("").alias("kind"))


@query(sql("SELECT id, replace(substr(content, greatest(instr(content, 'that') - 14, 1), 32), chr(10), ' ') AS context FROM docs WHERE contains(content, 'that')"))
def fn_bulk_ctx(spark, sf):
    d = documents(spark, sf).where(F.col("content").contains("that"))
    return d.select("id", F.replace(F.substring("content", F.greatest(F.instr("content", "that") - 14, F.lit(1)), F.lit(32)), F.lit("\n"), F.lit(" ")).alias("context"))


@query(sql("SELECT id, 'Dear ' || category || ', see {date} in ' || file_type AS text FROM docs"))
def fn_skeleton(spark, sf):
    template = F.lit("Dear {org}, see {date} in {lang}")
    filled = F.replace(F.replace(template, F.lit("{org}"), F.col("category")), F.lit("{lang}"), F.col("file_type"))
    return documents(spark, sf).select("id", filled.alias("text"))


@query(sql(r"SELECT id, unnest(regexp_extract_all(content, '[0-9]+(?:\.[0-9]+)?')) AS slot FROM docs"))
def fn_slots(spark, sf):
    return documents(spark, sf).select("id", F.explode(F.regexp_extract_all("content", F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))).alias("slot"))


@query(sql("SELECT a.id AS id, CAST(len(list_intersect(list_distinct(string_split(a.content, ' ')), list_distinct(string_split(b.content, ' ')))) AS BIGINT) AS shared FROM docs a JOIN docs b ON b.id = a.id + 1"))
def set_ngrams(spark, sf):
    d = documents(spark, sf).select("id", F.split("content", " ").alias("w"))
    n = d.select((F.col("id") - 1).alias("id"), F.col("w").alias("v"))
    return d.join(n, "id").select("id", F.size(F.array_intersect("w", "v")).cast("long").alias("shared"))


@query(sql("SELECT event_id FROM events WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = events.user_id AND p_size % 2 = 0)"))
def set_whitelist(spark, sf):
    reviewed = table(spark, sf, "part").where("p_size % 2 = 0").select(F.col("p_partkey").alias("user_id"))
    return table(spark, sf, "events").join(reviewed, "user_id", "left_anti").select("event_id")


@query(sql("SELECT id, len(list_filter(string_split(tags, ','), lambda t: contains(t, 'src1') OR contains('src1', t))) > 0 AS hit FROM docs"))
def join_tag_boost(spark, sf):
    return documents(spark, sf).select("id", F.exists(F.split("tags", ","), lambda t: t.contains("src1") | F.lit("src1").contains(t)).alias("hit"))


@query(sql(PARAS + " SELECT p.id, d.title, length(p.content) AS n FROM paras p JOIN docs d ON p.doc_id = d.id WHERE contains(p.content, 'that') AND deleted_time = ''"))
def join_para_doc(spark, sf):
    p = paragraphs(spark, sf).where(F.col("content").contains("that"))
    return p.select("id", "doc_id", F.length("content").cast("long").alias("n")).join(C.live(documents(spark, sf)).select(F.col("id").alias("doc_id"), "title"), "doc_id").select("id", "title", "n")


@query(sql("SELECT category, count(*) AS files, CAST(sum(strlen(content)) AS BIGINT) AS bytes, sha256(string_agg(sha256(content), ',' ORDER BY sha256(content))) AS sha FROM docs GROUP BY category"))
def agg_corpus_report(spark, sf):
    d = documents(spark, sf).select("category", F.octet_length("content").alias("b"), F.sha2("content", 256).alias("h"))
    return d.groupBy("category").agg(F.count(F.lit(1)).alias("files"), F.sum("b").cast("long").alias("bytes"), F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ","), 256).alias("sha"))


@query(sql("SELECT event_type, substr(sha1(event_type || ':' || user_id), 1, 12) AS bucket, count(*) AS n FROM events GROUP BY 1, 2"))
def agg_triage(spark, sf):
    key = F.substring(F.sha1(F.concat_ws(":", "event_type", F.col("user_id").cast("string"))), 1, 12)
    return table(spark, sf, "events").groupBy("event_type", key.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(sql("SELECT phrase, n FROM (SELECT lower(split_part(content, ' ', 1)) AS phrase, count(*) AS n FROM docs GROUP BY 1) ORDER BY n DESC, phrase LIMIT 15"))
def agg_calibrate(spark, sf):
    return documents(spark, sf).groupBy(F.lower(F.substring_index("content", " ", 1)).alias("phrase")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "phrase").limit(15)


@query(sql("SELECT file_type AS dim, category AS name, n, round(n * 100.0 / sum(n) OVER (PARTITION BY file_type), 1) AS share FROM (SELECT file_type, category, count(*) AS n FROM docs GROUP BY 1, 2)"))
def agg_share(spark, sf):
    n = documents(spark, sf).groupBy(F.col("file_type").alias("dim"), F.col("category").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("dim")), 1))


@query(sql("""h AS (SELECT id, title, sha256(content) AS s FROM docs), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY id) AS r FROM h) WHERE r = 1)
SELECT id, CASE WHEN row_number() OVER (PARTITION BY title ORDER BY id) > 1 THEN title || '（' || row_number() OVER (PARTITION BY title ORDER BY id) || '）' ELSE title END AS title FROM k"""))
def snk_material_add(spark, sf):
    d = documents(spark, sf).select("id", "title", F.sha2("content", 256).alias("s"))
    d = C.latest(d, ["s"], F.asc("id"))
    n = F.row_number().over(Window.partitionBy("title").orderBy("id"))
    return d.withColumn("n", n).select("id", F.when(F.col("n") > 1, F.concat("title", F.lit("（"), F.col("n").cast("string"), F.lit("）"))).otherwise(F.col("title")).alias("title"))


@query(sql("SELECT p_brand AS wrong, p_type AS correct, p_mfgr AS source FROM (SELECT *, 's' || (p_partkey % 3) AS p_mfgr FROM part) WHERE p_mfgr = 's1' AND p_size > 10"))
def snk_rules_csv(spark, sf):
    return table(spark, sf, "part").select(F.col("p_brand").alias("wrong"), F.col("p_type").alias("correct"), F.concat(F.lit("s"), (F.col("p_partkey") % 3).cast("string")).alias("source"), "p_size").where("source = 's1' and p_size > 10").drop("p_size")


@query(sql("SELECT category, n, rank FROM (SELECT category, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, category) AS rank FROM docs GROUP BY 1)"))
def snk_report(spark, sf):
    n = documents(spark, sf).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "category")).cast("long"))


@query(sql("SELECT id, substr(word, 1, 1) AS role, word FROM (SELECT *, row_number() OVER (PARTITION BY substr(word, 1, 1) ORDER BY length(word) DESC, word) AS r FROM words) WHERE r <= 3"))
def flt_templates(spark, sf):
    w = Window.partitionBy("role").orderBy(F.length("word").desc(), "word")
    return words(spark, sf).select("id", F.substring("word", 1, 1).alias("role"), "word").withColumn("r", F.row_number().over(w)).where("r <= 3").drop("r")


@query(sql("SELECT conv_id, turn, role, length(text) AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, text ORDER BY turn) AS r FROM conversations WHERE contains(lower(text), 'the')) WHERE r = 1 ORDER BY CASE role WHEN 'user' THEN 0 ELSE 1 END, length(text), conv_id, turn LIMIT 40"))
def flt_material_search(spark, sf):
    c = table(spark, sf, "conversations").where(F.lower("text").contains("the"))
    w = Window.partitionBy("conv_id", "text").orderBy("turn")
    c = c.withColumn("r", F.row_number().over(w)).where("r = 1")
    return c.orderBy(F.when(F.col("role") == "user", 0).otherwise(1), F.length("text"), "conv_id", "turn").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n")).limit(40)


@query(sql("SELECT wrong, min(correct) AS correct, CAST(0.55 AS DOUBLE) AS confidence FROM (SELECT a.word AS correct, substr(b.word, 1, 1) || substr(a.word, 2) AS wrong FROM words a JOIN words b ON length(a.word) = length(b.word) AND substr(a.word, 1, 1) <> substr(b.word, 1, 1) AND length(a.word) <= 4) WHERE wrong NOT IN (SELECT word FROM words) GROUP BY wrong"))
def gen_confusions(spark, sf):
    w = words(spark, sf).where(F.length("word") <= 4).select("word", F.length("word").alias("n"), F.substring("word", 1, 1).alias("c"))
    heads = w.select("n", F.col("c").alias("other")).distinct()
    made = w.join(heads, "n").where("c <> other").select(F.col("word").alias("correct"), F.concat("other", F.expr("substr(word, 2)")).alias("wrong"))
    known = words(spark, sf).select(F.col("word").alias("wrong"))
    return made.join(known, "wrong", "left_anti").groupBy("wrong").agg(F.min("correct").alias("correct")).withColumn("confidence", F.lit(0.55))


@query(sql("SELECT p_partkey AS line, p_brand AS wrong, p_type AS correct, least(1.0, greatest(0.0, p_retailprice / 1500.0)) AS confidence, CASE WHEN p_size % 10 = 0 THEN 'wrong: missing' END AS issue FROM part".replace("p_brand AS wrong", "CASE WHEN p_size % 10 = 0 THEN '' ELSE p_brand END AS wrong")))
def dml_rules_import(spark, sf):
    p = table(spark, sf, "part")
    wrong = F.when(F.col("p_size") % 10 == 0, "").otherwise(F.col("p_brand"))
    return p.select(F.col("p_partkey").alias("line"), wrong.alias("wrong"), F.col("p_type").alias("correct"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("p_retailprice") / 1500.0)).alias("confidence"), F.when(wrong == "", "wrong: missing").alias("issue"))


@query(sql("SELECT count(*) AS live, count(*) > 500 AS over FROM docs WHERE deleted_time = ''"))
def dml_index_budget(spark, sf):
    return C.live(documents(spark, sf)).agg(F.count(F.lit(1)).alias("live")).withColumn("over", F.col("live") > 500)


@query(sql("SELECT id, category, word_count FROM docs WHERE deleted_time = '' AND category IN ('src1', 'src2', 'src3') AND id BETWEEN 0 AND 100000000"))
def src_documents_iter(spark, sf):
    return C.live(documents(spark, sf)).where(F.col("category").isin("src1", "src2", "src3") & F.col("id").between(0, 100_000_000)).select("id", "category", "word_count")
