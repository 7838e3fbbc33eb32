"""Queries over the corpus store: selections, joins, aggregates, set operations and copy-on-write changes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus as C
from ..operators import similarity as M
from ..session import table
from .catalog import catalog
from .views import documents, phrases, sql, words

query, QUERIES, SQL = catalog()


@query(sql("SELECT id, title, word_count FROM docs WHERE deleted_time = '' ORDER BY id DESC"))
def flt_live_docs(spark, sf):
    return C.list_documents(documents(spark, sf)).select("id", "title", "word_count")


@query(sql("SELECT id, title FROM docs WHERE deleted_time <> '' ORDER BY deleted_time DESC, id DESC LIMIT 50"))
def flt_trash(spark, sf):
    return documents(spark, sf).where("deleted_time <> ''").orderBy(F.desc("deleted_time"), F.desc("id")).select("id", "title").limit(50)


@query(sql("SELECT id, word_count FROM docs WHERE deleted_time = '' AND file_type = 'fr' ORDER BY word_count DESC, id"))
def flt_doc_list(spark, sf):
    return C.list_documents(documents(spark, sf), "words").where("file_type = 'fr'").select("id", "word_count")


@query(sql("SELECT id, title, category FROM docs WHERE id = 42"))
def flt_point(spark, sf):
    return documents(spark, sf).where("id = 42").select("id", "title", "category")


@query(sql("SELECT id, category, file_type FROM docs WHERE deleted_time = '' AND contains(tags, 'src1') AND word_count BETWEEN 100 AND 2000"))
def flt_doc_select_export(spark, sf):
    return C.live(documents(spark, sf)).where(F.col("tags").contains("src1") & F.col("word_count").between(100, 2000)).select("id", "category", "file_type")


@query(sql("SELECT id, phrase, context FROM phrases WHERE phrase LIKE '%the%' OR context LIKE '%the%' ORDER BY id DESC LIMIT 20 OFFSET 5"))
def flt_phrases(spark, sf):
    return phrases(spark, sf).where("phrase like '%the%' or context like '%the%'").orderBy(F.desc("id")).offset(5).limit(20)


@query(sql("SELECT id, word FROM words WHERE word LIKE '%e%' ORDER BY word, id LIMIT 300"))
def flt_dict_ui(spark, sf):
    return words(spark, sf).where(F.col("word").contains("e")).orderBy("word", "id").select("id", "word").limit(300)


@query(sql("SELECT DISTINCT word FROM words WHERE coalesce(source, '') NOT IN ('user')"))
def flt_evidence_words(spark, sf):
    user = spark.createDataFrame([("user",)], "source string")
    return words(spark, sf).withColumn("source", F.coalesce("source", F.lit(""))).join(F.broadcast(user), "source", "left_anti").select("word").distinct()


@query(sql("SELECT id, word FROM words WHERE word >= 's' AND word < 't'"))
def join_range_prefix(spark, sf):
    return words(spark, sf).where(F.col("word").startswith("s")).select("id", "word")


@query(sql("SELECT id, name FROM (SELECT p_partkey AS id, p_name || CASE p_partkey % 4 WHEN 0 THEN ' 50%_off' WHEN 1 THEN ' 50 off' ELSE '' END AS name FROM part) WHERE contains(name, '50%_o')"))
def flt_like_escape(spark, sf):
    """LIKE with a keyword whose % and _ mean themselves."""
    k = F.col("p_partkey") % 4
    name = F.concat("p_name", F.when(k == 0, " 50%_off").when(k == 1, " 50 off").otherwise(""))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), name.alias("name")).where(C.like_any("name", "50%_o"))


@query(sql("SELECT category, count(*) AS n, sum(word_count) AS chars FROM docs WHERE deleted_time = '' GROUP BY category"))
def agg_counts(spark, sf):
    return C.live(documents(spark, sf)).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum("word_count").alias("chars"))


def tree_and_docs(spark, sf):
    tree = table(spark, sf, "nation").select((F.col("n_nationkey") + 1).cast("long").alias("id"), F.when(F.col("n_nationkey") < 5, 0).otherwise((F.col("n_nationkey") / 5).cast("int")).cast("long").alias("parent_id"))
    return tree, documents(spark, sf).withColumn("category_id", F.col("id") % 26)


_TREE = """tree AS (SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, CAST(CASE WHEN n_nationkey < 5 THEN 0 ELSE n_nationkey // 5 END AS BIGINT) AS parent_id FROM nation),
clo(node, ancestor) AS (SELECT id, id FROM tree UNION ALL SELECT node, parent_id FROM clo JOIN tree ON ancestor = id WHERE parent_id <> 0),
own AS (SELECT id % 26 AS category_id, count(*) AS n FROM docs WHERE deleted_time = '' GROUP BY 1)"""


@query(sql(_TREE + """ SELECT ancestor AS id, CAST(sum(CASE WHEN node = ancestor THEN coalesce(n, 0) ELSE 0 END) AS BIGINT) AS own, CAST(sum(coalesce(n, 0)) AS BIGINT) AS total FROM clo LEFT JOIN own ON node = category_id GROUP BY ancestor
UNION ALL SELECT 0, (SELECT coalesce(sum(n), 0) FROM own WHERE category_id = 0), (SELECT sum(n) FROM own)"""))
def agg_tree_rollup(spark, sf):
    return C.tree_rollup(*tree_and_docs(spark, sf))


@query(sql(_TREE + " SELECT d.id FROM docs d WHERE deleted_time = '' AND d.id % 26 IN (SELECT node FROM clo WHERE ancestor = 1)"))
def join_semi_category(spark, sf):
    tree, docs = tree_and_docs(spark, sf)
    below = C.closure(tree).where("ancestor = 1").select(F.col("node").alias("category_id"))
    return C.live(docs).join(F.broadcast(below), "category_id", "left_semi").select("id")


@query(sql("SELECT doc_id AS id, quality, toxic FROM labels WHERE NOT EXISTS (SELECT 1 FROM docs WHERE docs.id = labels.doc_id AND deleted_time = '')"))
def join_anti_orphan(spark, sf):
    return table(spark, sf, "labels").join(C.live(documents(spark, sf)).select(F.col("id").alias("doc_id")), "doc_id", "left_anti").select(F.col("doc_id").alias("id"), "quality", "toxic")


@query(sql("SELECT l.doc_id AS id, title, deleted_time FROM labels l LEFT JOIN docs ON docs.id = l.doc_id"))
def join_left_meta(spark, sf):
    return table(spark, sf, "labels").select(F.col("doc_id").alias("id")).join(documents(spark, sf).select("id", "title", "deleted_time"), "id", "left")


@query(sql("SELECT d.id AS id, count(e.event_id) AS n FROM docs d LEFT JOIN events e ON e.user_id = d.id GROUP BY d.id"))
def agg_attach_counts(spark, sf):
    n = table(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return documents(spark, sf).select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


@query(sql("SELECT a.word AS word, b.word AS related FROM words a JOIN words b ON length(a.word) = length(b.word) AND substr(a.word, 1, 2) = substr(b.word, 1, 2) AND a.word <> b.word"))
def join_pinyin(spark, sf):
    w = words(spark, sf).select("word", F.concat(F.length("word").cast("string"), F.lit(":"), F.substring("word", 1, 2)).alias("sound"))
    return w.join(w.withColumnRenamed("word", "related"), "sound").where("word <> related").select("word", "related").distinct()


@query(sql("SELECT name, n FROM (SELECT coalesce(nullif(source, ''), '未标注') AS name, count(*) AS n FROM words GROUP BY 1) ORDER BY n DESC, name"))
def agg_pair_sources(spark, sf):
    return words(spark, sf).groupBy(F.coalesce(F.nullif("source", F.lit("")), F.lit("未标注")).alias("name")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name")


@query(sql("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 30"))
def win_keep_last_n(spark, sf):
    return C.keep_last(table(spark, sf, "events").select("event_id", "user_id"), "user_id", F.desc("event_id"), 30)


@query(sql("SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2"))
def dml_upserts(spark, sf):
    return C.latest(table(spark, sf, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], F.desc("event_id"))


@query(sql("SELECT event_id, event_type, round((value - min(value) OVER w) / CASE WHEN max(value) OVER w = min(value) OVER w THEN 1.0 ELSE max(value) OVER w - min(value) OVER w END, 6) AS norm FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY event_type)"))
def win_minmax_norm(spark, sf):
    from ..operators.search import minmax

    return minmax(table(spark, sf, "events").where("value is not null"), "event_type", "value", "norm").select("event_id", "event_type", F.round("norm", 6).alias("norm"))


@query(sql("SELECT event_id, user_id, CAST(event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS gap FROM events"))
def win_sequence_gap(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf, "events").select("event_id", "user_id", (F.col("event_id") - F.lag("event_id").over(w)).alias("gap"))


@query(sql("""g AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS grp FROM events)
SELECT user_id, event_type, min(event_id) AS first_id, count(*) AS n FROM g GROUP BY user_id, event_type, grp HAVING count(*) >= 3"""))
def win_fatigue_runs(spark, sf):
    a, b = Window.partitionBy("user_id").orderBy("event_id"), Window.partitionBy("user_id", "event_type").orderBy("event_id")
    g = table(spark, sf, "events").select("user_id", "event_type", "event_id", (F.row_number().over(a) - F.row_number().over(b)).alias("grp"))
    return g.groupBy("user_id", "event_type", "grp").agg(F.min("event_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n >= 3").drop("grp")


@query(sql("SELECT 'documents' AS source, id FROM docs WHERE deleted_time = '' UNION SELECT 'dictionary', id FROM words UNION SELECT 'phrases', id FROM phrases"))
def set_three_source_union(spark, sf):
    parts = [C.live(documents(spark, sf)).select(F.lit("documents").alias("source"), "id"), words(spark, sf).select(F.lit("dictionary").alias("source"), "id"), phrases(spark, sf).select(F.lit("phrases").alias("source"), "id")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).dropDuplicates(["source", "id"])


@query(sql("SELECT DISTINCT id FROM (SELECT doc_id AS id FROM labels UNION SELECT id FROM docs WHERE id % 3 = 0) WHERE id NOT IN (SELECT id FROM docs WHERE deleted_time = '')"))
def set_stale(spark, sf):
    d = documents(spark, sf)
    indexed, state = table(spark, sf, "labels").select(F.col("doc_id").alias("id")), d.where("id % 3 = 0").select("id")
    return indexed.union(state).distinct().subtract(C.live(d).select("id"))


@query(sql("SELECT DISTINCT user_id AS id FROM events EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0"))
def set_sweep_orphans(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("id")).distinct().join(table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id")), "id", "left_anti")


@query(sql("SELECT id, CASE WHEN file_type = 'de' THEN category || '，new' ELSE category || '，' || file_type || '，new' END AS tags FROM docs"))
def set_tags(spark, sf):
    return documents(spark, sf).select("id", T.set_tags(F.col("tags"), F.array(F.lit("new")), F.array(F.lit("de"))).alias("tags"))


_HASH = r"sha256(regexp_replace(content, '[\s\x0B]', '', 'g'))"


@query(sql(f"SELECT {_HASH} AS text_hash, min(id) AS first_id, count(*) AS n FROM docs GROUP BY 1 HAVING count(*) > 1"))
def sim_exact_dup(spark, sf):
    return M.exact_duplicates(documents(spark, sf))


@query(sql(f"""h AS (SELECT id, {_HASH} AS text_hash, deleted_time FROM docs), o AS (SELECT * FROM h WHERE id < 500), n AS (SELECT id, text_hash FROM h WHERE id >= 300),
g AS (SELECT text_hash, arg_min(id, CASE WHEN deleted_time = '' THEN id ELSE id + 1000000000 END) AS old_id, max(CASE WHEN deleted_time = '' THEN 1 ELSE 0 END) AS alive FROM o GROUP BY 1),
j AS (SELECT n.id, text_hash, old_id, alive, row_number() OVER (PARTITION BY text_hash ORDER BY n.id) AS r FROM n LEFT JOIN g USING (text_hash))
SELECT id, text_hash, CASE WHEN alive = 1 THEN 'duplicate' WHEN r > 1 THEN 'duplicate' WHEN old_id IS NOT NULL THEN 'restore' ELSE 'insert' END AS action,
  CASE WHEN coalesce(alive, 0) = 0 AND r = 1 AND old_id IS NOT NULL THEN old_id END AS restored_id FROM j"""))
def dml_add_document(spark, sf):
    h = documents(spark, sf).select("id", T.text_hash(F.col("content")).alias("text_hash"), "deleted_time")
    return C.add_documents(h.where("id < 500"), h.where("id >= 300").select("id", "text_hash"))


@query(sql(f"""h AS (SELECT id, {_HASH} AS text_hash, deleted_time FROM docs), d AS (SELECT id, text_hash FROM h WHERE deleted_time = ''),
s AS (SELECT id, CASE WHEN id % 7 = 0 THEN 'old' ELSE text_hash END AS old_hash FROM h WHERE id % 5 <> 0)
SELECT coalesce(d.id, s.id) AS id, CASE WHEN text_hash IS NULL THEN 'drop' WHEN old_hash IS NULL THEN 'add' ELSE 'refresh' END AS action
FROM d FULL JOIN s ON d.id = s.id WHERE text_hash IS NULL OR old_hash IS NULL OR text_hash <> old_hash"""))
def dml_incremental_index(spark, sf):
    h = documents(spark, sf).select("id", T.text_hash(F.col("content")).alias("text_hash"), "deleted_time")
    state = h.where("id % 5 <> 0").select(F.col("id").alias("ref_id"), F.when(F.col("id") % 7 == 0, "old").otherwise(F.col("text_hash")).alias("text_hash"))
    return C.index_changes(h.where("deleted_time = ''"), state)


@query(sql("SELECT id, CASE WHEN id % 4 = 0 THEN '2024-02-02' ELSE deleted_time END AS deleted_time FROM docs WHERE NOT (deleted_time <> '' AND id % 34 = 0)"))
def dml_soft_delete(spark, sf):
    d = documents(spark, sf).where("not (deleted_time <> '' and id % 34 = 0)")
    return d.select("id", F.when(F.col("id") % 4 == 0, "2024-02-02").otherwise(F.col("deleted_time")).alias("deleted_time"))


@query(sql("SELECT id, word, CASE WHEN source = 'user' THEN 0 ELSE 1 END AS enabled FROM words"))
def dml_toggle_rules(spark, sf):
    return words(spark, sf).select("id", "word", F.when(F.col("source") == "user", 0).otherwise(1).alias("enabled"))


@query(sql("SELECT id, word, source FROM words WHERE source IS DISTINCT FROM 'user'"))
def dml_delete_source(spark, sf):
    return words(spark, sf).where(~F.col("source").eqNullSafe("user"))


_ENTRIES = """entries AS (SELECT p_partkey AS line, p_brand AS wrong, p_type AS correct, CASE WHEN p_size % 2 = 0 THEN 0.99 ELSE 0.8 END AS confidence FROM part WHERE p_partkey > 300),
existing AS (SELECT DISTINCT p_brand AS wrong, p_type AS correct, 0.99 AS confidence FROM part WHERE p_partkey <= 300)"""


@query(sql(_ENTRIES + """, j AS (SELECT e.*, x.confidence AS old, o.n AS others, row_number() OVER (PARTITION BY e.wrong, e.correct ORDER BY e.line) AS r FROM entries e LEFT JOIN existing x ON e.wrong = x.wrong AND e.correct = x.correct LEFT JOIN (SELECT wrong, count(*) AS n FROM existing GROUP BY 1) o ON e.wrong = o.wrong)
SELECT line, wrong, correct, CASE WHEN r > 1 THEN 'skip' WHEN old = confidence THEN 'skip' WHEN old IS NOT NULL THEN 'overwrite' WHEN others > 0 THEN 'conflict' ELSE 'add' END AS change FROM j"""))
def dml_wordlist_merge(spark, sf):
    p = table(spark, sf, "part")
    rows = p.select(F.col("p_partkey").alias("line"), F.col("p_brand").alias("wrong"), F.col("p_type").alias("correct"), F.when(F.col("p_size") % 2 == 0, 0.99).otherwise(0.8).alias("confidence"))
    existing = rows.where("line <= 300").select("wrong", "correct").distinct().withColumn("confidence", F.lit(0.99))
    return C.merge_wordlist(existing, rows.where("line > 300"))


@query(sql("SELECT id, len(string_split(content, 'the')) - 1 AS n, sha256(replace(content, 'the', 'THE')) AS after FROM docs WHERE contains(content, 'the')"))
def dml_bulk_replace(spark, sf):
    d = documents(spark, sf).where(F.col("content").contains("the"))
    return d.select("id", F.regexp_count("content", F.lit("the")).cast("long").alias("n"), F.sha2(F.replace("content", F.lit("the"), F.lit("THE")), 256).alias("after"))


@query(sql("""n AS (SELECT id, coalesce(nullif(substr(title, 1, 12), ''), '_') AS name, content FROM docs)
SELECT id, CASE WHEN row_number() OVER (PARTITION BY name ORDER BY id) > 1 THEN name || '_' || row_number() OVER (PARTITION BY name ORDER BY id) ELSE name END AS name, CAST(strlen(content) AS BIGINT) AS bytes, sha256(content) AS sha256 FROM n"""))
def snk_handover(spark, sf):
    return C.manifest(documents(spark, sf).select("id", F.coalesce(F.nullif(F.substring("title", 1, 12), F.lit("")), F.lit("_")).alias("name"), "content"))


@query(sql("""m AS (SELECT CAST(id AS VARCHAR) AS name, CAST(strlen(content) AS BIGINT) AS bytes, sha256(content) AS sha256 FROM docs WHERE id % 10 <> 0),
a AS (SELECT CAST(id AS VARCHAR) AS name, CAST(strlen(CASE WHEN id % 7 = 0 THEN content || '!' WHEN id % 11 = 0 THEN reverse(content) ELSE content END) AS BIGINT) AS b2, sha256(CASE WHEN id % 7 = 0 THEN content || '!' WHEN id % 11 = 0 THEN reverse(content) ELSE content END) AS s2 FROM docs WHERE id % 13 <> 0)
SELECT coalesce(m.name, a.name) AS name, CASE WHEN s2 IS NULL THEN 'missing' WHEN sha256 IS NULL THEN 'unlisted' WHEN bytes <> b2 THEN 'length' ELSE 'digest' END AS problem FROM m FULL JOIN a ON m.name = a.name WHERE s2 IS NULL OR sha256 IS NULL OR sha256 <> s2"""))
def snk_verify(spark, sf):
    d = documents(spark, sf).select("id", F.col("id").cast("string").alias("name"), "content")
    changed = F.when(F.col("id") % 7 == 0, F.concat("content", F.lit("!"))).when(F.col("id") % 11 == 0, F.reverse("content")).otherwise(F.col("content"))
    return C.verify(C.manifest(d.where("id % 10 <> 0")), C.manifest(d.where("id % 13 <> 0").withColumn("content", changed)))


@query()
def sim_jaccard(spark, sf):
    return M.ngram_pairs(documents(spark, sf), 0.7, lower=True)


@query()
def sim_hash64(spark, sf):
    return M.simhashes(documents(spark, sf))


@query()
def sim_pairs(spark, sf):
    return M.find_similar(documents(spark, sf), 0.7)


@query(sql("SELECT a.vec_id AS a, a.label, CAST(bit_count(xor(CAST(a.vec_id * 2654435761 AS BIGINT), CAST(a.label * 40503 AS BIGINT))) AS INTEGER) AS distance FROM embeddings a"))
def sim_hamming(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("a"), "label", M.hamming(F.col("vec_id") * 2654435761, (F.col("label") * 40503).cast("long")).alias("distance"))


@query()
def sim_diff_lines(spark, sf):
    pairs = documents(spark, sf).select("id", "content").withColumn("new", F.regexp_replace("content", "(?m)^(.{5}).*$", "$1"))
    return pairs.select("id", F.explode(M.line_ops("content", "new")).alias("x")).select("id", "x.*")


@query(sql("SELECT a.word AS a, b.word AS b, CAST(levenshtein(a.word, b.word) AS INTEGER) AS distance FROM words a JOIN words b ON substr(a.word, 1, 3) = substr(b.word, 1, 3) AND a.word < b.word"))
def sim_lcs(spark, sf):
    w = words(spark, sf).select("word", F.substring("word", 1, 3).alias("p"))
    j = w.select(F.col("word").alias("a"), "p").join(w.select(F.col("word").alias("b"), "p"), "p").where("a < b")
    return j.select("a", "b", F.levenshtein("a", "b").alias("distance"))


@query(sql("SELECT count(*) AS docs, CAST(sum(word_count) AS BIGINT) AS chars, count(DISTINCT category) AS sources, string_agg(DISTINCT file_type, ',' ORDER BY file_type) AS kinds FROM docs WHERE deleted_time = ''"))
def agg_pack_stats(spark, sf):
    return C.live(documents(spark, sf)).agg(F.count(F.lit(1)).alias("docs"), F.sum("word_count").alias("chars"), F.countDistinct("category").alias("sources"), F.array_join(F.sort_array(F.collect_set("file_type")), ",").alias("kinds"))


@query(sql("SELECT (SELECT count(*) FROM docs WHERE deleted_time = '') AS live, (SELECT count(*) FROM docs WHERE deleted_time <> '') AS trashed, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT id FROM docs WHERE deleted_time = '')) AS orphan_labels"))
def agg_health(spark, sf):
    d = documents(spark, sf)
    n = d.agg(F.count(F.when(F.col("deleted_time") == "", 1)).alias("live"), F.count(F.when(F.col("deleted_time") != "", 1)).alias("trashed"))
    orphans = table(spark, sf, "labels").join(C.live(d).select(F.col("id").alias("doc_id")), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("orphan_labels"))
    return n.crossJoin(orphans)


@query(sql("""p AS (SELECT l.doc_id, l.quality AS truth, CASE WHEN d.n_chars > 500 THEN 1 ELSE 0 END AS pred, d.lang FROM labels l JOIN documents d USING (doc_id) WHERE quality IS NOT NULL)
SELECT lang, round(sum(truth * pred) / greatest(1, sum(pred)), 6) AS precision, round(sum(truth * pred) / greatest(1, sum(truth)), 6) AS recall,
  round(1.25 * (sum(truth * pred) / greatest(1, sum(pred))) * (sum(truth * pred) / greatest(1, sum(truth))) / greatest(1e-9, 0.25 * (sum(truth * pred) / greatest(1, sum(pred))) + sum(truth * pred) / greatest(1, sum(truth))), 6) AS f05 FROM p GROUP BY lang"""))
def agg_eval_prf(spark, sf):
    from ..operators.quality import precision_recall

    d = table(spark, sf, "documents").select("doc_id", "lang", (F.col("n_chars") > 500).cast("int").alias("pred"))
    return precision_recall(table(spark, sf, "labels").where("quality is not null").join(d, "doc_id").withColumnRenamed("quality", "truth"), "lang")
