"""Queries of text analytics: functions, quality, detection, structure, web pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import detect as D
from ..operators import quality as Q
from ..sources import parsers as P
from ..session import table
from .catalog import catalog
from .search_plans import PARAS, paragraphs
from .views import documents, phrases, sql

query, QUERIES, SQL = catalog()

_SENTS = r"list_filter(list_transform(regexp_split_to_array({}, '[.!?;。！？；\n]'), lambda s: length(trim(s, ' '))), lambda n: n >= 4)"
_METRICS = f"""m0 AS (SELECT id, file_type, content, length(regexp_replace(content, '[ \\t\\n\\r]', '', 'g')) AS chars, {_SENTS.format('content')} AS ss, list_filter(list_transform(string_split(content, chr(10)), lambda s: length(trim(s, ' '))), lambda n: n > 0) AS ps FROM docs),
met AS (SELECT id, file_type, CAST(chars AS BIGINT) AS chars, CAST(len(ss) AS BIGINT) AS sentences, round(CASE WHEN len(ss) > 0 THEN list_sum(ss) / len(ss) ELSE 0.0 END, 6) AS mean_sentence, CAST(len(ps) AS BIGINT) AS paragraphs, round(CASE WHEN len(ps) > 0 THEN list_sum(ps) / len(ps) ELSE 0.0 END, 6) AS mean_paragraph,
  round((length(content) - length(replace(content, ',', ''))) * 1000.0 / greatest(1, chars), 6) AS commas_permille, CAST(length(content) - length(replace(content, '"', '')) AS BIGINT) AS quotes, CAST(length(content) - length(regexp_replace(content, '[-—]', '', 'g')) AS BIGINT) AS dashes,
  CAST(length(content) - length(replace(content, '%', '')) AS BIGINT) AS percents, CAST(length(content) - length(regexp_replace(content, '[0-9]', '', 'g')) AS BIGINT) AS digits FROM m0)"""
KEYS = ["mean_sentence", "mean_paragraph", "commas_permille"]


@query(sql(_METRICS + " SELECT * EXCLUDE (file_type) FROM met"))
def txt_style(spark, sf):
    return Q.style_metrics(documents(spark, sf))


def _metrics(spark, sf):
    d = documents(spark, sf)
    return Q.style_metrics(d).join(d.select("id", "file_type"), "id")


_PRINTS = ", pr AS (SELECT file_type, key, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS p75 FROM (" + " UNION ALL ".join(f"SELECT file_type, '{k}' AS key, CAST({k} AS DOUBLE) AS value FROM met" for k in KEYS) + ") GROUP BY 1, 2)"


@query(sql(_METRICS + _PRINTS + " SELECT * FROM pr"))
def txt_fingerprint(spark, sf):
    return Q.fingerprints(_metrics(spark, sf), "file_type", KEYS)


@query()
def txt_genre_rank(spark, sf):
    m = _metrics(spark, sf)
    return Q.genre_rank(m, Q.fingerprints(m, "file_type", KEYS), "file_type", KEYS)


@query(sql(r"""SELECT id, list_filter([CASE WHEN length(replace(content, '(', '')) <> length(replace(content, ')', '')) THEN 'unbalanced ()' END, CASE WHEN length(replace(content, '[', '')) <> length(replace(content, ']', '')) THEN 'unbalanced []' END,
  CASE WHEN length(replace(content, '（', '')) <> length(replace(content, '）', '')) THEN 'unbalanced （）' END, CASE WHEN length(replace(content, '《', '')) <> length(replace(content, '》', '')) THEN 'unbalanced 《》' END, CASE WHEN length(replace(content, '“', '')) <> length(replace(content, '”', '')) THEN 'unbalanced “”' END,
  CASE WHEN len(list_filter(string_split(content, chr(10)), lambda p: length(p) > 1500)) > 0 THEN 'overlong paragraph' END, CASE WHEN regexp_matches(content, '[\x00-\x08\x0B\x0C\x0E-\x1F]') THEN 'control characters' END], lambda x: x IS NOT NULL) AS defects FROM docs
WHERE len(list_filter([length(replace(content, '(', '')) <> length(replace(content, ')', '')), length(replace(content, '[', '')) <> length(replace(content, ']', '')), length(replace(content, '（', '')) <> length(replace(content, '）', '')), length(replace(content, '《', '')) <> length(replace(content, '》', '')), length(replace(content, '“', '')) <> length(replace(content, '”', '')),
  len(list_filter(string_split(content, chr(10)), lambda p: length(p) > 1500)) > 0, regexp_matches(content, '[\x00-\x08\x0B\x0C\x0E-\x1F]')], lambda x: x)) > 0"""))
def fn_defects(spark, sf):
    return Q.defects(documents(spark, sf))


@query(sql(r"SELECT id, v AS value, CASE WHEN length(v) <= 4 THEN repeat('*', length(v)) ELSE substr(v, 1, 2) || repeat('*', length(v) - 4) || right(v, 2) END AS masked FROM (SELECT id, unnest(regexp_extract_all(content, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}')) AS v FROM docs)"))
def fn_pii(spark, sf):
    return documents(spark, sf).select("id", F.explode(T.personal_data(F.col("content"))).alias("x")).where("x.kind = 'email'").select("id", "x.value", "x.masked")


@query(sql(r"SELECT id, len(s) AS n, list_max(list_transform(s, lambda x: length(x))) AS longest FROM (SELECT id, list_filter(list_transform(regexp_split_to_array(content, '[。！？；!?;\n.]'), lambda x: trim(x, ' ')), lambda x: length(x) > 0) AS s FROM docs)"))
def fn_sentence_split(spark, sf):
    return documents(spark, sf).select("id", T.sentences(F.col("content")).alias("s")).select("id", F.size("s").cast("long").alias("n"), F.array_max(F.transform("s", lambda x: F.length(x))).cast("long").alias("longest"))


@query(sql(PARAS + " SELECT id, doc_id, kind, sha256(content) AS hash FROM paras"))
def txt_paragraphs(spark, sf):
    return paragraphs(spark, sf).select("id", "doc_id", "kind", F.sha2("content", 256).alias("hash"))


_T = r"regexp_extract_all(lower(content), '[\p{L}\p{N}]+')"


@query(sql(f"SELECT id, phrase, count(*) AS n FROM (SELECT id, array_to_string(t[i:i + 3], ' ') AS phrase FROM (SELECT id, {_T} AS t FROM docs), unnest(range(1, len(t) - 2)) AS u(i) WHERE len(t) >= 4) GROUP BY 1, 2 HAVING count(*) >= 3"))
def txt_repeated_phrases(spark, sf):
    return Q.repeated_phrases(documents(spark, sf))


@query(sql("SELECT id, 'the' AS first, 'licensed' AS variant FROM docs WHERE contains(content, 'the') AND contains(content, 'licensed') UNION ALL SELECT id, 'token', 'secret' FROM docs WHERE contains(content, 'token') AND contains(content, 'secret')"))
def con_units(spark, sf):
    return Q.unit_mix(documents(spark, sf), [("the", "licensed"), ("token", "secret")])


_LEXICON = [D.Pair("loser", "rival"), D.Pair("stupid", "unwise", "lexicon", 0.95), D.Pair("scum", "foam", "style", 0.9), D.Pair("moron", "person", "lexicon", 0.55)]
_RULES = D.Rules(pairs=_LEXICON, rules=[D.Rule(r" ,", ",", "punctuation", 0.8), D.Rule(r"(\w)\1\1+", r"\1\1", "letters", 0.6)])


@query(sql("""pairs(w, c, cat, conf) AS (VALUES ('loser', 'rival', 'lexicon', 0.9), ('stupid', 'unwise', 'lexicon', 0.95), ('scum', 'foam', 'style', 0.9), ('moron', 'person', 'lexicon', 0.55))
SELECT id, CAST(i - 1 AS INTEGER) AS start, CAST(i - 1 + length(w) AS INTEGER) AS "end", w AS wrong, c AS suggestion, cat AS category, CAST(conf AS DOUBLE) AS confidence
FROM docs, pairs, unnest(range(1, length(content) + 1)) AS u(i) WHERE contains(content, w) AND substr(content, i, length(w)) = w"""))
def cor_exact(spark, sf):
    return D.check_documents(documents(spark, sf), D.Rules(pairs=_LEXICON, repeats=False))


@query()
def cor_check_text(spark, sf):
    return D.check_documents(documents(spark, sf), _RULES)


@query()
def cor_severity(spark, sf):
    d = documents(spark, sf)
    return D.severity(D.check_documents(d, _RULES), d)


@query()
def dml_batch_correct(spark, sf):
    d = documents(spark, sf)
    plan = D.plan(D.check_documents(d, _RULES), d)
    out = D.apply_plan(plan, d.withColumn("content", F.when(F.col("id") % 2 == 0, F.concat(F.lit("New. "), "content")).otherwise(F.col("content"))))
    return out.select("id", F.sha2("content", 256).alias("after"), "applied", "skipped")


@query(sql("""c AS (SELECT p_brand AS wrong, p_type AS correct, 'x' AS category, CASE WHEN p_size % 3 = 0 THEN 0.9 ELSE 0.7 END AS confidence, CASE WHEN p_size % 5 = 0 THEN 0 ELSE 1 END AS enabled FROM part)
SELECT wrong, correct, category, CAST(confidence AS DOUBLE) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY wrong ORDER BY confidence DESC, correct) AS r FROM c WHERE enabled = 1 AND wrong <> correct AND NOT contains(correct, wrong)) WHERE r = 1"""))
def cor_lexicon_load(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("wrong"), F.col("p_type").alias("correct"), F.lit("x").alias("category"), F.when(F.col("p_size") % 3 == 0, 0.9).otherwise(0.7).alias("confidence"), F.when(F.col("p_size") % 5 == 0, 0).otherwise(1).alias("enabled"))
    return D.load_pairs(p)


@query(sql(f"SELECT w AS word, count(*) AS n, count(DISTINCT t.id) AS docs FROM (SELECT id, unnest({_T}) AS w FROM docs) t JOIN (SELECT DISTINCT unnest(regexp_extract_all(lower(phrase), '[\\p{{L}}\\p{{N}}]+')) AS word FROM phrases) ON word = w WHERE length(w) >= 6 GROUP BY 1"))
def join_substring(spark, sf):
    t = documents(spark, sf).select("id", F.explode(T.tokens(F.col("content"))).alias("word"))
    terms = phrases(spark, sf).select(F.explode(T.tokens(F.col("phrase"))).alias("word")).where(F.length("word") >= 6).distinct()
    return t.join(terms, "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("docs"))


@query(sql("""a AS (SELECT event_id, user_id, epoch(ts) AS s, epoch(ts) + 600 AS e FROM events WHERE event_id % 2 = 0), b AS (SELECT event_id AS other, user_id, epoch(ts) AS s, epoch(ts) + 600 AS e FROM events WHERE event_id % 2 = 1)
SELECT event_id, other FROM a JOIN b USING (user_id) WHERE a.s < b.e AND b.s < a.e"""))
def join_interval_overlap(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", F.expr("cast(cast(ts as timestamp) as double)").alias("s")).withColumn("e", F.col("s") + 600)
    # bins of the spans' length: two spans that overlap share a bin, counted where the later one starts
    bins = e.withColumn("bin", F.explode(F.sequence(F.floor(F.col("s") / 600), F.floor(F.col("e") / 600))))
    a, b = bins.where("event_id % 2 = 0"), bins.where("event_id % 2 = 1").select(F.col("event_id").alias("other"), "user_id", F.col("s").alias("s2"), F.col("e").alias("e2"), "bin")
    return a.join(b, ["user_id", "bin"]).where("s < e2 and s2 < e and bin = floor(greatest(s, s2) / 600)").select("event_id", "other")


@query()
def src_html(spark, sf):
    p = table(spark, sf, "pages").select("page_id", P.parsed(F.lit("page.html"), F.col("html")).alias("p"))
    return p.select("page_id", "p.ok", "p.title", F.size("p.blocks").alias("blocks"), F.sha2(F.array_join(F.transform("p.blocks", lambda b: b["text"]), "\n"), 256).alias("text_hash"))


@query()
def src_web_extract(spark, sf):
    t = table(spark, sf, "pages")
    return t.select("page_id", P.page_title(F.col("html")).alias("title"), F.length(P.web_text(F.col("html"))).alias("chars"))


@query(sql(r"SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '(?i)<a\s[^>]*href=')) AS links FROM pages"))
def src_links(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), F.regexp_count("html", F.lit(r"(?i)<a\s[^>]*href=")).cast("long").alias("links"))


@query(sql("SELECT path, CASE WHEN starts_with(path, '/en/1') THEN true WHEN starts_with(path, '/en/') THEN false WHEN starts_with(path, '/de') THEN false ELSE true END AS allowed FROM (SELECT DISTINCT regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages)"))
def src_robots(spark, sf):
    lines = ["User-agent: *", "Disallow: /en/", "Allow: /en/1", "Disallow: /de # all", ""]
    rules = P.robots_rules(spark.createDataFrame(list(enumerate(lines)), "no int, line string")).where("agent = '*'")
    paths = table(spark, sf, "pages").select(F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1).alias("path")).distinct()
    return P.robots_allow(paths, rules)


@query(sql("SELECT conv_id, turn, CASE WHEN contains(lower(text), 'however') THEN 'turn' WHEN contains(lower(text), 'the') THEN 'evidence' WHEN contains(lower(text), 'a') THEN 'claim' ELSE 'other' END AS role_kind FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations)"))
def fn_sentence_role(spark, sf):
    t = F.lower(F.coalesce("text", F.lit("")))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.when(t.contains("however"), "turn").when(t.contains("the"), "evidence").when(t.contains("a"), "claim").otherwise("other").alias("role_kind"))


@query(sql("SELECT event_type, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"))
def ext_tumbling_window(spark, sf):
    e = table(spark, sf, "events")
    w = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select("event_type", F.floor(F.expr("cast(cast(w.start as timestamp) as double)") / 3600).alias("hour"), "n", "total")


@query(sql("""s AS (SELECT user_id, event_id, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= 1800 THEN 1 ELSE 0 END AS new, ts FROM events),
g AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM s) SELECT user_id, count(*) AS n FROM g GROUP BY user_id, grp"""))
def ext_session_window(spark, sf):
    return table(spark, sf, "events").groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", "n")


@query()
def win_greedy_nonoverlap(spark, sf):
    e = table(spark, sf, "events").select("user_id", (F.col("event_id") % 200).alias("start"), (F.col("event_id") % 200 + 1 + F.col("event_id") % 7).alias("end"), (F.col("event_id") % 10 / 10.0).alias("confidence"), "event_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        hits = [(int(r.start), int(r.end), str(r.event_id), "", "rule", float(r.confidence)) for r in pdf.sort_values("event_id").itertuples()]
        kept = D.resolve(hits)
        return pd.DataFrame([(pdf["user_id"].iloc[0], int(h[2]), h[0], h[1]) for h in kept], columns=["user_id", "event_id", "start", "end"])

    return e.groupBy("user_id").applyInPandas(run, "user_id long, event_id long, start int, end int")


@query(sql("SELECT id, n, CASE WHEN n < 1024 THEN n || ' B' ELSE printf('%.1f KB', n / 1024.0) END AS size FROM (SELECT id, CAST(strlen(content) AS BIGINT) AS n FROM docs)"))
def fn_human_size(spark, sf):
    return documents(spark, sf).select("id", F.octet_length("content").cast("long").alias("n")).select("id", "n", T.human_size(F.col("n")).alias("size"))


@query(sql("SELECT id, sha256(translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789 ', 'ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ０１２３４５６７８９　')) AS wide, sha256(content) AS back FROM (SELECT id, regexp_replace(content, '[^A-Za-z0-9 ]', '', 'g') AS content FROM docs)"))
def fn_width(spark, sf):
    d = documents(spark, sf).select("id", F.regexp_replace("content", "[^A-Za-z0-9 ]", "").alias("content"))
    wide = T.to_full_width(F.col("content"))
    return d.select("id", F.sha2(wide, 256).alias("wide"), F.sha2(T.to_half_width(wide), 256).alias("back"))


@query(sql("SELECT id, CAST(length(substr(content, 1, 500)) - length(replace(substr(content, 1, 500), chr(10), '')) + 1 AS INTEGER) AS paragraph FROM docs"))
def fn_paragraph_no(spark, sf):
    return documents(spark, sf).select("id", T.paragraph_no(F.col("content"), F.lit(500)).alias("paragraph"))


@query(sql("SELECT lang, CASE WHEN conf >= 0.85 THEN 'high' WHEN conf >= 0.55 THEN 'middle' ELSE 'low' END AS band, count(*) AS n FROM (SELECT lang, (doc_id % 10) / 10.0 AS conf FROM documents) GROUP BY 1, 2"))
def agg_hits_by_category(spark, sf):
    c = F.col("doc_id") % 10 / 10.0
    return table(spark, sf, "documents").groupBy("lang", F.when(c >= 0.85, "high").when(c >= 0.55, "middle").otherwise("low").alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(sql("SELECT d AS doc_id, i AS run_start, n FROM (SELECT user_id AS d, min(event_id) AS i, count(*) AS n FROM (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = 'view' THEN 0 ELSE 1 END AS brk FROM events)) GROUP BY user_id, g)"))
def win_merge_lines(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf, "events").withColumn("brk", F.when(F.lag("event_type").over(w) == "view", 0).otherwise(1)).withColumn("g", F.sum("brk").over(w))
    return e.groupBy("user_id", "g").agg(F.min("event_id").alias("run_start"), F.count(F.lit(1)).alias("n")).select(F.col("user_id").alias("doc_id"), "run_start", "n")
