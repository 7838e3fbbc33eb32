"""Queries of pairs, gates, marks, ordinals, verdicts and provenance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import detect as D
from ..operators import quality as Q
from ..operators import similarity as M
from ..session import table
from .catalog import catalog
from .text_plans import _METRICS
from .views import documents, register, sql, words

query, QUERIES, SQL = catalog()

_PAIRS = "p AS (SELECT p_partkey AS id, p_brand AS wrong, p_type AS correct, CASE p_size % 3 WHEN 0 THEN 'base' WHEN 1 THEN 'user' ELSE '' END AS source, p_size % 5 <> 0 AS enabled FROM part)"


def _pairs(spark, sf):
    source = F.when(F.col("p_size") % 3 == 0, "base").when(F.col("p_size") % 3 == 1, "user").otherwise("")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("wrong"), F.col("p_type").alias("correct"), source.alias("source"), (F.col("p_size") % 5 != 0).alias("enabled"))


@query(sql(_PAIRS + " SELECT id, wrong, correct FROM p WHERE contains(wrong, '1') OR contains(correct, 'STEEL') ORDER BY wrong, correct, id LIMIT 60 OFFSET 20"))
def flt_error_pairs(spark, sf):
    """A page of the pairs whose wrong or right side has a keyword."""
    hit = F.col("wrong").contains("1") | F.col("correct").contains("STEEL")
    return _pairs(spark, sf).where(hit).orderBy("wrong", "correct", "id").offset(20).limit(60).select("id", "wrong", "correct")


@query(sql(_PAIRS + " SELECT source, count(*) AS n, count(*) FILTER (WHERE enabled) AS on_, count(*) FILTER (WHERE NOT enabled) AS off_ FROM p GROUP BY source"))
def agg_pair_count_by(spark, sf):
    return _pairs(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if("enabled").alias("on_"), F.count_if(~F.col("enabled")).alias("off_"))


@query(sql("SELECT id, title FROM docs WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1)"))
def flt_in_chunks(spark, sf):
    """Rows whose id is in a list of any length: a semi-join instead of lists in chunks."""
    ids = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return documents(spark, sf).join(ids, "id", "left_semi").select("id", "title")


@query(sql("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 7 ELSE CAST(event_id % 13 AS INTEGER) END AS page_size, event_id % 5 <> 0 AND event_id % 2 = 0 AS shown FROM events"))
def flt_projection_meta(spark, sf):
    """Settings from JSON; a value that is missing or unreadable takes its default."""
    e = F.col("event_id")
    raw = F.when(e % 5 == 0, F.lit("{not json")).otherwise(F.concat(F.lit('{"page_size": '), (e % 13).cast("string"), F.when(e % 2 == 0, F.lit(', "shown": true}')).otherwise(F.lit("}"))))
    x = table(spark, sf, "events").select("event_id", F.from_json(raw, "page_size int, shown boolean").alias("x"))
    return x.select("event_id", F.coalesce("x.page_size", F.lit(7)).alias("page_size"), F.coalesce("x.shown", F.lit(False)).alias("shown"))


@query(sql("SELECT l.doc_id AS id, coalesce(d.title, '') AS title, coalesce(d.category, '?') AS category, n_name AS place FROM labels l LEFT JOIN docs d ON d.id = l.doc_id LEFT JOIN nation ON n_nationkey = l.doc_id % 30"))
def join_hash_lookup(spark, sf):
    """Titles, categories and names looked up by id; what has none keeps a default."""
    names = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("place"))
    x = table(spark, sf, "labels").select(F.col("doc_id").alias("id")).withColumn("key", F.col("id") % 30)
    x = x.join(documents(spark, sf).select("id", "title", "category"), "id", "left").join(names, "key", "left")
    return x.select("id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("category", F.lit("?")).alias("category"), "place")


@query(sql(r"SELECT id, contains(head, chr(0)) OR length(regexp_replace(head, '[^\x00-\x08\x0E-\x1F\x{FFFD}]', '', 'g')) * 10 > length(head) AS binary FROM (SELECT id, CASE WHEN id % 9 = 0 THEN chr(1) || chr(2) || substr(content, 1, 15) ELSE substr(content, 1, 4096) END AS head FROM docs)"))
def fn_binary_gate(spark, sf):
    head = F.when(F.col("id") % 9 == 0, F.concat(F.lit("\x01\x02"), F.substring("content", 1, 15))).otherwise(F.col("content"))
    return documents(spark, sf).select("id", T.looks_binary(head).alias("binary"))


@query(sql("SELECT id, sha256(replace(replace(replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), 'loser', '<mark class=\"lexicon\" title=\"rival\">loser</mark>'), 'scum', '<mark class=\"style\" title=\"foam\">scum</mark>')) AS hash FROM docs WHERE contains(content, 'loser') OR contains(content, 'scum')"))
def cor_mark_html(spark, sf):
    """Documents with hits as HTML: escaped, each hit in a mark of its category with the suggestion as its title."""
    d = documents(spark, sf)
    hits = D.check_documents(d, D.Rules(pairs=[D.Pair("loser", "rival"), D.Pair("scum", "foam", "style", 0.9)], repeats=False))
    return D.marked_html(hits, d).select("id", F.sha2("html", 256).alias("hash"))


@query(sql("SELECT id, sha256(replace(replace(content, 'loser', 'rival'), 'stupid', 'unwise')) AS after FROM docs WHERE contains(content, 'loser') OR contains(content, 'stupid')"))
def cor_apply_category(spark, sf):
    """All certain hits of one category accepted at once; other categories and uncertain hits stay."""
    pairs = [D.Pair("loser", "rival"), D.Pair("stupid", "unwise", "lexicon", 0.95), D.Pair("scum", "foam", "style", 0.9), D.Pair("moron", "person", "lexicon", 0.55)]
    d = documents(spark, sf)
    hits = D.check_documents(d, D.Rules(pairs=pairs, repeats=False)).where("category = 'lexicon' and confidence >= 0.85")
    return D.apply_plan(D.plan(hits, d), d).where("applied > 0").select("id", F.sha2("content", 256).alias("after"))


_SPANS = r"""https?://[^\s<>"”》]+|[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}|《[^《》\n]*》|“[^“”\n]*”|"[^"\n]*"|`[^`\n]*`|[0-9]+(?:\.[0-9]+)?(?:%|km|kg|元|年|月|日)"""


@query(sql("SELECT id, unnest(regexp_extract_all(content, '" + _SPANS.replace("'", "''") + "')) AS span FROM docs"))
def cor_protected(spark, sf):
    """Spans that corrections leave alone: links, addresses, titles, quotations, code, quantities with units."""
    return documents(spark, sf).select("id", F.explode(D.protected_spans(F.col("content"))).alias("span"))


@query(sql("SELECT id, doc_no, replace(replace(doc_no, '号', '號'), '发', '發') AS traditional FROM reg"))
def fn_s2t(spark, sf):
    """Characters by a dictionary; those it does not have stay."""
    return register(spark, sf).select("id", "doc_no", T.by_dictionary(F.col("doc_no"), {"号": "號", "发": "發"}).alias("traditional"))


@query(sql("SELECT a.word AS short, b.word AS long FROM words a JOIN words b ON length(a.word) >= 3 AND length(b.word) > length(a.word) AND length(b.word) - length(a.word) <= 4 AND substr(a.word, 1, 2) = substr(b.word, 1, 2) AND right(a.word, 1) = right(b.word, 1) AND NOT starts_with(b.word, a.word) AND regexp_matches(b.word, '^' || array_to_string(string_split(a.word, ''), '.*') || '$')"))
def sim_entity_variant(spark, sf):
    """Short forms of names beside the long ones, met by their first two characters and the last."""
    w = words(spark, sf).where(F.length("word") >= 3).select("word", F.concat(F.substring("word", 1, 2), F.substring("word", -1, 1)).alias("k"))
    j = w.select(F.col("word").alias("short"), "k").join(w.select(F.col("word").alias("long"), "k"), "k")
    return j.where(M.is_variant(F.col("short"), F.col("long"))).select("short", "long")


_MARKED = "m AS (SELECT id, CASE WHEN id % 5 = 0 THEN content ELSE '# ' || title || chr(10) || '@TAGS ' || category || '| ' || file_type || chr(10) || content END AS raw FROM docs)"


@query(sql(_MARKED + r", c AS (SELECT id, raw, CASE WHEN starts_with(raw, '# ') THEN trim(substr(split_part(raw, chr(10), 1), 3), ' ') ELSE '' END AS title FROM m), t AS (SELECT id, title, CASE WHEN title <> '' AND starts_with(split_part(raw, chr(10), 2), '@TAGS ') THEN list_transform(string_split(substr(split_part(raw, chr(10), 2), 7), '|'), lambda x: trim(x, ' ')) ELSE [] END AS tags, raw FROM c) SELECT id, title, array_to_string(tags, ',') AS tags, title = '' AS rejected FROM t"))
def src_material_txt(spark, sf):
    """Material files: a title line, a line of tags, the body; a file without title is rejected."""
    raw = F.when(F.col("id") % 5 == 0, F.col("content")).otherwise(F.concat(F.lit("# "), "title", F.lit("\n@TAGS "), "category", F.lit("| "), "file_type", F.lit("\n"), "content"))
    m = documents(spark, sf).select("id", T.material(raw).alias("m"))
    return m.select("id", "m.title", F.array_join("m.tags", ",").alias("tags"), (F.col("m.title") == "").alias("rejected"))


_NUMBERED = "n AS (SELECT user_id, event_id, CAST(event_id % 4 AS INTEGER) AS level, CAST(floor(value) AS INTEGER) % 6 + 1 AS no FROM events)"


@query(sql(_NUMBERED + """, l AS (SELECT *, lag(no) OVER (PARTITION BY user_id, level ORDER BY event_id) AS before FROM n),
h AS (SELECT *, CASE WHEN no = before THEN 'repeated' WHEN no > before + 1 THEN 'skipped' WHEN no < before AND no <> 1 THEN 'reversed' END AS hint FROM l)
SELECT user_id, event_id, level, hint FROM (SELECT *, row_number() OVER (PARTITION BY user_id, level ORDER BY event_id) AS r FROM h WHERE hint IS NOT NULL) WHERE r <= 3"""))
def win_layer_hints(spark, sf):
    """Numbers of each level in order: skipped, repeated, reversed; a restart at one is allowed; three hints a level at most."""
    n = table(spark, sf, "events").select("user_id", "event_id", (F.col("event_id") % 4).cast("int").alias("level"), (F.floor("value").cast("int") % 6 + 1).alias("no"))
    w = Window.partitionBy("user_id", "level").orderBy("event_id")
    before = F.lag("no").over(w)
    n = n.withColumn("hint", F.when(F.col("no") == before, "repeated").when(F.col("no") > before + 1, "skipped").when((F.col("no") < before) & (F.col("no") != 1), "reversed"))
    return n.where("hint is not null").withColumn("r", F.row_number().over(w)).where("r <= 3").select("user_id", "event_id", "level", "hint")


@query(sql(_NUMBERED + """, k AS (SELECT *, sum(CASE WHEN level = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS parent FROM n)
SELECT user_id, parent, count(DISTINCT no) AS expected, max(no) AS last, max(no) <> count(DISTINCT no) AS issue FROM k WHERE level = 1 GROUP BY user_id, parent"""))
def win_ordinal_issues(spark, sf):
    """Numbers below each heading: the last should be how many different ones there are; a new heading starts anew."""
    n = table(spark, sf, "events").select("user_id", "event_id", (F.col("event_id") % 4).cast("int").alias("level"), (F.floor("value").cast("int") % 6 + 1).alias("no"))
    parent = F.sum(F.when(F.col("level") == 0, 1).otherwise(0)).over(Window.partitionBy("user_id").orderBy("event_id"))
    k = n.withColumn("parent", parent).where("level = 1").groupBy("user_id", "parent").agg(F.countDistinct("no").alias("expected"), F.max("no").alias("last"))
    return k.withColumn("issue", F.col("last") != F.col("expected"))


@query(sql(_METRICS + """, v AS (SELECT id, unnest([{'metric': 'mean_sentence', 'v': mean_sentence, 'lo': 20.0, 'hi': 60.0, 'hard': true}, {'metric': 'mean_paragraph', 'v': mean_paragraph, 'lo': 40.0, 'hi': 400.0, 'hard': false}, {'metric': 'commas_permille', 'v': commas_permille, 'lo': 5.0, 'hi': 25.0, 'hard': false}]) AS x FROM met)
SELECT id, CASE WHEN bool_or(x.hard AND NOT (x.v BETWEEN x.lo AND x.hi)) THEN 'no' WHEN count(*) FILTER (WHERE NOT (x.v BETWEEN x.lo AND x.hi)) > 0 THEN 'in part' ELSE 'yes' END AS verdict, count(*) FILTER (WHERE x.v BETWEEN x.lo AND x.hi) AS fits,
  coalesce(string_agg(x.metric, ',' ORDER BY x.metric) FILTER (WHERE NOT (x.v BETWEEN x.lo AND x.hi)), '') AS outside FROM v GROUP BY id"""))
def txt_verdict(spark, sf):
    """Whether a text fits a genre's ranges: a hard one outside is a no, a soft one a part."""
    ranges = [("mean_sentence", 20.0, 60.0, True), ("mean_paragraph", 40.0, 400.0, False), ("commas_permille", 5.0, 25.0, False)]
    return Q.verdict(Q.style_metrics(documents(spark, sf)), ranges)


@query(sql("""i AS (SELECT conv_id, turn, conv_id % 700 * 2 AS doc_id FROM conversations)
SELECT conv_id, turn, i.doc_id, d.title, d.id IS NOT NULL AS found FROM i LEFT JOIN docs d ON d.id = i.doc_id AND d.deleted_time = ''"""))
def txt_sources(spark, sf):
    """Where compiled material comes from: a row for each input place, found or not."""
    i = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", (F.col("conv_id") % 700 * 2).alias("doc_id")))).alias("slots"))
    i = i.select("conv_id", F.explode("slots").alias("s")).select("conv_id", "s.turn", "s.doc_id")
    live = documents(spark, sf).where("deleted_time = ''").select(F.col("id").alias("doc_id"), "title", F.lit(True).alias("hit"))
    return i.join(live, "doc_id", "left").select("conv_id", "turn", "doc_id", "title", F.coalesce("hit", F.lit(False)).alias("found"))
