"""Queries of full-text search, dictionary tiers and classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import search as S
from .catalog import catalog
from .views import documents, phrases, sql, words

query, QUERIES, SQL = catalog()

_TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


def _bm25(rel: str, text: str, terms: list[str], all_: bool, tag: str = "") -> str:
    """CTEs c{tag}, s{tag} and m{tag}(id, score)."""
    f = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS f{i}" for i, w in enumerate(terms))
    d = ", ".join(f"sum(CASE WHEN f{i} > 0 THEN 1 ELSE 0 END) AS d{i}" for i in range(len(terms)))
    score = " + ".join(f"ln(1 + (nd - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * 2.2 / (f{i} + 1.2 * (1 - 0.75 + 0.75 * n / av))" for i in range(len(terms)))
    cond = (" AND " if all_ else " OR ").join(f"f{i} > 0" for i in range(len(terms)))
    return f"""t{tag} AS (SELECT id, {_TOK.format(text)} AS t FROM {rel}), c{tag} AS (SELECT id, len(t) AS n, {f} FROM t{tag}),
s{tag} AS (SELECT count(*) AS nd, avg(n) AS av, {d} FROM c{tag}), m{tag} AS (SELECT id, {score} AS score FROM c{tag}, s{tag} WHERE {cond})"""


LIVE = "(SELECT * FROM docs WHERE deleted_time = '')"


@query(sql(_bm25(LIVE, "content", ["the", "license"], True) + """, best AS (SELECT * FROM m ORDER BY round(score, 9) DESC, id LIMIT 50)
SELECT id, title, substr(content, greatest(instr(lower(content), 'the') - 20, 1), 80) AS snippet, round(score, 6) AS score FROM docs JOIN best USING (id)"""))
def fts_documents(spark, sf):
    return S.search_documents(documents(spark, sf), "the license", 50)


@query(sql(_bm25(LIVE, "content", ["apache", "idiot"], False) + " SELECT id, round(score, 6) AS score FROM m ORDER BY round(score, 9) DESC, id LIMIT 30"))
def fts_query_or(spark, sf):
    return S.top(S.matches(documents(spark, sf).where("deleted_time = ''"), "Apache idiot", require_all=False), 30).select("id", F.round("score", 6).alias("score"))


@query(sql(_bm25(LIVE, "content", ["the", "of"], True) + " SELECT id, round(score, 6) AS score, (SELECT count(*) FROM m) AS total, (SELECT count(*) FROM m) > 30 AS has_more FROM m ORDER BY round(score, 9) DESC, id LIMIT 20 OFFSET 10"))
def fts_page(spark, sf):
    return S.search_page(documents(spark, sf), "the of", 20, 10)


@query(sql(_bm25("phrases", "phrase", ["the"], True) + " SELECT id, round(score, 6) AS score FROM m ORDER BY round(score, 9) DESC, id LIMIT 20"))
def fts_phrases(spark, sf):
    return S.top(S.matches(phrases(spark, sf), "the", text="phrase"), 20).select("id", F.round("score", 6).alias("score"))


@query(sql("""found AS (SELECT id, word, CASE WHEN word = 're' THEN 0.9 WHEN starts_with(word, 're') THEN 0.8 ELSE 0.7 END AS tier FROM words WHERE contains(word, 're'))
SELECT id, word, CAST(tier AS DOUBLE) AS tier, CAST(row_number() OVER (ORDER BY tier DESC, length(word), word, id) AS INTEGER) AS rank FROM found ORDER BY rank LIMIT 50"""))
def fts_dictionary(spark, sf):
    return S.dictionary_tiers(words(spark, sf), "re", 50)


PARAS = r"""paras AS (SELECT doc_id * 1000 + i AS id, doc_id, CASE WHEN length(p) <= 40 THEN 'heading' ELSE 'paragraph' END AS kind, p AS content
FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS p FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\n') AS l FROM documents WHERE doc_id % 17 <> 0)) WHERE trim(p, ' ') <> '')"""


def paragraphs(spark, sf):
    d = documents(spark, sf).where("deleted_time = ''").select("id", F.posexplode(F.split("content", "\n")))
    return d.where(F.trim("col") != "").select((F.col("id") * 1000 + F.col("pos") + 1).alias("id"), F.col("id").alias("doc_id"), F.when(F.length("col") <= 40, "heading").otherwise("paragraph").alias("kind"), F.col("col").alias("content"))


@query(sql(PARAS + ", " + _bm25("paras", "content", ["the", "ha"], True) + " SELECT m.id, doc_id, round(score, 6) AS score FROM m JOIN paras USING (id) ORDER BY round(score, 9) DESC, m.id LIMIT 20"))
def fts_paragraphs(spark, sf):
    p = paragraphs(spark, sf)
    best = S.top(S.matches(p, "the ha"), 20)
    return p.join(F.broadcast(best), "id").select("id", "doc_id", F.round("score", 6).alias("score"))


@query(sql(PARAS + ", " + _bm25("paras", "content", ["loser", "moron"], True) + ", " + _bm25("paras", "content", ["loser", "moron"], False, "2") + """,
st AS (SELECT *, false AS relaxed FROM (SELECT * FROM m ORDER BY round(score, 9) DESC, id LIMIT 20)),
lo AS (SELECT *, true AS relaxed FROM (SELECT * FROM m2 WHERE id NOT IN (SELECT id FROM st) ORDER BY round(score, 9) DESC, id LIMIT 20) WHERE (SELECT count(*) FROM st) < 5),
al AS (SELECT *, (score - min(score) OVER (PARTITION BY relaxed)) / CASE WHEN max(score) OVER (PARTITION BY relaxed) = min(score) OVER (PARTITION BY relaxed) THEN 1.0 ELSE max(score) OVER (PARTITION BY relaxed) - min(score) OVER (PARTITION BY relaxed) END AS base FROM (SELECT * FROM st UNION ALL SELECT * FROM lo))
SELECT id, round(greatest(CASE WHEN relaxed THEN 0.0 ELSE 0.5 END, least(CASE WHEN relaxed THEN 0.5 ELSE 1.0 END,
  CASE WHEN relaxed THEN base * 0.5 ELSE 0.5 + base * 0.5 END + CASE WHEN kind = 'heading' AND contains(lower(content), 'loser moron') THEN 0.10 ELSE 0.0 END - CASE WHEN length(content) > 400 THEN least(0.10, (length(content) - 400) / 2000.0 * 0.10) ELSE 0.0 END)), 6) AS score, relaxed
FROM al JOIN paras USING (id) ORDER BY relaxed, score DESC, id LIMIT 20"""))
def fts_para_relaxed(spark, sf):
    return S.paragraphs_relaxed(paragraphs(spark, sf), "loser moron", 20)


@query(sql(_bm25(LIVE, "content", ["re"], True) + ", " + _bm25("phrases", "phrase", ["re"], True, "2") + """,
b AS (SELECT 'documents' AS source, id AS ref_id, title, tags, score FROM docs JOIN (SELECT * FROM m ORDER BY round(score, 9) DESC, id LIMIT 40) USING (id)
  UNION ALL SELECT 'phrases', id, phrase, '', score FROM phrases JOIN (SELECT * FROM m2 ORDER BY round(score, 9) DESC, id LIMIT 40) USING (id)),
n AS (SELECT source, ref_id, title, tags, (score - min(score) OVER w) / CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE max(score) OVER w - min(score) OVER w END AS base FROM b WINDOW w AS (PARTITION BY source)),
d AS (SELECT 'dictionary' AS source, id AS ref_id, word AS title, '' AS tags, CASE WHEN word = 're' THEN 0.9 WHEN starts_with(word, 're') THEN 0.8 ELSE 0.7 END AS base FROM words WHERE contains(word, 're')),
e AS (SELECT * FROM n UNION ALL SELECT * FROM d)
SELECT source, ref_id, title, round(least(1.0, base + CASE WHEN contains(lower(title), 're') THEN 0.15 ELSE 0 END
  + CASE WHEN len(list_filter(string_split(tags, ','), lambda t: t <> '' AND (contains(lower(t), 're') OR contains('re', lower(t))))) > 0 THEN 0.10 ELSE 0 END), 6) AS rank
FROM e ORDER BY rank DESC, source, ref_id LIMIT 40"""))
def fts_federated(spark, sf):
    return S.federated(documents(spark, sf), words(spark, sf), phrases(spark, sf), "re", 40)


@query(sql(f"SELECT id, len(t) AS n, len(list_distinct(t)) AS n_distinct FROM (SELECT id, {_TOK.format('content')} AS t FROM docs)"))
def fts_tokenize(spark, sf):
    return documents(spark, sf).select("id", T.tokens(F.col("content")).alias("t")).select("id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


_PROFILE = f"""newest AS (SELECT category, {_TOK.format("title || ' ' || content")} AS t FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY id DESC) AS r FROM docs WHERE deleted_time = '') WHERE r <= 20),
prof AS (SELECT category, term, count(*) AS tf FROM (SELECT category, unnest(t) AS term FROM newest) WHERE length(term) >= 2 AND NOT regexp_matches(term, '^\\d+$') GROUP BY 1, 2),
pr AS (SELECT *, sum(tf) OVER (PARTITION BY category) AS total FROM prof)"""


@query(sql(_PROFILE + " SELECT category, term, tf, CAST(total AS BIGINT) AS total FROM pr"))
def agg_category_profile(spark, sf):
    return S.category_profiles(documents(spark, sf), 20)


@query(sql(_PROFILE + " SELECT category, round(sum(CASE term WHEN 'the' THEN 2 ELSE 1 END * tf / total) / 3, 6) AS score FROM pr WHERE term IN ('the', 'license', 'that') GROUP BY category ORDER BY score DESC, category LIMIT 5"))
def agg_classify_score(spark, sf):
    return S.classify(S.category_profiles(documents(spark, sf), 20), "the license that the", 5)
