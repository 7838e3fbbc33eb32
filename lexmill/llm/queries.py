"""The registered queries opN_<name> of the operators, with production parameters, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk_search import integer_vectors, top_k

    vectors = integer_vectors(read_table(spark, sf_dir, "embeddings"), F.col("vec_id"), F.col("embedding"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit, held_out, identify

    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    return substring_dedup(read_table(spark, sf_dir, "documents"), window=35).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's candidates, its secrets (masked but for two characters at either end) and the digest of the masked text."""
    from .secret_scan import VOTES, fit, labelled_findings, scan

    found = scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"), fit(labelled_findings(spark)))
    secrets = F.filter("findings", lambda f: f["votes"] > VOTES)
    shown = F.transform(secrets, lambda f: F.concat(F.substring(f["secret"], 1, 2), F.lit("..."), F.substring(f["secret"], -2, 2)))
    return found.select("doc_id", F.size("findings").alias("n_candidates"), F.size(secrets).alias("n_secrets"), shown.alias("secrets"), F.sha2("masked", 256).alias("masked_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, held_out, score_toxicity

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import leaks

    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(read_table(spark, sf_dir, "documents"), percent=75)


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_output import token_output

    return token_output(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import RULES, url_filter

    rules = spark.createDataFrame([(r, v) for v, r in RULES], "rule string, verdict string")
    return url_filter(read_table(spark, sf_dir, "pages"), rules)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import best_fit_packing

    return best_fit_packing(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=0, size=2048, pieces=500_000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_topk_search, op2_language_id, op3_substring_dedup, op4_secret_scan, op5_toxicity, op6_benchmark_decontamination, op7_jaccard_join, op8_token_output, op9_url_filter, op10_best_fit_packing)}

SQL: dict[str, str] = {
    "op1_topk_search": r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * 1024) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10
""",
    "op3_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT rid, i, sha256(array_to_string(w[i:i + 34], ' ')) AS k FROM d, unnest(range(1, len(w) - 33)) AS u(i) WHERE len(w) >= 35),
again AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS p FROM win WHERE k IN (SELECT k FROM again)),
kept AS (
  SELECT d.rid, string_agg(w[u.p], ' ' ORDER BY u.p) AS body, count(*) AS n
  FROM d, unnest(range(1, len(w) + 1)) AS u(p) LEFT JOIN gone ON gone.rid = d.rid AND gone.p = u.p
  WHERE gone.p IS NULL GROUP BY d.rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
""",
    "op9_url_filter": r"""
WITH cut AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fit AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS v
  FROM cut JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM cut LEFT JOIN fit USING (page_id)
""",
}
