"""The corpus store's tables as views of the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    return d.select(
        F.col("doc_id").alias("id"), F.substring_index(text, "\n", 1).alias("title"), text.alias("content"), F.col("source").alias("category"),
        F.col("lang").alias("file_type"), F.concat_ws(",", "source", "lang").alias("tags"), F.col("n_chars").alias("word_count"),
        F.when(F.col("doc_id") % 17 == 0, "2024-01-01").otherwise("").alias("deleted_time"),
    )


def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    day = F.to_date("o_orderdate")
    iso = lambda d: F.date_format(d, "yyyy-MM-dd")
    year = F.date_format(day, "yyyy")
    done = F.col("o_orderstatus") == "F"
    rows = o.join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n.select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("GW〔"), year, F.lit("〕"), F.col("o_orderkey").cast("string"), F.lit("号")).alias("doc_no"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"), F.col("o_orderpriority").alias("doc_type"),
        F.when(F.col("o_orderkey") % 13 == 0, "").otherwise(F.col("n_name")).alias("org"), F.col("o_orderstatus").alias("status"), iso(day).alias("sign_date"), iso(day).alias("receive_date"), F.lit("").alias("doc_date"),
        F.when(F.col("o_orderkey") % 2 == 0, iso(F.date_add(day, (F.col("o_orderkey") % 9 - 2).cast("int")))).otherwise("").alias("print_date"),
        (F.col("o_orderkey") % 50).cast("int").alias("pages"), (F.col("o_orderkey") % 7 - 1).cast("int").alias("copies"),
        F.when(F.col("o_orderkey") % 3 != 0, iso(F.date_add(day, 30))).otherwise("").alias("due_date"), F.when(done, iso(F.date_add(day, 10))).otherwise("").alias("done_date"),
        F.when(done & (F.col("o_orderkey") % 11 == 0), F.concat(F.lit("AR"), year, F.lit("-"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 4, "0"))).otherwise("").alias("archive_no"),
        F.when(F.col("o_orderkey") % 5 == 0, "").when(F.col("o_orderkey") % 2 == 0, "Y10").otherwise("Y30").alias("retention"),
        (F.col("o_orderkey") % 1200).alias("doc_id"),
    )


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, word, source): the part names' words with the smallest part key as id."""
    p = table(spark, sf_dir, "part")
    w = p.select("p_partkey", F.explode(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), r"[^a-z0-9]+")).alias("word")).where("word <> ''")
    return w.groupBy("word").agg(F.min("p_partkey").alias("id")).select("id", "word", F.when(F.col("id") % 3 == 0, "user").when(F.col("id") % 3 == 1, "base").otherwise(F.lit(None)).alias("source"))


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.coalesce("text", F.lit("")).alias("phrase"), F.col("role").alias("context"))


CTE = r"""
docs AS (SELECT doc_id AS id, split_part(coalesce(text, ''), chr(10), 1) AS title, coalesce(text, '') AS content, source AS category, lang AS file_type,
  concat_ws(',', source, lang) AS tags, n_chars AS word_count, CASE WHEN doc_id % 17 = 0 THEN '2024-01-01' ELSE '' END AS deleted_time FROM documents),
reg0 AS (SELECT *, CAST(o_orderdate AS DATE) AS day FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
reg AS (SELECT o_orderkey AS id, 'GW〔' || strftime(day, '%Y') || '〕' || o_orderkey || '号' AS doc_no, 'Order ' || o_orderkey AS title, o_orderpriority AS doc_type,
  CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE n_name END AS org, o_orderstatus AS status, strftime(day, '%Y-%m-%d') AS sign_date, strftime(day, '%Y-%m-%d') AS receive_date, '' AS doc_date,
  CASE WHEN o_orderkey % 2 = 0 THEN strftime(day + CAST(o_orderkey % 9 - 2 AS INTEGER), '%Y-%m-%d') ELSE '' END AS print_date,
  CAST(o_orderkey % 50 AS INTEGER) AS pages, CAST(o_orderkey % 7 - 1 AS INTEGER) AS copies,
  CASE WHEN o_orderkey % 3 <> 0 THEN strftime(day + 30, '%Y-%m-%d') ELSE '' END AS due_date, CASE WHEN o_orderstatus = 'F' THEN strftime(day + 10, '%Y-%m-%d') ELSE '' END AS done_date,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 11 = 0 THEN 'AR' || strftime(day, '%Y') || '-' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 4, '0') ELSE '' END AS archive_no,
  CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 2 = 0 THEN 'Y10' ELSE 'Y30' END AS retention, o_orderkey % 1200 AS doc_id FROM reg0),
words AS (SELECT min(p_partkey) AS id, word, CASE min(p_partkey) % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'base' END AS source
  FROM (SELECT p_partkey, unnest(regexp_split_to_array(lower(p_name || ' ' || p_type), '[^a-z0-9]+')) AS word FROM part) WHERE word <> '' GROUP BY word),
phrases AS (SELECT conv_id * 1000 + turn AS id, coalesce(text, '') AS phrase, role AS context FROM conversations)
"""


def sql(body: str) -> str:
    """body with the views before it; WITH RECURSIVE so that a body may define recursive ones (body starts with further CTEs or SELECT)."""
    body = body.strip()
    return f"WITH RECURSIVE {CTE.strip()}\n{', ' + body if not body.upper().startswith('SELECT') else body}"
