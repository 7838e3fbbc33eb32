"""Queries over the registers (dispatch and receive ledgers)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ledger as L
from .catalog import catalog
from .views import register, sql

query, QUERIES, SQL = catalog()
COLUMNS = ["id", "doc_no", "title", "org", "status", "sign_date"]


@query(sql("SELECT id, doc_no, title, org, status, sign_date FROM reg WHERE (doc_no LIKE '%1_0%' OR title LIKE '%1_0%' OR org LIKE '%1_0%') AND status = 'F' AND sign_date >= '1993-01-01' ORDER BY sign_date DESC, id DESC LIMIT 5000"))
def flt_dispatch(spark, sf):
    return L.list_register(register(spark, sf), keyword="1_0", keyword_columns=["doc_no", "title", "org"], status="F", date_from="1993-01-01").select(*COLUMNS)


@query(sql("SELECT id, doc_no, title, org, status, sign_date FROM reg WHERE (sign_date LIKE '1996%' OR doc_no LIKE '%〔1996〕%') AND doc_type = '1-URGENT' ORDER BY receive_date DESC, id DESC LIMIT 500"))
def flt_receive(spark, sf):
    return L.list_register(register(spark, sf), date="receive_date", year="1996", doc_type="1-URGENT", limit=500).select(*COLUMNS)


@query(sql("SELECT max(id) AS id, doc_id FROM reg WHERE doc_id > 0 AND doc_id <> id GROUP BY doc_id"))
def flt_latest(spark, sf):
    return register(spark, sf).where("doc_id > 0 and doc_id <> id").groupBy("doc_id").agg(F.max("id").alias("id"))


@query(sql("SELECT id, due_date FROM reg WHERE due_date <> '' AND done_date = '' AND status NOT IN ('F') AND due_date <= '1998-01-04' ORDER BY due_date, id"))
def flt_pending_due(spark, sf):
    return L.pending_due(register(spark, sf), "1998-01-01", 3, ("F",)).select("id", "due_date")


@query(sql("SELECT id, coalesce(nullif(done_date, ''), receive_date) AS closed FROM reg WHERE done_date <> '' AND archive_no = ''"))
def flt_archivable(spark, sf):
    return register(spark, sf).where("done_date <> '' and archive_no = ''").select("id", F.coalesce(F.nullif("done_date", F.lit("")), "receive_date").alias("closed"))


def _stats(column):
    return sql(f"SELECT coalesce(nullif({column}, ''), '未填写') AS name, count(*) AS n, round(count(*) * 100.0 / greatest(1, sum(count(*)) OVER ()), 1) AS share FROM reg GROUP BY 1")


@query(_stats("org"))
def agg_dispatch_stats(spark, sf):
    return L.group_stats(register(spark, sf), "org")


@query(_stats("retention"))
def agg_retention(spark, sf):
    return L.group_stats(register(spark, sf), "retention")


@query(sql("SELECT coalesce(nullif(doc_type, ''), '未填写') AS name, count(*) AS n, round(count(*) * 100.0 / greatest(1, sum(count(*)) OVER ()), 1) AS share FROM reg WHERE (sign_date LIKE '1995%' OR doc_no LIKE '%〔1995〕%') GROUP BY 1"))
def agg_receive_stats(spark, sf):
    return L.group_stats(register(spark, sf), "doc_type", year="1995")


@query(sql("SELECT name, n FROM (SELECT coalesce(nullif(org, ''), '未填写') AS name, count(*) AS n FROM reg GROUP BY 1) ORDER BY n DESC, name LIMIT 12"))
def agg_top_groups(spark, sf):
    return L.group_stats(register(spark, sf), "org").select("name", "n").orderBy(F.desc("n"), "name").limit(12)


@query(sql("SELECT DISTINCT 'type' AS kind, doc_type AS value FROM reg WHERE trim(doc_type) <> '' UNION SELECT DISTINCT 'org', org FROM reg WHERE trim(org) <> '' UNION SELECT DISTINCT 'year', substr(sign_date, 1, 4) FROM reg"))
def agg_filter_options(spark, sf):
    r = register(spark, sf)
    kinds = F.array(F.struct(F.lit("type").alias("kind"), F.col("doc_type").alias("value")), F.struct(F.lit("org").alias("kind"), F.col("org").alias("value")), F.struct(F.lit("year").alias("kind"), F.substring("sign_date", 1, 4).alias("value")))
    return r.select(F.explode(kinds).alias("x")).select("x.kind", "x.value").where("trim(value) <> ''").distinct()


@query(sql("SELECT CAST(m.m AS INTEGER) AS month, count(id) AS n FROM range(1, 13) AS m(m) LEFT JOIN reg ON sign_date LIKE '1997%' AND CAST(substr(sign_date, 6, 2) AS INTEGER) = m.m GROUP BY 1"))
def agg_monthly(spark, sf):
    return L.monthly(register(spark, sf), "1997")


@query(sql("SELECT DISTINCT substr(sign_date, 1, 4) AS year FROM reg"))
def agg_years(spark, sf):
    return L.years(register(spark, sf))


@query(sql("""SELECT CASE grouping(status, doc_type, org) WHEN 3 THEN 'status' WHEN 5 THEN 'doc_type' WHEN 6 THEN 'org' ELSE 'all' END AS dimension, coalesce(status, doc_type, org, '') AS name, count(*) AS n,
  CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(copies) AS BIGINT) AS copies FROM reg GROUP BY GROUPING SETS ((status), (doc_type), (org), ())"""))
def agg_ledger_summary(spark, sf):
    return L.summary(register(spark, sf))


@query(sql("SELECT regexp_extract(x, '〔(\\d{4})〕', 1) AS year, max(CAST(regexp_extract(x, '〕(\\d+)号', 1) AS INTEGER)) AS max_serial FROM (SELECT unnest(regexp_extract_all(doc_no, '〔\\d{4}〕\\d{1,9}号')) AS x FROM reg) GROUP BY 1".replace("\\\\", "\\")))
def agg_max_serial(spark, sf):
    return L.max_serial(register(spark, sf))


@query(sql("""used AS (SELECT strftime(day, '%Y') AS year, max(o_orderkey) AS last FROM reg0 GROUP BY 1),
new AS (SELECT c_custkey AS id, CAST(1992 + c_custkey % 9 AS VARCHAR) AS year FROM customer)
SELECT id, 'GW' AS prefix, year, CAST(coalesce(last, 0) + row_number() OVER (PARTITION BY year ORDER BY id) AS INTEGER) AS serial FROM new LEFT JOIN used USING (year)"""))
def win_next_no(spark, sf):
    new = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("id"), F.lit("GW").alias("prefix"), (1992 + F.col("c_custkey") % 9).cast("string").alias("year"))
    return L.next_numbers(register(spark, sf), new)


@query(sql("""have AS (SELECT substr(archive_no, 3, 4) AS year, max(CAST(substr(archive_no, 8) AS INTEGER)) AS last FROM reg WHERE archive_no <> '' GROUP BY 1)
SELECT id, substr(receive_date, 1, 4) AS year, 'AR' || substr(receive_date, 1, 4) || '-' || lpad(CAST(coalesce(last, 0) + row_number() OVER (PARTITION BY substr(receive_date, 1, 4) ORDER BY id) AS VARCHAR), 4, '0') AS archive_no
FROM reg LEFT JOIN have ON have.year = substr(receive_date, 1, 4) WHERE archive_no = '' AND done_date <> ''"""))
def win_archive_no(spark, sf):
    return L.archive_numbers(register(spark, sf), "AR", "2024")


@query(sql("SELECT id, CASE WHEN status = 'F' OR due_date = '' THEN NULL ELSE CAST(date_diff('day', DATE '1998-01-01', CAST(due_date AS DATE)) AS INTEGER) END AS days FROM (SELECT * FROM reg WHERE due_date <> '' UNION ALL SELECT * REPLACE (NULL AS due_date) FROM reg WHERE due_date = '')"))
def fn_days_left(spark, sf):
    return register(spark, sf).select("id", T.days_left(F.col("due_date"), F.lit("1998-01-01"), F.col("status") == "F").alias("days"))


@query(sql("""SELECT id, list_filter([CASE WHEN print_date <> '' AND print_date < sign_date THEN 'print_date: before sign_date' END, CASE WHEN pages < 0 THEN 'pages: negative' END, CASE WHEN copies < 0 THEN 'copies: negative' END], lambda x: x IS NOT NULL) AS problems FROM reg
WHERE (print_date <> '' AND print_date < sign_date) OR copies < 0"""))
def fn_validate_dispatch(spark, sf):
    return L.validate(register(spark, sf))


@query(sql("SELECT id, 'GW' AS prefix, substr(sign_date, 1, 4) AS year, CAST(id AS INTEGER) AS serial FROM reg"))
def fn_parse_doc_no(spark, sf):
    return register(spark, sf).select("id", T.parse_doc_no(F.col("doc_no")).alias("p")).select("id", "p.*")


@query(sql("SELECT id, CASE WHEN id % 4 = 0 THEN sign_date WHEN id % 4 = 1 THEN substr(sign_date, 1, 4) || '-01-01' WHEN id % 4 = 2 THEN sign_date ELSE '' END AS date FROM reg"))
def fn_normalize_date(spark, sf):
    d = F.col("sign_date").cast("date")
    raw = F.when(F.col("id") % 4 == 0, F.concat(F.year(d).cast("string"), F.lit("年"), F.month(d).cast("string"), F.lit("月"), F.day(d).cast("string"), F.lit("日")))
    raw = raw.when(F.col("id") % 4 == 1, F.concat(F.year(d).cast("string"), F.lit("年"))).when(F.col("id") % 4 == 2, F.date_format(d, "yyyy.M.d")).otherwise(F.concat(F.year(d).cast("string"), F.lit("-02-30")))
    return register(spark, sf).select("id", T.normalize_date(raw).alias("date"))


@query(sql("SELECT year, round(avg(CAST(pages AS DOUBLE)), 6) AS pages, sum(CASE WHEN done_date = '' AND due_date <> '' AND due_date < '1998-01-01' THEN 1 ELSE 0 END) AS overdue FROM (SELECT *, substr(sign_date, 1, 4) AS year FROM reg) GROUP BY year"))
def agg_overdue(spark, sf):
    late = (F.col("done_date") == "") & (F.col("due_date") != "") & (F.col("due_date") < "1998-01-01")
    return register(spark, sf).groupBy(F.substring("sign_date", 1, 4).alias("year")).agg(F.round(F.avg(F.col("pages").cast("double")), 6).alias("pages"), F.count(F.when(late, 1)).alias("overdue"))


@query(sql("SELECT row_number() OVER (ORDER BY archive_no, id) AS no, id, archive_no, title, retention FROM reg WHERE archive_no <> ''"))
def snk_archive_manifest(spark, sf):
    return register(spark, sf).where("archive_no <> ''").select(F.row_number().over(Window.orderBy("archive_no", "id")).cast("long").alias("no"), "id", "archive_no", "title", "retention")


@query(sql("SELECT id, CASE WHEN copies = -1 THEN '=1+1' WHEN copies = 0 THEN '-5' WHEN copies = 1 THEN '@x' ELSE title END AS raw, CASE WHEN copies = -1 THEN '''=1+1' WHEN copies = 0 THEN '-5' WHEN copies = 1 THEN '''@x' ELSE title END AS safe FROM reg"))
def snk_csv(spark, sf):
    raw = F.when(F.col("copies") == -1, "=1+1").when(F.col("copies") == 0, "-5").when(F.col("copies") == 1, "@x").otherwise(F.col("title"))
    return register(spark, sf).select("id", raw.alias("raw"), T.csv_safe(raw).alias("safe"))


@query(sql("SELECT id, CASE WHEN archive_no = '' AND done_date <> '' THEN 'archived' ELSE status END AS status, CASE WHEN archive_no = '' AND done_date <> '' THEN coalesce(nullif(retention, ''), 'Y30') ELSE retention END AS retention FROM reg"))
def dml_archive_batch(spark, sf):
    due = (F.col("archive_no") == "") & (F.col("done_date") != "")
    return register(spark, sf).select("id", F.when(due, "archived").otherwise(F.col("status")).alias("status"), F.when(due, F.coalesce(F.nullif("retention", F.lit("")), F.lit("Y30"))).otherwise(F.col("retention")).alias("retention"))
