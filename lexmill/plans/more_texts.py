"""Texts made from the tables, for queries that need writings in Chinese."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, content): a contract of each order."""
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    n, y, m = k % 9 + 1, F.year(d), F.month(d)
    zh = F.concat(y, F.lit("年"), m, F.lit("月"), F.dayofmonth(d), F.lit("日"))
    iso = F.when(k % 3 != 0, F.concat(F.lit("，自"), F.date_format(d, "yyyy-MM-dd"), F.lit("起生效"))).otherwise("")
    cn = F.when(k % 2 == 0, F.concat(F.lit("，其中"), F.substring(F.lit("一二三四五六七八九"), n.cast("int"), F.lit(1)), F.lit("项"), F.lit("已交付"))).otherwise("")
    term = F.when(k % 5 == 0, F.concat(F.lit("。期限："), y, F.lit("年"), m, F.lit("月至"), y - 1, F.lit("年"), m, F.lit("月"))).otherwise("")
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.concat(F.lit("本合同订于"), zh, iso, F.lit("，标的共"), n, F.lit("项"), cn, term, F.lit("。")).alias("content"))
