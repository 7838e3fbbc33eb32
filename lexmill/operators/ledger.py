"""Registers: filters, statistics, numbering, due dates and archiving."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import parse_doc_no

GROUPABLE = ("doc_type", "org", "secret_level", "urgency", "status", "drafter", "approver", "from_org", "handler_dept", "retention")
UNFILLED = "未填写"


def like_any(keyword: str, columns: list[str]) -> Column:
    """A keyword in any of the columns; % and _ in it are wildcards."""
    return reduce(lambda a, b: a | b, (F.col(c).like(f"%{keyword}%") for c in columns))


def list_register(reg: DataFrame, *, date: str = "sign_date", number: str = "doc_no", keyword: str = "", keyword_columns: list[str] | None = None, year: str = "", date_from: str = "", date_to: str = "", limit: int = 5000, **equal: str) -> DataFrame:
    """Rows that meet all filters given, newest first; dates are compared as ISO strings."""
    out = reg
    if keyword:
        out = out.where(like_any(keyword, keyword_columns or [number, "title"]))
    for k, v in equal.items():
        if v:
            out = out.where(F.col(k) == v)
    if year:
        out = out.where(F.col(date).startswith(year) | F.col(number).contains(f"〔{year}〕"))
    if date_from:
        out = out.where(F.col(date) >= date_from)
    if date_to:
        out = out.where(F.col(date) <= date_to)
    return out.orderBy(F.desc(date), F.desc("id")).limit(limit)


def group_stats(reg: DataFrame, column: str, year: str = "", date: str = "sign_date", number: str = "doc_no") -> DataFrame:
    """(name, n, share) by a groupable column; blank is 未填写; share in percent of all, one decimal."""
    if column not in GROUPABLE:
        raise ValueError(f"no grouping by {column}")
    rows = reg.where(F.col(date).startswith(year) | F.col(number).contains(f"〔{year}〕")) if year else reg
    n = rows.groupBy(F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(UNFILLED)).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") * 100.0 / F.greatest(F.lit(1), F.sum("n").over(Window.partitionBy())), 1))


def monthly(reg: DataFrame, year: str, date: str = "sign_date") -> DataFrame:
    """(month, n) for all twelve months; rows whose month is none are dropped."""
    spark = reg.sparkSession
    n = reg.where(F.col(date).startswith(year)).groupBy(F.substring(date, 6, 2).try_cast("int").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return spark.range(1, 13).select(F.col("id").cast("int").alias("month")).join(F.broadcast(n), "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n"))


def years(reg: DataFrame, date: str = "sign_date") -> DataFrame:
    return reg.where(F.length(date) >= 4).select(F.substring(date, 1, 4).alias("year")).where(F.col("year").rlike(r"^\d{4}$")).distinct()


def summary(reg: DataFrame) -> DataFrame:
    """(dimension, name, n, pages, copies) by status, type and organisation and over all, in one pass of grouping sets."""
    g = reg.groupingSets([["status"], ["doc_type"], ["org"], []], "status", "doc_type", "org").agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"), F.sum("pages").alias("pages"), F.sum("copies").alias("copies"))
    dim = F.when(F.col("gid") == 3, "status").when(F.col("gid") == 5, "doc_type").when(F.col("gid") == 6, "org").otherwise("all")
    return g.select(dim.alias("dimension"), F.coalesce("status", "doc_type", "org", F.lit("")).alias("name"), "n", F.col("pages").cast("long").alias("pages"), F.col("copies").cast("long").alias("copies"))


def pending_due(reg: DataFrame, today: str, days: int, closed: tuple[str, ...]) -> DataFrame:
    """Open rows due until today + days, by due date; a today that is no date gives none."""
    last = F.date_format(F.date_add(F.lit(today).try_cast("date"), days), "yyyy-MM-dd")
    return reg.where((F.col("due_date") != "") & (F.col("done_date") == "") & ~F.col("status").isin(*closed) & (F.col("due_date") <= last)).orderBy("due_date", "id")


def max_serial(reg: DataFrame, number: str = "doc_no") -> DataFrame:
    """(year, max_serial) over every 〔year〕N号 in the numbers."""
    each = reg.select(F.explode(F.regexp_extract_all(number, F.lit(r"〔\d{4}〕\d{1,9}号"), F.lit(0))).alias("x"))
    p = parse_doc_no(F.col("x"))
    return each.groupBy(p["year"].alias("year")).agg(F.max(p["serial"]).alias("max_serial"))


def next_numbers(existing: DataFrame, new: DataFrame) -> DataFrame:
    """new (id, prefix, year) with the serials that follow the greatest in use, whatever brackets it is written in.

    One writer allocates at a time; a batch is numbered as a whole.
    """
    used = existing.select(parse_doc_no(F.col("doc_no")).alias("p")).groupBy(F.col("p.prefix").alias("prefix"), F.col("p.year").alias("year")).agg(F.max("p.serial").alias("last"))
    w = Window.partitionBy("prefix", "year").orderBy("id")
    return new.join(used, ["prefix", "year"], "left").select("id", "prefix", "year", (F.coalesce("last", F.lit(0)) + F.row_number().over(w)).cast("int").alias("serial"))


def archive_numbers(reg: DataFrame, org: str, default_year: str) -> DataFrame:
    """Closed rows without archive number get org + year-NNNN after the year's greatest; the year is of receiving, closing, else the document."""
    of = lambda c: F.when(F.col(c).rlike(r"^\d{4}"), F.substring(c, 1, 4))
    year = F.coalesce(of("receive_date"), of("done_date"), of("doc_date"), F.lit(default_year))
    have = reg.where(F.col("archive_no") != "").select(F.regexp_extract("archive_no", r"(\d{4})-(\d{4,})$", 1).alias("year"), F.regexp_extract("archive_no", r"(\d{4})-(\d{4,})$", 2).try_cast("int").alias("s")).groupBy("year").agg(F.max("s").alias("last"))
    todo = reg.where((F.col("archive_no") == "") & (F.col("done_date") != "")).select("id", year.alias("year"))
    w = Window.partitionBy("year").orderBy("id")
    serial = F.coalesce("last", F.lit(0)) + F.row_number().over(w)
    return todo.join(have, "year", "left").select("id", "year", F.concat(F.lit(org), F.col("year"), F.lit("-"), F.lpad(serial.cast("string"), 4, "0")).alias("archive_no"))


def validate(reg: DataFrame) -> DataFrame:
    """(id, problems): missing fields, dates that are none or out of order, negative counts."""
    bad_date = lambda c: F.when((F.col(c) != "") & F.col(c).try_cast("date").isNull(), F.lit(f"{c}: no date"))
    problems = F.array_compact(F.array(
        F.when(F.trim("title") == "", F.lit("title: missing")),
        F.when(F.trim("doc_no") == "", F.lit("doc_no: missing")),
        bad_date("sign_date"),
        bad_date("print_date"),
        F.when((F.col("sign_date") != "") & (F.col("print_date") != "") & (F.col("print_date") < F.col("sign_date")), F.lit("print_date: before sign_date")),
        F.when(F.col("pages") < 0, F.lit("pages: negative")),
        F.when(F.col("copies") < 0, F.lit("copies: negative")),
    ))
    return reg.select("id", problems.alias("problems")).where(F.size("problems") > 0)
