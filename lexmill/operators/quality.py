"""Document-level quality: metrics, defects, evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def precision_recall(rows: DataFrame, group: str) -> DataFrame:
    """(group, precision, recall, f05) of rows (truth, pred) of 0 and 1; empty denominators count as 1."""
    n = rows.groupBy(group).agg(F.sum(F.col("truth") * F.col("pred")).alias("tp"), F.sum("pred").alias("p"), F.sum("truth").alias("t"))
    pr, re = F.col("tp") / F.greatest(F.lit(1), "p"), F.col("tp") / F.greatest(F.lit(1), "t")
    return n.select(group, F.round(pr, 6).alias("precision"), F.round(re, 6).alias("recall"), F.round(1.25 * pr * re / F.greatest(F.lit(1e-9), 0.25 * pr + re), 6).alias("f05"))


def count_of(text: Column, rx: str) -> Column:
    return F.regexp_count(text, F.lit(rx))


def style_metrics(docs: DataFrame) -> DataFrame:
    """(id, chars, sentences, mean_sentence, paragraphs, mean_paragraph, commas_permille, quotes, dashes, percents, digits)."""
    t = F.col("content")
    chars = F.length(F.regexp_replace(t, r"[ \t\n\r]", ""))
    sents = F.filter(F.transform(F.split(t, "[.!?;。！？；\n]"), lambda s: F.length(F.trim(s))), lambda n: n >= 4)
    paras = F.filter(F.transform(F.split(t, "\n"), lambda s: F.length(F.trim(s))), lambda n: n > 0)
    mean = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0), lambda x, y: x + y) / F.size(a)).otherwise(0.0)
    return docs.select("id", chars.cast("long").alias("chars"), F.size(sents).cast("long").alias("sentences"), F.round(mean(sents), 6).alias("mean_sentence"), F.size(paras).cast("long").alias("paragraphs"), F.round(mean(paras), 6).alias("mean_paragraph"), F.round(count_of(t, ",") * 1000.0 / F.greatest(F.lit(1), chars), 6).alias("commas_permille"), count_of(t, '"').cast("long").alias("quotes"), count_of(t, "[-—]").cast("long").alias("dashes"), count_of(t, "%").cast("long").alias("percents"), count_of(t, "[0-9]").cast("long").alias("digits"))


def fingerprints(metrics: DataFrame, group: str, keys: list[str]) -> DataFrame:
    """(group, key, p25, median, p75) of the metrics over each group's documents."""
    long = metrics.select(group, F.explode(F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*[F.col(k).cast("double") for k in keys]))).alias("key", "value"))
    q = lambda p: F.round(F.percentile("value", F.lit(p)), 6)
    return long.groupBy(group, "key").agg(q(0.25).alias("p25"), q(0.5).alias("median"), q(0.75).alias("p75"))


def genre_rank(metrics: DataFrame, prints: DataFrame, group: str, keys: list[str]) -> DataFrame:
    """(id, best, distance): the group whose fingerprint is nearest, by the mean of |x - median| / max(p75 - p25, 0.3 |median|, 1)."""
    long = metrics.select("id", F.explode(F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*[F.col(k).cast("double") for k in keys]))).alias("key", "value"))
    d = F.abs(F.col("value") - F.col("median")) / F.greatest(F.col("p75") - F.col("p25"), 0.3 * F.abs(F.col("median")), F.lit(1.0))
    each = long.join(F.broadcast(prints), "key").groupBy("id", group).agg(F.round(F.avg(d), 6).alias("distance"))
    w = Window.partitionBy("id").orderBy("distance", group)
    return each.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("id", F.col(group).alias("best"), "distance")


def defects(docs: DataFrame, longest: int = 1500) -> DataFrame:
    """(id, defects): unbalanced brackets and quotes, overlong paragraphs, control characters."""
    t = F.col("content")
    pairs = [("(", ")"), ("[", "]"), ("（", "）"), ("《", "》"), ("“", "”")]
    n = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    found = [F.when(n(a) != n(b), F.lit(f"unbalanced {a}{b}")) for a, b in pairs]
    found.append(F.when(F.exists(F.split(t, "\n"), lambda p: F.length(p) > longest), F.lit("overlong paragraph")))
    found.append(F.when(t.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"), F.lit("control characters")))
    return docs.select("id", F.array_compact(F.array(*found)).alias("defects")).where(F.size("defects") > 0)


def repeated_phrases(docs: DataFrame, words: int = 4, times: int = 3) -> DataFrame:
    """(id, phrase, n) of word n-grams that a document repeats."""
    from ..functions.text import tokens

    t = docs.select("id", tokens(F.col("content")).alias("t")).where(F.size("t") >= words)
    grams = F.transform(F.sequence(F.lit(1), F.size("t") - words + 1), lambda i: F.array_join(F.slice("t", i, words), " "))
    return t.select("id", F.explode(grams).alias("phrase")).groupBy("id", "phrase").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= times)


def unit_mix(docs: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(id, first, variant) where a text uses both writings of one unit."""
    found = [F.when(F.col("content").contains(a) & F.col("content").contains(b), F.struct(F.lit(a).alias("first"), F.lit(b).alias("variant"))) for a, b in pairs]
    return docs.select("id", F.explode(F.array_compact(F.array(*found))).alias("x")).select("id", "x.first", "x.variant")


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def verdict(metrics: DataFrame, ranges: list[tuple[str, float, float, bool]]) -> DataFrame:
    """(id, verdict, fits, outside) of rows of metrics; ranges: (metric, least, most, hard).  A hard metric outside is "no", a soft one "in part"."""
    inside = [(m, F.col(m).between(lo, hi), hard) for m, lo, hi, hard in sorted(ranges)]
    no = F.lit(False)
    for _, ok, hard in inside:
        no = no | (~ok if hard else F.lit(False))
    fits = sum((ok.cast("long") for _, ok, _ in inside), F.lit(0).cast("long"))
    outside = F.array_join(F.filter(F.array(*[F.when(~ok, F.lit(m)) for m, ok, _ in inside]), lambda x: x.isNotNull()), ",")
    return metrics.select("id", F.when(no, "no").when(fits < len(inside), "in part").otherwise("yes").alias("verdict"), fits.alias("fits"), outside.alias("outside"))
