"""Exact duplicates, n-gram similarity, SimHash and line differences."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import text_hash, tokens
from .ngram_join import similar_sets, similar_texts


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(text_hash, first_id, n) of contents that occur more than once, white space aside."""
    return docs.groupBy(text_hash(F.col("content")).alias("text_hash")).agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")


def char_ngrams(text: Column, n: Column) -> Column:
    """Distinct character n-grams of the text without white space."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s\x1C-\x1F]", "")
    every = F.regexp_extract_all(t, F.concat(F.lit(r"(?s)(?![\x{DC00}-\x{DFFF}])(?=(.{"), n.cast("string"), F.lit("}))")), F.lit(1))  # one pass; substring would count from the start each time
    return F.when((F.length(t) >= n) & (n > 0), F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of character n-gram sets, n = min(3, lengths); two empty texts are equal, an empty one is like no other."""
    ta, tb = (F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)[\s\x1C-\x1F]", "") for x in (a, b))
    n = F.least(F.lit(3), F.length(ta), F.length(tb))
    ga, gb = char_ngrams(ta, n), char_ngrams(tb, n)
    both = F.size(F.array_intersect(ga, gb))
    return F.when((F.length(ta) == 0) & (F.length(tb) == 0), 1.0).when((F.length(ta) == 0) | (F.length(tb) == 0), 0.0).otherwise(both / (F.size(ga) + F.size(gb) - both))


def ngram_pairs(docs: DataFrame, threshold: float, n: int = 3, lower: bool = False) -> DataFrame:
    """(a, b, similarity) of all pairs of documents whose n-gram sets are similar, a < b; similarity is rounded after the threshold.

    With lower, as `jaccard` has it: a pair is measured at order min(n, lengths), two empty texts are equal.  Else a
    text of fewer than n characters has no set and no pair.

    Similar sets have similar sizes: a block of sets by size meets only those it can match.  There, parity sketches
    bound the difference of a pair from below, and the pairs that pass are counted exactly.  Texts of fewer than n
    characters are joined by their whole text with those that have few grams of that order.
    """
    pairs = similar_texts(docs, threshold, n) if lower else similar_sets(docs, threshold, n)
    return pairs.where((F.col("a") < F.col("b")) & (F.col("similarity") >= threshold)).select("a", "b", F.round("similarity", 6).alias("similarity"))


def _rounded(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs of sets whose similarity, rounded to six places, reaches the threshold."""
    return pairs.withColumn("similarity", F.round("similarity", 6)).where(F.col("similarity") >= threshold)


def simhashes(docs: DataFrame) -> DataFrame:
    """(id, simhash) of documents (id, content): signed 64-bit SimHash, for which tokens and token pairs of two characters or more vote by their counts with FNV-1a bits."""

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({"id": pdf["id"], "simhash": _simhash64(pdf["t"])})

    return docs.select("id", tokens(F.col("content")).alias("t")).mapInPandas(run, "id long, simhash long")


def _simhash64(token_lists) -> list[int]:
    from collections import Counter

    import numpy as np

    known: dict[str, int] = {}

    def fnv(s: str, h: int = 0xCBF29CE484222325) -> int:
        for c in s.encode():
            h = (h ^ c) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        return h

    def word(s: str) -> int:
        if s not in known:
            if len(known) >= 200_000:
                known.clear()
            known[s] = fnv(s)
        return known[s]

    def one(ts) -> int:
        ts = list(ts) if ts is not None else []
        words, pairs = Counter(x for x in ts if len(x) >= 2), Counter(zip(ts, ts[1:], strict=False))
        if not words and not pairs:
            return 0
        h = np.array([*map(word, words), *(fnv(y, word(x)) for x, y in pairs)], np.uint64)  # the hash of a pair goes on from its first word's
        w = np.array([*words.values(), *pairs.values()], np.float64)
        votes = 2 * (w @ np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")) - w.sum()
        return int(np.packbits(votes > 0, bitorder="little").view(np.int64)[0])

    return [one(ts) for ts in token_lists]


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def find_similar(docs: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(a, b, similarity) of pairs that pass the SimHash gate (1 - hamming / 64 >= threshold - 0.25) and the exact n-gram measure."""
    pairs = _rounded(similar_sets(docs, threshold - 1e-6, 3, tokens(F.col("content")), _simhash64), threshold)
    coarse = F.when((F.col("ha") == 0) & (F.col("hb") == 0), 1.0).otherwise(1 - hamming(F.col("ha"), F.col("hb")) / 64.0)
    return pairs.where(coarse >= threshold - 0.25).select("a", "b", "similarity")


_OPS = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("i1", "i2", "j1", "j2")]]))


@F.pandas_udf(_OPS)
def line_ops(old: pd.Series, new: pd.Series) -> pd.Series:
    """Line-level edit operations (equal, delete, insert, replace) that turn old into new."""
    import difflib

    def one(a, b):
        return [{"op": o, "i1": i, "i2": j, "j1": k, "j2": m} for o, i, j, k, m in difflib.SequenceMatcher(None, (a or "").split("\n"), (b or "").split("\n"), autojunk=False).get_opcodes()]

    return pd.Series([one(a, b) for a, b in zip(old, new, strict=True)])


def is_variant(short: Column, long: Column) -> Column:
    """short is a subsequence of long with its first two and last characters, three or more long, at most four shorter, no prefix."""
    return (
        (F.length(short) >= 3)
        & (F.length(long) > F.length(short))
        & (F.length(long) - F.length(short) <= 4)
        & (F.substring(short, 1, 2) == F.substring(long, 1, 2))
        & (F.substring(short, -1, 1) == F.substring(long, -1, 1))
        & ~long.startswith(short)
        & F.call_function("rlike", long, F.concat(F.lit("^"), F.array_join(F.split(short, ""), ".*"), F.lit("$")))
    )
