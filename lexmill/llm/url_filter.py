"""URL rules by a Bloom filter cascade that is exact over the corpus's own keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Bloom, batch, bloom_of, materialize

#: Bits a listed key gets in each level; the cascade shrinks by about a hundredth a level.
BITS_A_KEY = 12
#: (verdict, host/path) of the query.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or has no ``://``."""
    rx = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, rx, 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.coalesce(F.regexp_extract(url, rx, 2), F.lit(""))


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every host suffix at a label with every path prefix of a rule's length: all the rules that could fit, longest first."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= k, F.substring(path, 1, k)) for k in sorted(lengths, reverse=True)]), lambda p: p.isNotNull())
    return F.array_sort(F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))), lambda a, b: F.length(b) - F.length(a))


class Cascade:
    """Levels 0, 2, ... hold listed keys, levels 1, 3, ... the false positives of the level before."""

    def __init__(self, levels: list[Bloom]):
        self.levels = levels

    def has(self, hashes: np.ndarray) -> np.ndarray:
        listed, live = np.zeros(len(hashes), bool), np.arange(len(hashes))
        for k, level in enumerate(self.levels):
            live = live[level.has(hashes[live])]
            listed[live] = k % 2 == 0
        return listed


def _passes(keys: DataFrame, levels: list[Bloom]) -> DataFrame:
    schema = pa.schema([("h", pa.int64())])

    def run(batches):
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False)
            ok = np.ones(len(h), bool)
            for level in levels:
                ok &= level.has(h.view(np.uint64))
            yield batch(schema, h[ok])

    return keys.mapInArrow(run, "h long")


def build_cascade(universe: DataFrame, listed: DataFrame) -> Cascade:
    """From the hashes h of the corpus's keys and of the listed keys, both distinct.

    Each level's keys stay distributed; a level's filter is built by the executors.
    The levels end when no key of the other side passes all of them.
    """
    listed = materialize(listed.select("h").distinct(), "url-listed")
    others = materialize(universe.select("h").distinct().join(F.broadcast(listed) if listed.count() <= 100_000 else listed, "h", "left_anti"), "url-others")
    levels, sides = [], [listed, others]
    own = listed
    while (n := own.count()) or not levels:
        levels.append(_sized(own, n, len(levels)))
        own = materialize(_passes(sides[len(levels) % 2], levels), "url-level")
        if len(levels) > 60:  # a hundredth goes on at each level, so that no table gets here
            raise RuntimeError("the cascade's levels do not shrink")
    return Cascade(levels)


def _sized(keys: DataFrame, n: int, level: int) -> Bloom:
    """A level's filter; every level has a seed of its own, so that its false positives are its own."""
    bits = 1 << max(6, (BITS_A_KEY * max(1, n) - 1).bit_length())
    if bits > Bloom.size_for(n):
        return bloom_of(keys, "h", n, level)
    if n <= 100_000:  # bounded by the line above: a small level is made on the driver
        own = Bloom(bits, seed=level)
        own.add(np.array([r[0] for r in keys.collect()], np.int64).view(np.uint64))
        return own
    return bloom_of(keys, "h", n, level)


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page.

    rules: (rule string host/path, verdict).  A rule fits its host, all subdomains
    and the paths that start with its own; the longest that fits decides (of two
    equally long ones that with the longer host), else default.  Candidate keys of a
    url are tested longest first against the cascade, which is exact for every key
    of the table; a rule's verdict is looked up by the one key that was found.  A
    rule given twice has its first verdict in order; a null url has empty host and
    path and gets the default; repeated rows are all judged; an empty side gives no
    rows or no rule.
    """
    rules = materialize(rules.select("rule", "verdict", F.xxhash64("rule").alias("h")).where("rule is not null").groupBy("rule", "h").agg(F.min("verdict").alias("verdict")), "url-rules")
    lengths = [r[0] for r in rules.select((F.length("rule") - F.instr("rule", "/") + 1).alias("n")).distinct().orderBy("n").collect()]
    host, path = host_path(F.col("url"))
    keyed = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("keys", F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(candidate_keys(F.col("host"), F.col("path"), lengths)) if lengths else F.array().cast("array<string>"))
    universe = keyed.select(F.explode("keys").alias("key")).select(F.xxhash64("key").alias("h"))
    cascade = build_cascade(universe, rules)
    schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string())])

    def judge(batches):
        for b in batches:
            keys = b.column(3).combine_chunks() if isinstance(b.column(3), pa.ChunkedArray) else b.column(3)
            flat, hashes = keys.flatten().to_pylist(), b.column(4).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            offs = np.concatenate(([0], np.cumsum(keys.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
            hits = np.flatnonzero(cascade.has(hashes))
            first = np.searchsorted(hits, offs[:-1])
            rule = [flat[hits[f]] if f < len(hits) and hits[f] < e else None for f, e in zip(first, offs[1:], strict=True)]
            yield batch(schema, b.column(0), b.column(1), b.column(2), rule)

    found = keyed.select(F.col("page_id").cast("long"), "host", "path", "keys", F.transform("keys", lambda k: F.xxhash64(k)).alias("hashes")).mapInArrow(judge, "page_id long, host string, path string, rule string")
    told = found.join(rules.select("rule", "verdict"), "rule", "left")
    known = F.col("verdict").isNotNull()
    return told.select("page_id", "host", "path", F.when(known, F.col("rule")).alias("rule"), F.coalesce("verdict", F.lit(default)).alias("verdict"))
