"""Helpers that the operators share: materialised steps, Arrow slices, vectorised word hashes, bounded Bloom filters."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a vectorised step works on at once (one longer document is one slice).
SLICE_BYTES = 1 << 20
#: Largest Bloom filter in bits (32 MB); beyond its best load it only lets more false candidates through.
BLOOM_BITS_MAX = 1 << 28
_BLOCK = 1 << 16


# ---------------------------------------------------------------- materialised steps


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one in the local temp folder only where it is unset and the master is local."""
    set_ = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_:
        return set_.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "lexmill-shared")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Deletes the files of a materialised step that nothing reads any more."""
    spark = df.sparkSession
    for path in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        if shared_dir(spark).split("://")[-1] not in path:
            continue
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def no_rows(df: DataFrame) -> bool:
    """Whether df is empty, by one job (isEmpty tries more and more partitions, a job each time)."""
    return df.limit(1).count() == 0


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- text slices and words

_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Fixed random multipliers of the rolling hashes (odd, so that they have inverses modulo 2**64).
_P, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_M64 = (1 << 64) - 1
_T = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_pow: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _pow.get(base)
    if have is None or len(have[0]) < n:
        m = max(1 << 16, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            have = tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(m - 1, b, np.uint64))), dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))
        _pow[base] = have
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift and multiply rounds)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def slices(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets of the rows in them) in pieces of about SLICE_BYTES; null counts as empty."""
    column = column.cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offs, offs[i] + SLICE_BYTES, "right")) - 1))
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word ``[^\\x20\\x09-\\x0D]+``, and the first word of each row (one more entry at the end)."""
    inside = ~_SEP[data]
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    cut[0] = cut[n] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:n]
    end[:-1] &= ~inside[1:] | cut[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, offs, "left")


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes, equal for equal words wherever they stand."""
    if not len(s):
        return np.zeros(0, np.uint64)
    pw, inv = _powers(_P, len(data) + 1)
    with np.errstate(over="ignore"):
        c = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_T[_LOWER[data] if lower else data] * pw[:-1], out=c[1:])
        return mix((c[e] - c[s]) * inv[s] + (e - s).astype(np.uint64))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words, by their first word; entries that cross a row's end are for the caller to drop."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        if k <= 8:
            out = h[:n].copy()
            for j in range(1, k):
                out = out * np.uint64(_Q) + h[j : j + n]
            return mix(out)
        pw, inv = _powers(_Q, len(h) + 1)
        c = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * pw[:-1], out=c[1:])
        return mix((c[k:] - c[:n]) * inv[:n])


def span_hashes(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the words a to b - 1 for each pair."""
    pw, inv = _powers(_Q, len(h) + 1)
    with np.errstate(over="ignore"):
        c = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h) * pw[:-1], out=c[1:])
        return mix((c[b] - c[a]) * inv[a] + (b - a).astype(np.uint64))


def parts_of(b: pa.RecordBatch, column: int, rows: int = 256, size: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """b in slices of at most ``rows`` rows and about ``size`` bytes of a text column (one longer text is a slice)."""
    lengths = b.column(column).cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    total = np.concatenate(([0], np.cumsum(pc.binary_length(lengths).to_numpy(zero_copy_only=False).astype(np.int64))))
    i = 0
    while i < b.num_rows:
        j = min(i + rows, b.num_rows, max(i + 1, int(np.searchsorted(total, total[i] + size, "right")) - 1))
        yield b.slice(i, j - i)
        i = j


def tidy(run):
    """run, a function over a task's batches, which gives the memory that it freed back to the system at its end."""

    def whole(batches):
        import ctypes
        import gc

        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # only some C libraries have it
            pass

    return whole


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


# ---------------------------------------------------------------- bounded Bloom filters


class Bloom:
    """A Bloom filter over 64-bit keys with two probes; its size is fixed when it is made."""

    def __init__(self, bits: int, data: np.ndarray | None = None, seed: int = 0):
        self.bits, self.seed, self.data = bits, seed, np.zeros(bits // 8, np.uint8) if data is None else data

    @staticmethod
    def size_for(n: int) -> int:
        return min(BLOOM_BITS_MAX, max(1 << 19, 1 << (12 * max(1, n) - 1).bit_length()))

    def _at(self, keys: np.ndarray):
        k = mix(keys.astype(np.uint64, copy=False) ^ np.uint64((0x5851F42D4C957F2D + 0x9E3779B97F4A7C15 * self.seed) & _M64))
        m = np.uint64(self.bits - 1)
        return (k & m, (k >> np.uint64(32)) * np.uint64(0x2545F491) + (k & np.uint64(0xFFFF)) & m) if self.bits <= 1 << 32 else ()

    def add(self, keys: np.ndarray) -> None:
        for at in self._at(keys):
            np.bitwise_or.at(self.data, at >> np.uint64(3), (1 << (at & np.uint64(7))).astype(np.uint8))

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for at in self._at(keys):
            found &= (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return found


def bloom_of(keys: DataFrame, column: str, n: int, seed: int = 0) -> Bloom:
    """The filter of a long column, built by the executors in blocks and merged; what reaches the driver is its fixed size."""
    bits = Bloom.size_for(n)
    schema = pa.schema([("block", pa.int32()), ("bits", pa.binary())])

    def build(batches):
        own = Bloom(bits, seed=seed)
        for b in batches:
            own.add(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        rows = own.data.reshape(-1, min(_BLOCK, len(own.data)))
        full = np.flatnonzero(rows.any(axis=1))
        for at in np.array_split(full, max(1, len(full) // 64)):
            yield batch(schema, at.astype(np.int32), [rows[i].tobytes() for i in at])

    def merge(pdf):
        import pandas as pd

        out = np.zeros(len(pdf["bits"].iloc[0]), np.uint8)
        for x in pdf["bits"]:
            out |= np.frombuffer(x, np.uint8)
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "bits": [out.tobytes()]})

    parts = keys.select(F.col(column).cast("long").alias("k")).where("k is not null").mapInArrow(build, "block int, bits binary")
    data = np.zeros(bits // 8, np.uint8)
    for r in parts.groupBy("block").applyInPandas(merge, "block int, bits binary").collect():  # the filter's fixed size
        x = np.frombuffer(r["bits"], np.uint8)
        data[r["block"] * len(x) : (r["block"] + 1) * len(x)] = x
    return Bloom(bits, data, seed)


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, tag: str) -> DataFrame:
    """(node, component) for the nodes of edges (a, b); component is the smallest node that can be reached.

    Alternates two star contractions, each a keyed minimum joined back to the edges
    (the minimum combines before its shuffle and the join may be split by AQE, so
    that a node with very many links is no single task), until nothing changes.
    """

    def contract(e: DataFrame, large: bool) -> DataFrame:
        nodes = (e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
        least = nodes.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        near = nodes.join(least, "u")
        out = near.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else near.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def is_done(e: DataFrame) -> bool:
        """Every node is either a centre or has one link, to a smaller centre."""
        ends = e.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.when(F.col("a") < F.col("b"), 2).otherwise(1).alias("child"), F.lit(0).alias("centre")), F.struct(F.col("b").alias("v"), F.lit(0).alias("child"), F.lit(1).alias("centre")))).alias("x")).select("x.*")
        return no_rows(ends.groupBy("v").agg(F.sum("child").alias("c"), F.max("centre").alias("p")).where("c > 1 or (c > 0 and p > 0)"))

    now = materialize(edges.select("a", "b").where("a <> b").distinct(), f"{tag}-edges")
    while not is_done(now):
        nxt = materialize(contract(contract(now, True), False), f"{tag}-edges")
        release(now)
        now = nxt
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
