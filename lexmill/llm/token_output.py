"""Token-ID output: documents as compressed id arrays in blocks with an offset index.

File format (one block = one file image, little-endian):

    magic "LXTK1\\0\\0\\0" | sha256 of the shared zstandard dictionary (32 bytes)
    | u64 documents n | u64 x (n + 1) frame offsets | u32 x n token counts
    | n zstandard frames, each one document's u32 ids

Every document is compressed on its own with one dictionary, trained on
serialized id arrays, so that a short document is read by its offset alone.  The
images travel as binary rows of a Parquet table, written by Spark's committer:
a lost executor's blocks are written again, never twice.  ``export`` lays them
out as plain files.  A document's ids take 2 GB at most (Arrow's limit for a value).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, materialize, parts_of, tidy

MAGIC = b"LXTK1\0\0\0"
#: The dictionary is fitted on at most so many documents, none longer than so many characters, of at most so many ids in all.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_IDS, DICT_BYTES = 1500, 20_000, 1_500_000, 64 << 10
#: A block is closed at so many bytes of frames; a range of documents has about so many bytes of input, and there are at most so many ranges.
BLOCK_BYTES, PART_BYTES, PARTS_MAX = 4 << 20, 256 << 20, 20_000
LEVEL = 3
#: Pieces of text whose ids a worker keeps.
PIECES = 1_400_000


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, ids binary): u32 ids of each whole text and the end id; null text counts as empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        from .encoding import encoder

        enc, end = encoder(tokenizer), struct.pack("<I", end_id)
        for b in batches:
            for part in parts_of(b, 1):
                yield batch(schema, part.column(0), [enc.ids(t or "").tobytes() + end for t in part.column(1).to_pylist()])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary")


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int) -> bytes:
    """A dictionary from the SAMPLE_DOCS documents of the smallest id hashes; empty (no dictionary) if they are too few."""
    import zstandard

    ids = docs.select(F.xxhash64("doc_id").alias("h")).orderBy("h").limit(SAMPLE_DOCS)
    last = ids.agg(F.max("h")).first()[0] or 0
    some = docs.select("doc_id", "text").where(F.xxhash64("doc_id") <= F.lit(last)).where(F.length("text") <= SAMPLE_CHARS).limit(2 * SAMPLE_DOCS)
    samples, total = [], 0
    for r in encoded(some, tokenizer, end_id).collect():  # the sample
        if total + len(r["ids"]) > 4 * SAMPLE_IDS:
            continue
        samples.append(bytes(r["ids"]))
        total += len(samples[-1])
    samples.sort()
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, total // 8)), samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def _image(dict_hash: bytes, frames: list[bytes], counts: list[int]) -> bytes:
    offs = np.zeros(len(frames) + 1, "<u8")
    np.cumsum([len(f) for f in frames], out=offs[1:])
    return MAGIC + dict_hash + struct.pack("<Q", len(frames)) + offs.tobytes() + np.array(counts, "<u4").tobytes() + b"".join(frames)


def read_document(image: bytes, at: int, dictionary: bytes) -> np.ndarray:
    """The ids of document at of a block, by its offset."""
    if image[:8] != MAGIC or image[8:40] != hashlib.sha256(dictionary).digest():
        raise ValueError("no block of this dictionary")
    n = struct.unpack_from("<Q", image, 40)[0]
    offs, base = np.frombuffer(image, "<u8", n + 1, 48), 48 + 8 * (n + 1) + 4 * n
    return np.frombuffer(_unpacker(dictionary).decompress(image[base + int(offs[at]) : base + int(offs[at + 1])]), "<u4")


def read_block(image: bytes, dictionary: bytes) -> Iterator[np.ndarray]:
    for i in range(struct.unpack_from("<Q", image, 40)[0]):
        yield read_document(image, i, dictionary)


_unpackers: dict[bytes, object] = {}


def _unpacker(dictionary: bytes):
    import zstandard

    if dictionary not in _unpackers:
        _unpackers[dictionary] = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    return _unpackers[dictionary]


def write_blocks(docs: DataFrame, tokenizer: str, end_id: int) -> tuple[DataFrame, bytes]:
    """Writes the blocks in ascending doc_id order; returns the table (part, block, doc_ids, before, n_tokens, image) and the dictionary.

    before counts the part's ids before the block.  Null doc_ids come first; rows of
    one doc_id are in order of length, checksum and frame.  There is a part, written
    by one task, for each PART_BYTES of input; the parts' ranges of doc_id come from
    its own quantiles (ids are read alone), so that texts are encoded once and only
    frames move.
    """
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, tokenizer, end_id)
    dict_hash = hashlib.sha256(dictionary).digest()
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = 0 if size >= 1 << 60 else size  # Spark's mark of an input whose size it does not know
    parts = min(PARTS_MAX, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES)))
    cuts = sorted({int(x) for x in docs.select(F.col("doc_id").cast("double").alias("x")).approxQuantile("x", [i / parts for i in range(1, parts)], 0.25 / parts)} if parts > 1 else ())
    packed = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int32()), ("crc", pa.int64()), ("frame", pa.binary())])

    def pack(batches):
        import zstandard

        from .encoding import encoder

        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if shared:
            shared.precompute_compress(level=LEVEL)
        c = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
        enc, end, bounds = encoder(tokenizer, PIECES), struct.pack("<I", end_id), np.array(cuts, np.int64)
        for whole in batches:
            for b in parts_of(whole, 1):
                ids = [enc.ids(t or "").tobytes() + end for t in b.column(1).to_pylist()]
                at = np.searchsorted(bounds, b.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(), "right")
                yield batch(packed, at.astype(np.int32), b.column(0), [len(x) // 4 for x in ids], [zlib.crc32(x) for x in ids], [c.compress(x) for x in ids])

    blocks = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("before", pa.int64()), ("n_tokens", pa.int64()), ("image", pa.binary())])

    def build(batches):
        part, block, before, ids, counts, frames, size = None, 0, 0, [], [], [], 0

        def out():
            return batch(blocks, [part], [block], [ids], [before], [sum(counts)], [_image(dict_hash, frames, counts)])

        for b in batches:
            for p, d, n, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True):
                if ids and (p != part or size >= BLOCK_BYTES):
                    yield out()
                    block, before, ids, counts, frames, size = *((block + 1, before + sum(counts)) if p == part else (0, 0)), [], [], [], 0
                part = p
                ids.append(d)
                counts.append(n)
                frames.append(f)
                size += len(f)
        if ids:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(pack), "part int, doc_id long, n int, crc long, frame binary")
    dealt = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "n", "crc", "frame")
    table = materialize(dealt.mapInArrow(build, "part int, block int, doc_ids array<long>, before long, n_tokens long, image binary"), "token-blocks")
    return table, dictionary


def read_back(table: DataFrame, dictionary: bytes) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the blocks; start counts the ids of all documents before it.

    Only the parts' totals (PARTS_MAX numbers at most) reach the driver and the tasks.
    """
    totals = {r["part"]: r["n"] for r in table.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    starts = np.zeros(max(totals, default=0) + 2, np.int64)
    for p, n in totals.items():
        starts[p + 1] = n
    starts = np.cumsum(starts)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for b in batches:
            for p, before, doc_ids, image in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                read = [(len(x), zlib.crc32(x.tobytes())) for x in read_block(image, dictionary)]
                n = np.array([k for k, _ in read], np.int64)
                yield batch(schema, doc_ids, np.cumsum(n) - n + starts[p] + before, n, [c for _, c in read])

    return table.select("part", "before", "doc_ids", "image").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def export(table: DataFrame, dictionary: bytes, folder: str) -> list[str]:
    """Lays the blocks out as plain files block-PPPPP-BBBBB.lxtk and dictionary.zdict in a folder of the driver."""
    import os

    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, "dictionary.zdict"), "wb") as f:
        f.write(dictionary)
    names = []
    for r in table.select("part", "block", "image").orderBy("part", "block").toLocalIterator():
        names.append(os.path.join(folder, f"block-{r['part']:05}-{r['block']:05}.lxtk"))
        with open(names[-1], "wb") as f:
            f.write(r["image"])
    return names


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes docs (doc_id, text) in the block format and reads the blocks back.

    A null text is an empty one (its ids are the end id); repeated rows are all
    written; an empty table gives no rows; other columns are not read.
    """
    return read_back(*write_blocks(docs, tokenizer, end_id))
