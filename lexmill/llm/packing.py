"""Best-fit packing of documents into fixed-length token sequences."""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, materialize, parts_of, tidy
from .encoding import MEMO_PIECES

#: Open bins of a task: enough that nearly every closed bin is full, few enough to bound memory.
OPEN_BINS = 512
#: Tasks whose ill-filled last bins one task of the next round packs anew; bins with no more than size / SLACK places left stay.
FAN, SLACK = 64, 64
_COLUMNS = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
_PLACED = pa.schema([*_COLUMNS, ("sequence_id", pa.int64()), ("offset", pa.int64()), ("part", pa.int64()), ("loose", pa.bool_())])
_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, part long, loose boolean"


class Bins:
    """Bounded-space online best fit: bit f of ``free`` is set while an open bin has f places left.

    A piece goes to the open bin with the least space that holds it; when no bin
    does, a new one opens, and beyond ``most`` open bins the fullest closes.
    ``closed`` gathers the bins that are full or closed, for the caller to take.
    """

    def __init__(self, size: int, most: int, first_id: int):
        self.size, self.most, self.next = size, most, first_id
        self.free, self.by_free, self.open, self.closed = 0, {}, 0, []

    def put(self, n: int) -> tuple[int, int]:
        """(sequence, offset) of a piece of n <= size tokens."""
        fits = self.free >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            seq = self._take(left)
        else:
            if self.open >= self.most:
                self.closed.append(self._take((self.free & -self.free).bit_length() - 1))
            seq, left = self.next, self.size
            self.next += 1
        if left > n:
            self.by_free.setdefault(left - n, []).append(seq)
            self.free |= 1 << (left - n)
            self.open += 1
        else:
            self.closed.append(seq)
        return seq, self.size - left

    def _take(self, left: int) -> int:
        bins = self.by_free[left]
        seq = bins.pop()
        self.open -= 1
        if not bins:
            del self.by_free[left]
            self.free &= ~(1 << left)
        return seq


class Packer:
    """Packs pieces of one part; pieces wait until it is known whether their bin stays as it is."""

    def __init__(self, size: int, most: int, level: int, part: int):
        self.bins, self.part = Bins(size, most, level << 58 | part << 34), part
        self.held: dict[int, list[tuple]] = {}
        self.done: list[tuple] = []

    def put(self, piece: tuple) -> None:
        seq, offset = self.bins.put(piece[3])
        self.held.setdefault(seq, []).append((*piece, seq, offset, self.part, False))
        for x in self.bins.closed:
            self.done += self.held.pop(x)
        self.bins.closed.clear()

    def taken(self) -> list[tuple]:
        out, self.done = self.done, []
        return out

    def last(self, again: bool) -> list[tuple]:
        """All pieces not taken yet; those of open and ill-filled bins are loose if they are packed again."""
        out = self.taken()
        for left, seqs in self.bins.by_free.items():
            loose = again and left > self.bins.size // SLACK
            for seq in seqs:
                out += [(*r[:-1], loose) for r in self.held[seq]]
        self.held.clear()
        return out


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return batch(_PLACED, *([*zip(*rows, strict=True)] if rows else [[] for _ in _PLACED]))


def best_fit_packing(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = 2048, open_bins: int = OPEN_BINS, pieces: int = MEMO_PIECES) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every document.

    Each document is its ids and the end id; only those longer than size are cut,
    into pieces of size tokens and a rest.  Every task packs the rows it reads, in
    their order, and numbers sequences from its own range.  The pieces of the bins
    that a task leaves open and ill-filled (open_bins at most) are packed again, FAN
    tasks' together, until one task has packed the last of them, so that the number
    of sequences does not follow the number of tasks.  A null text is empty (one
    end id); repeated rows are packed each; an empty table gives no rows; other
    columns are not read.  A worker keeps the ids of so many pieces of text.
    """

    def first(batches):
        from .encoding import encoder

        enc, end = encoder(tokenizer, pieces), struct.pack("<I", end_id)
        packer = Packer(size, open_bins, 0, TaskContext.get().partitionId())
        for whole in batches:
            for b in parts_of(whole, 1):
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    ids = enc.ids(text or "").tobytes() + end
                    for k, at in enumerate(range(0, len(ids), 4 * size)):
                        own = ids[at : at + 4 * size]
                        packer.put((doc_id, k, at // 4, len(own) // 4, zlib.crc32(own)))
                yield _rows(packer.taken())
        yield _rows(packer.last(True))

    def again(level: int, more: bool):
        def run(batches):
            packer = None
            for b in batches:
                for group, *piece in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if packer is None or packer.part != group:
                        if packer is not None:
                            yield _rows(packer.last(more))
                        packer = Packer(size, open_bins, level, group)
                    packer.put(tuple(piece))
                if packer is not None:
                    yield _rows(packer.taken())
            if packer is not None:
                yield _rows(packer.last(more))

        return run

    placed = materialize(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(first), _DDL), "packing-0")
    result, level, parts = placed.where("not loose"), 0, (placed.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        level, parts = level + 1, -(-parts // FAN)
        loose = placed.where("loose").select(F.floor(F.col("part") / FAN).cast("long").alias("group"), *[n for n, _ in _COLUMNS])
        dealt = loose.repartition(max(1, parts), "group").sortWithinPartitions("group", F.xxhash64("doc_id", "piece", "ids_crc32"), "doc_id", "piece")
        placed = materialize(dealt.mapInArrow(again(level, parts > 1), _DDL), f"packing-{level}")
        result = result.union(placed.where("not loose"))
        if parts <= 1:
            return result.drop("part", "loose")
