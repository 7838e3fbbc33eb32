"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits of the lower-cased text in compatibility
form, so that other spaces, marks and forms of a letter make no difference; in
scripts without spaces each character is a word.  Every n-gram of an item is a
seed, however often the corpus has it, since an edited copy may have kept any one
of them.  Passages around seeds that share enough words with the item are aligned
with it word by word, which finds edited and paraphrased copies too.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import batch, gram_hashes, slices, tidy, word_hashes

#: Words of a seed, least score of a leak as a share of the item's words, and in words (all of an item that has fewer).
SEED, LEAK, SURE = 4, 0.5, 6
#: Items and bytes of their texts that reach the executors at once.
ITEMS, ITEM_BYTES = 100_000, 32 << 20
#: Alignment: a match adds 1, a mismatch and a word left out take 1.
GAP = 1

#: What is beyond ASCII and no letter or digit; format characters (zero-width ones) are taken out.
_FORMAT = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_BEYOND = re.compile(r"[^\w\x00-\x7f]")
#: Scripts that write no spaces between words: Thai to Lao, Burmese, Khmer, kana and Han.
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")
_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def plain(text: str | None) -> str:
    """The text as it is compared: compatibility form, lower case, marks and spaces beyond ASCII as spaces, unspaced characters apart."""
    if not text or text.isascii():
        return text or ""
    return _UNSPACED.sub(r" \1 ", _BEYOND.sub(" ", _FORMAT.sub("", unicodedata.normalize("NFKC", text)).lower()))


def plain_words(data: np.ndarray, offs: np.ndarray):
    """Word hashes and the first word of each row."""
    s, e, first = common.words(np.where(_APART[data], np.uint8(32), data), offs)
    return word_hashes(data, s, e, lower=True), first


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Score of the best local alignment and the words [a, b) of text that it covers."""

    def forward(x, y):
        h, j = np.zeros(len(y) + 1, np.int32), np.arange(len(y) + 1, dtype=np.int32) * GAP
        best, at = 0, (0, 0)
        for i, w in enumerate(x):
            t = np.maximum(h - GAP, 0)
            t[1:] = np.maximum(t[1:], h[:-1] + np.where(y == w, 1, -1))
            h = np.maximum.accumulate(t + j) - j
            k = int(h.argmax())
            if h[k] > best:
                best, at = int(h[k]), (i + 1, k)
        return best, at

    best, (i, b) = forward(item, text)
    _, (_, back) = forward(item[:i][::-1], text[:b][::-1])
    return best, b - back, b


def needed(n: int) -> float:
    """The least score of a leak of an item of n words."""
    return max(LEAK * n, min(n, SURE))


class Items:
    """A block of test items: seeds in order of their hash, with the item and the place in it."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids, self.words, grams, short = [], [], [], {}
        for i, t in zip(ids, texts, strict=True):
            data = np.frombuffer(plain(t).encode(), np.uint8)
            h, _ = plain_words(data, np.array([0, len(data)]))
            if len(h):
                if len(h) < SEED:
                    short.setdefault(h.tobytes(), []).append(len(self.ids))
                grams.append(gram_hashes(h, SEED))
                self.ids.append(i)
                self.words.append(h)
        self.short = short
        self.set(np.concatenate(grams) if grams else np.zeros(0, np.uint64), np.repeat(np.arange(len(grams)), [len(g) for g in grams]))

    def set(self, gram: np.ndarray, item: np.ndarray) -> None:
        order = np.argsort(gram, kind="stable")
        self.gram, self.item = gram[order], item[order]
        self.distinct = np.unique(self.gram)
        bits = np.zeros(1 << 17, np.uint8)
        np.bitwise_or.at(bits, (self.distinct & np.uint64((1 << 20) - 1)) >> np.uint64(3), (1 << (self.distinct & np.uint64(7))).astype(np.uint8))
        self.bits = bits

    def found(self, g: np.ndarray) -> np.ndarray:
        """Places of g that are one of the n-grams."""
        if not len(self.distinct):
            return np.zeros(0, np.int64)
        at = np.flatnonzero(self.bits[(g & np.uint64((1 << 20) - 1)) >> np.uint64(3)] >> (g & np.uint64(7)).astype(np.uint8) & 1)
        k = np.minimum(np.searchsorted(self.distinct, g[at]), len(self.distinct) - 1)
        return at[self.distinct[k] == g[at]]


def _grams(column):
    for i, _, data, offs in slices(pa.array(map(plain, column.to_pylist()), pa.large_string())):
        h, first = plain_words(data, offs)
        g = gram_hashes(h, SEED)
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        yield i, h, first, row, g


def _found(column: pa.Array, b_: Items):
    """(row, item's place, score, first word, end word) of the leaks in a column of texts."""
    for i, h, first, row, g in _grams(column):
        if b_.short:
            for r in np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < SEED)).tolist():
                for item in b_.short.get(h[first[r] : first[r + 1]].tobytes(), ()):
                    yield i + r, item, 1.0, 0, int(first[r + 1] - first[r])
        at = b_.found(g)
        if not len(at):
            continue
        at = at[at + SEED <= first[row[at] + 1]]
        near: dict[tuple[int, int], list[int]] = {}
        lo, hi = np.searchsorted(b_.gram, g[at], "left"), np.searchsorted(b_.gram, g[at], "right")
        for p, a, z in zip(at.tolist(), lo.tolist(), hi.tolist(), strict=True):
            for item in {*b_.item[a:z].tolist()}:
                near.setdefault((int(row[p]), item), []).append(p)
        for (r, item), places in near.items():
            x = b_.words[item]
            best, a0, z0, least = (0, 0, 0), first[r], first[r + 1], needed(len(x))
            start = last = places[0]
            for p in [*places[1:], None]:
                if p is not None and p - last <= len(x):
                    last = p
                    continue
                a, z = max(a0, start - len(x)), min(z0, last + SEED + len(x))
                if np.isin(x, h[a:z]).sum() >= least:  # no score is above the words in common
                    s, u, v = align(x, h[a:z])
                    best = max(best, (s, int(u + a - a0), int(v + a - a0)), key=lambda t: t[0])
                start = last = p
            if best[0] >= least:
                yield i + r, item, best[0] / len(x), best[1], best[2]


def _blocks(items: DataFrame):
    """The items in blocks of ITEMS rows and ITEM_BYTES bytes at most (one longer item is a block)."""
    ids, texts, size = [], [], 0
    for i, t in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        n = len(t or "")
        if ids and (len(ids) >= ITEMS or size + n > ITEM_BYTES):
            yield items.sparkSession.sparkContext.broadcast(Items(ids, texts))
            ids, texts, size = [], [], 0
        ids.append(i)
        texts.append(t)
        size += n
    if ids:
        yield items.sparkSession.sparkContext.broadcast(Items(ids, texts))


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word) for docs (doc_id, text) and items (item_id, text).

    score is the alignment's over the item's words.  A pair is given if the score
    is LEAK or more and at least SURE words (of a shorter item: all of it) are
    aligned beyond what edits take; an item of fewer words than a seed leaks only as
    a whole document.  Pairs are given once for each row of docs and of items; null
    or empty texts match nothing; an empty side gives no rows; other columns are not
    read.  Items reach the executors in blocks of bounded size; the corpus is read
    once for each block.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int32()), ("end_word", pa.int32())])
    ddl = "doc_id long, item_id long, score double, first_word int, end_word int"
    result = None
    for seeds in _blocks(items):

        def match(batches, seeds=seeds):
            own = seeds.value
            for b in batches:
                found = [*_found(b.column(1), own)]
                ids = b.column(0).to_pylist()
                yield batch(out, [ids[r] for r, *_ in found], [own.ids[x] for _, x, *_ in found], *([f[k] for f in found] for k in (2, 3, 4)))

        part = rows.mapInArrow(tidy(match), ddl)
        result = part if result is None else result.union(part)
    return docs.sparkSession.createDataFrame([], ddl) if result is None else result


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs in which no item leaks, with all their columns; rows are decided one by one, whatever their doc_id."""
    at = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")
    schema = docs.schema
    for seeds in _blocks(items):

        def keep(batches, seeds=seeds):
            for b in batches:
                ok = np.ones(b.num_rows, bool)
                ok[[r for r, *_ in _found(b.column(at).cast(pa.string()), seeds.value)]] = False
                yield b.filter(pa.array(ok))

        docs = docs.mapInArrow(tidy(keep), schema)
    return docs
