"""Removal of repeated passages by suffix automata of reference shards.

1. Every window of ``window`` words has an anchor: the least hash of its
   ``ANCHOR``-grams.  Equal windows have equal anchors, so a window whose anchor
   occurs once in the corpus is not repeated.  Consecutive windows with one
   anchor form a segment.
2. The segments of an anchor that occurs more than once are its reference text;
   equal ones are counted before they move.  Each anchor's distinct segments are
   split into shards of bounded size; a suffix automaton of each shard is built
   where the shard lies, and the segments are streamed through it for matching
   statistics: the longest match that ends at each word and occurs once more.
3. Maximal spans of matches of at least ``window`` words are carried back to the
   documents and their words removed.

A segment is named by its anchor and a hash of its words (128 bits together).
Automata are sent to the segments that can match them (by anchor) rather than to
every task, since the automata of a whole corpus have no size bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bloom, batch, bloom_of, gram_hashes, materialize, mix, release, slices, span_hashes, word_hashes, words

#: Words in an anchor, words of one automaton, and runs from which an anchor counts as frequent.
ANCHOR, SHARD_WORDS, FREQUENT = 10, 200_000, 4_000
#: Bytes of distinct segments that a task gathers before it passes them on.
FLUSH_BYTES = 24 << 20


def _least(g: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of each w consecutive values and the place of the first such."""
    n = len(g) - w + 1
    val, at, have = g, np.arange(len(g), dtype=np.int32), 1
    while have < w:
        step = min(have, w - have)
        a, b = val[:-step], val[step:]
        left = a <= b
        val, at, have = np.where(left, a, b), np.where(left, at[:-step], at[step:]), have + step
    return val[:n], at[:n]


def segments(h: np.ndarray, first: np.ndarray, window: int, frequent: Bloom | None) -> tuple[np.ndarray, ...]:
    """Of words with hashes h, in rows that begin at first: key, row, first window, windows and whether a segment may repeat itself."""
    empty = np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, bool)
    if len(h) < window:
        return empty
    k = min(ANCHOR, window)
    g = gram_hashes(h, k)
    key, at = _least(g, window - k + 1)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    live = np.flatnonzero(np.arange(len(key)) + window <= first[row[: len(key)] + 1])
    if not len(live):
        return empty
    key, at = key[live], at[live]
    if frequent is not None and (hot := np.flatnonzero(frequent.has(key))).size:  # a second anchor beside a frequent one
        w = window - k + 1
        grams = g[live[hot][:, None] + np.arange(w)]
        grams[grams == key[hot][:, None]] = np.uint64((1 << 64) - 1)
        second = grams.argmin(axis=1)
        at[hot] = live[hot] + second
        key[hot] = mix(key[hot] ^ mix(grams[np.arange(len(hot)), second]))
    new = np.ones(len(live), bool)
    new[1:] = (live[1:] != live[:-1] + 1) | (key[1:] != key[:-1])
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(live))
    return key[a], row[live[a]], live[a], b - a, at[a] != at[b - 1]


def _scan(column, window: int, frequent: Bloom | None):
    """Per slice of texts: bytes, word starts and ends, first words, hashes and segments."""
    for i, j, data, offs in slices(column):
        s, e, first = words(data, offs)
        h = word_hashes(data, s, e)
        yield i, j, data, s, e, first, h, segments(h, first, window, frequent)


class Automaton:
    """A suffix automaton of several word sequences, each with a weight; weight[state] counts a state's occurrences."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len, self.weight = [-1], [0], [0]

    def add(self, seq: list[int], weight: int) -> None:
        nxt, link, length, count = self.next, self.link, self.len, self.weight

        def clone(p: int, c: int, q: int) -> int:
            nxt.append(dict(nxt[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            count.append(0)
            r = len(nxt) - 1
            while p >= 0 and nxt[p].get(c) == q:
                nxt[p][c] = r
                p = link[p]
            link[q] = r
            return r

        last = 0
        for c in seq:
            q = nxt[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else clone(last, c, q)
            else:
                nxt.append({})
                link.append(0)
                length.append(length[last] + 1)
                count.append(0)
                cur, p = len(nxt) - 1, last
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
                if p >= 0:
                    q = nxt[p][c]
                    link[cur] = q if length[q] == length[p] + 1 else clone(p, c, q)
                last = cur
            count[last] += weight

    def close(self) -> Automaton:
        """Sums the weights over the states that a state's occurrences end in."""
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            if self.link[v] > 0:
                self.weight[self.link[v]] += self.weight[v]
        return self

    def spans(self, seq: list[int], least: int, times: int) -> list[tuple[int, int]]:
        """Maximal spans of seq covered by matches of at least ``least`` words that occur ``times`` or more."""
        nxt, link, length, count = self.next, self.link, self.len, self.weight
        out: list[tuple[int, int]] = []
        v = n = 0
        for j, c in enumerate(seq):
            while v and c not in nxt[v]:
                v = link[v]
                n = length[v]
            if c in nxt[v]:
                v = nxt[v][c]
                n += 1
            while v and count[v] < times:
                v = link[v]
                n = length[v]
            if n >= least:
                a = j + 1 - n
                while out and out[-1][1] >= a:
                    a = min(a, out.pop()[0])
                out.append((a, j + 1))
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def repeated_spans(texts: list[bytes], weights: list[int], window: int) -> list[list[tuple[int, int]]]:
    """Spans of each distinct text covered by windows that occur at least twice, weights counted, by automata of bounded shards."""
    if len(texts) == 1 and weights[0] > 1:  # every state of its automaton occurs weight times
        return [[(0, len(texts[0].split()))]]
    names: dict[bytes, int] = {}
    seqs = [[names.setdefault(w, len(names)) for w in t.split()] for t in texts]
    found: list[list[tuple[int, int]]] = [[] for _ in seqs]
    shards, size = [[]], 0
    for i, s in enumerate(seqs):
        if size and size + len(s) > SHARD_WORDS:
            shards.append([])
            size = 0
        shards[-1].append(i)
        size += len(s)
    for shard in shards:
        own, automaton = set(shard), Automaton()
        for i in shard:
            automaton.add(seqs[i], weights[i])
        automaton.close()
        for i, s in enumerate(seqs):
            found[i] += automaton.spans(s, window, 2 if i in own else 1)
    return [merged(x) for x in found]


def substring_dedup(docs: DataFrame, window: int = 35) -> DataFrame:
    """(doc_id, n_words, n_removed, removed array<struct<a,b>>, kept) for docs (doc_id, text).

    Words are ``[^\\x20\\x09-\\x0D]+``.  A word goes if a window of ``window`` words over
    it also starts anywhere else in the table, judged on the input; the words left
    are joined by one space in kept.  A null text has no words and an empty kept;
    repeated rows repeat each other's windows, so all of theirs go; an empty table
    gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    keyed = rows.select("text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(7), "text").alias("k2"))
    one = pa.schema([("key", pa.int64())])

    def anchors(frequent):
        def run(batches):
            for b in batches:
                for *_, (key, _, _, _, again) in _scan(b.column(0), window, frequent):
                    yield batch(one, np.concatenate((key, key[again])).view(np.int64))

        return rows.select("text").mapInArrow(run, "key long").groupBy("key").count().where("count > 1")

    keys = materialize(anchors(None), "dedup-keys")
    hot_n = keys.where(F.col("count") >= FREQUENT).count()
    frequent = bloom_of(keys.where(F.col("count") >= FREQUENT), "key", hot_n) if hot_n else None
    if frequent is not None:
        release(keys)
        keys = materialize(anchors(frequent), "dedup-keys")
    wanted = bloom_of(keys, "key", keys.count())
    release(keys)
    found = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("at", pa.int32()), ("key", pa.int64()), ("seg", pa.int64()), ("weight", pa.int32()), ("body", pa.binary())])

    def occurrences(batches):
        held: dict[tuple[int, int], list] = {}
        size = 0

        def out():
            rows_ = [*held.items()]
            for i in range(0, len(rows_), 20_000):
                part = rows_[i : i + 20_000]
                yield batch(found, *([None] * len(part) for _ in range(3)), [q for (q, _), _ in part], [x for (_, x), _ in part], [v[0] for _, v in part], [v[1] for _, v in part])

        for b in batches:
            k1, k2 = (b.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
            for i, _, data, s, e, first, h, (key, row, at, n, _) in _scan(b.column(0), window, frequent):
                ok = wanted.has(key)
                key, row, at, n = key[ok].view(np.int64), row[ok], at[ok], n[ok]
                if not len(key):
                    continue
                seg = span_hashes(h, at, at + n + window - 1).view(np.int64)
                raw = data.tobytes()
                for q, x, a, z in zip(key.tolist(), seg.tolist(), s[at].tolist(), e[at + n + window - 2].tolist(), strict=True):
                    got = held.get((q, x))
                    if got:
                        got[0] += 1
                    else:
                        held[q, x] = [1, raw[a:z]]
                        size += z - a + 200
                yield batch(found, k1[i + row], k2[i + row], (at - first[row]).astype(np.int32), key, seg, pa.nulls(len(key), pa.int32()), pa.nulls(len(key), pa.binary()))
            if size > FLUSH_BYTES:
                yield from out()
                held.clear()
                size = 0
        yield from out()

    occ = materialize(keyed.mapInArrow(occurrences, "k1 long, k2 long, at int, key long, seg long, weight int, body binary"), "dedup-segments")
    told = pa.schema([("key", pa.int64()), ("seg", pa.int64()), ("spans", pa.list_(pa.int32()))])

    def shards(batches):
        key, seg, weight, body, done = None, [], [], [], ([], [], [])

        def close():
            if sum(weight) > 1 or len(body) == 1:
                for x, spans in zip(seg, repeated_spans(body, weight, window), strict=True):
                    if spans:
                        done[0].append(key)
                        done[1].append(x)
                        done[2].append([y for ab in spans for y in ab])

        for b in batches:
            for q, x, w, t in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                if q != key:
                    close()
                    key, seg, weight, body = q, [], [], []
                if seg and seg[-1] == x:
                    weight[-1] += w
                else:
                    seg.append(x)
                    weight.append(w)
                    body.append(t)
            if len(done[0]) >= 5_000:
                yield batch(told, *done)
                done = ([], [], [])
        close()
        yield batch(told, *done)

    bodies = occ.where("body is not null").select("key", "seg", "weight", "body")
    spans = bodies.repartition("key").sortWithinPartitions("key", "seg").mapInArrow(shards, "key long, seg long, spans array<int>")
    spans = materialize(spans, "dedup-spans")
    places = occ.where("body is null").select("k1", "k2", "at", "key", "seg").join(spans, ["key", "seg"])
    by_text = places.groupBy("k1", "k2").agg(F.collect_set(F.struct("at", "spans")).alias("places"))
    joined = rows.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(7), "text")}).join(by_text, ["k1", "k2"], "left").select("doc_id", "text", F.transform("places", lambda p: p["at"]).alias("at"), F.transform("places", lambda p: p["spans"]).alias("spans"))
    span = pa.struct([("a", pa.int32()), ("b", pa.int32())])
    result = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(span)), ("kept", pa.string())])

    def cut(batches):
        for b in batches:
            for i in range(0, b.num_rows, 500):
                p = b.slice(i, 500)
                out = []
                for doc_id, text_, at, sp in zip(*(p.column(c).to_pylist() for c in range(4)), strict=True):
                    w = text_.encode().split()
                    gone = merged([(x + y[j], x + y[j + 1]) for x, y in zip(at or (), sp or (), strict=True) for j in range(0, len(y), 2)])
                    n, last, left = len(w), 0, []
                    for a, z in gone:
                        left += w[last:a]
                        last = z
                    left += w[last:]
                    out.append((doc_id, n, n - len(left), [{"a": a, "b": z} for a, z in gone], b" ".join(left).decode()))
                yield batch(result, *([*zip(*out, strict=True)] if out else [[] for _ in result]))

    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, removed array<struct<a:int,b:int>>, kept string")
