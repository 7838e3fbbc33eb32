"""Similarity self-join of shingle sets with adaptive multi-match prefixes.

Sets are ordered by estimated corpus frequency, rarest first.  A pair with
Jaccard similarity of at least t overlaps in o = ceil(t / (1 + t) (|x| + |y|))
tokens or more, so for every l the prefixes of |x| - o + l and |y| - o + l tokens
share l tokens.  Each document lengthens its prefix to the l of least estimated
cost (as far as any partner's size can ask for); a pair is a candidate if it
shares min(l_x, l_y) tokens in the prefixes of that length for its two sizes.

Equal sets are one class.  Links are found in steps so that a large group of near
copies never makes all of its pairs:

1. Rounds of pivots: of each token's classes the few whose prefixes are most shared
   (an original rather than its edits) are pivots, and every class is compared with
   the pivots of its tokens.  Rounds go on, with other pivots, while they connect
   components.
2. What tokens still hold classes of two components is joined exactly.  A token's
   place in a prefix bounds the partner's size from both sides, so the join is
   keyed by token and a fine size band; a row whose token stands too late for any
   smaller or larger partner meets nothing.

Pairs are compared by small bitmaps first, which rule out what cannot be similar;
what is left is verified by whole sets, once after the rounds (the nearest pairs of each class)
and once after the join (pairs whose ends are not connected yet).  A comparison sends each body to its pivot, whose own body goes once to each
of the pivot's parts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, bloom_of, components, gram_hashes, materialize, mix, no_rows, release, slices, span_hashes, tidy, word_hashes, words

#: Words in a shingle, similarity in hundredths, longest multi-match, counters of the frequency sketch.
SHINGLE, PERCENT, MATCHES_MAX, COUNTERS = 5, 75, 4, 1 << 18
#: Cost of verifying a candidate, in looked-up tokens.
VERIFY_COST = 40
#: Classes whose prefixes a task remembers, so that it does not emit copies again.
SEEN_MAX = 1_000_000
#: Pivots of a token in a round; rounds go on while they find pairs for this share of the classes left.
PIVOTS, WORTH = 4, 0.01
#: Pairs of a class that are verified right after the rounds.
NEAREST = 2
#: Postings of one token that a task looks at together; more than any set's size.
GROUP_ROWS, _FAR = 500_000, 1 << 34
#: Ratio of neighbouring size bands; comparisons that share one copy of a pivot's body.
BAND, PART = 1.06, 512


def shingle_slices(column: pa.Array, k: int = SHINGLE):
    """Per slice of an Arrow column of texts: the rows' sets of k-word shingle hashes (of the whole text if it has fewer words), end to end, each in order, and their offsets."""
    for _, _, data, offs in slices(column):
        s, e, first = words(data, offs)
        h = word_hashes(data, s, e, lower=True)
        n = np.diff(first)
        count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
        at = np.concatenate(([0], np.cumsum(count)))
        out = np.empty(at[-1], np.uint64)
        row = np.repeat(np.arange(len(n)), n)
        inner = np.flatnonzero((np.arange(len(h)) + k <= first[row + 1]) if len(h) else np.zeros(0, bool))
        if len(inner):
            out[at[row[inner]] + inner - first[row[inner]]] = gram_hashes(h, k)[inner]
        few = np.flatnonzero((n > 0) & (n < k))
        if len(few):
            out[at[few]] = span_hashes(h, first[few], first[few + 1])
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a > 1:
                out[a:b].sort()
        new = np.ones(len(out), bool)
        new[1:] = out[1:] != out[:-1]
        new[at[:-1][count > 0]] = True
        yield out[new], np.concatenate(([0], np.cumsum(new)))[at]


class Ids:
    """Signed 64-bit ids of sets; those in ``bad``, which several sets share, are made anew with the sets' check values."""

    def __init__(self, bits: int = 64, bad: frozenset[int] = frozenset()):
        self.bits, self.bad = bits, bad

    def of(self, u: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids and the independent check values of the sets u[at[i]:at[i + 1]]."""
        n = len(at) - 1
        total, odd, other = (np.zeros(n, np.uint64) for _ in range(3))
        full = np.flatnonzero(np.diff(at))
        with np.errstate(over="ignore"):
            if len(full):
                m = mix(u)
                total[full] = np.add.reduceat(m, at[full])
                odd[full] = np.bitwise_xor.reduceat(m * np.uint64(0xD6E8FEB86659FD93) ^ u, at[full])
                other[full] = np.add.reduceat(m * (u | np.uint64(1)), at[full])
            ids = mix(total + np.diff(at).astype(np.uint64) ^ mix(odd)) >> np.uint64(64 - self.bits)
            check = mix(other ^ mix(total))
            if self.bad:
                twice = np.flatnonzero(np.isin(ids.view(np.int64), np.fromiter(self.bad, np.int64, len(self.bad))))
                ids[twice] = mix(ids[twice] ^ mix(check[twice]))
        return ids.view(np.int64), check.view(np.int64)


def least_overlap(n: int, percent: int = PERCENT) -> int:
    return -(-percent * n // 100)


def prefix(u: np.ndarray, often: np.ndarray, usual: int, percent: int = PERCENT) -> tuple[np.ndarray, int, int]:
    """Tokens of the lengthened prefix, rarest first, the length of the plain prefix and the number of matches asked for."""
    f = often[(u & np.uint64(len(often) - 1)).astype(np.int64)]
    order = np.argsort(f, kind="stable")  # u is ascending: ties by hash
    need = least_overlap(len(u), percent)
    plain, most = len(u) - need + 1, min(MATCHES_MAX, need)
    load = np.cumsum(np.maximum(0, f[order[: plain + most - 1]].astype(np.int64) - usual))[plain - 1 :]
    cost = load + VERIFY_COST * load / np.arange(1, most + 1)
    n = int(np.argmin(cost)) + 1
    return u[order[: plain + n - 1]], plain, n


def _sketch(parts: DataFrame) -> np.ndarray:
    """Sums the tasks' counters (block, zstandard bytes); what reaches the driver has the sketch's fixed size."""

    def add(pdf):
        import pandas as pd
        import zstandard

        total = sum(np.frombuffer(zstandard.decompress(x), np.uint32).astype(np.uint64) for x in pdf["counts"])
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "counts": [np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()]})

    out = np.zeros((16, COUNTERS // 16), np.uint32)
    for r in parts.groupBy("block").applyInPandas(add, "block int, counts binary").collect():
        out[r["block"]] = np.frombuffer(r["counts"], np.uint32)
    return out.ravel()


# ---------------------------------------------------------------- postings
# meta packs a posting's set size, the token's place in the prefix (from 0) and the matches that the set asks for.


def _size(meta: str | Column) -> Column:
    return F.shiftright(meta, 32)


def _place(meta: str | Column) -> Column:
    return F.shiftright(meta, 4).bitwiseAND((1 << 28) - 1)


def _asked(meta: str | Column) -> Column:
    return (F.col(meta) if isinstance(meta, str) else meta).bitwiseAND(15)


def _partner(meta: str | Column, percent: int) -> Column:
    """The largest partner for which the token stands early enough to be the first shared one: o <= size - place."""
    return F.floor((100 + percent) * (_size(meta) - _place(meta)) / percent).cast("long") - _size(meta)


def _fits(a: str | Column, b: str | Column, percent: int, asked: Column | None = None) -> Column:
    """Whether a shared token counts for two postings: sizes that can be similar, places within the prefixes of that pair for so many matches (one, if not given)."""
    n, m, asked = _size(a), _size(b), F.lit(1) if asked is None else asked
    overlap = F.ceil(percent * (n + m) / (100 + percent))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (_place(a) < n - overlap + asked) & (_place(b) < m - overlap + asked)


def _postings(rows: DataFrame, often: np.ndarray, ids: Ids, percent: int) -> DataFrame:
    """(token, class, meta, others) of the lengthened prefixes where a class of fitting size shares the token; others counts such classes of the token."""
    usual = int(np.median(often))
    posted = pa.schema([("token", pa.int64()), ("class", pa.int64()), ("meta", pa.int64())])
    kept = posted.append(pa.field("others", pa.int64()))

    def emit(batches):
        seen: set[int] = set()
        for b in batches:
            t, c, m, size = [], [], [], 0
            for sets, at in shingle_slices(b.column(0)):
                for q, i, j in zip(ids.of(sets, at)[0].tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    if i == j or q in seen:
                        continue
                    if len(seen) < SEEN_MAX:
                        seen.add(q)
                    tokens, _, n = prefix(sets[i:j], often, usual, percent)
                    t.append(tokens)
                    c.append(np.full(len(tokens), q))
                    m.append((j - i) << 32 | np.arange(len(tokens)) << 4 | n)
                    size += len(tokens)
                if size > 100_000:
                    yield batch(posted, np.concatenate(t).view(np.int64), np.concatenate(c), np.concatenate(m))
                    t, c, m, size = [], [], [], 0
            if t:
                yield batch(posted, np.concatenate(t).view(np.int64), np.concatenate(c), np.concatenate(m))

    def shared(batches):
        """Of rows in order of token, meta and class, the distinct ones that some other class of their token can be a partner of."""
        held = [np.zeros(0, np.int64)] * 3  # the last token's rows, which may go on in the next batch
        large = None  # a token of too many rows to hold: they go on unpruned, which costs work but loses nothing

        def partners(t, c, m):
            first = np.ones(len(t), bool)
            first[1:] = t[1:] != t[:-1]
            group = np.cumsum(first) - 1
            n, place, asked = m >> 32, m >> 4 & (1 << 28) - 1, m & 15
            low, high = -(-percent * n // 100), np.minimum((100 + percent) * (n - place + asked - 1) // percent - n, 100 * n // percent)
            key = group * _FAR + n  # ascending
            other = np.searchsorted(key, group * _FAR + high, "right") - np.searchsorted(key, group * _FAR + low, "left") - (high >= n)
            ok = np.flatnonzero((high >= low) & (other > 0))
            size = np.bincount(group[ok], minlength=len(t))[group[ok]]
            ok, size = ok[size > 1], size[size > 1]
            return batch(kept, t[ok], c[ok], m[ok], size - 1)

        for b in batches:
            t, c, m = (np.concatenate((h, b.column(i).to_numpy(zero_copy_only=False))) for i, h in enumerate(held))
            one = np.ones(len(t), bool)
            one[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
            t, c, m = t[one], c[one], m[one]
            last = int(np.searchsorted(t, t[-1], "left")) if len(t) else 0
            if large is not None and len(t):
                k = int(np.searchsorted(t, large, "right"))
                yield batch(kept, t[:k], c[:k], m[:k], np.full(k, GROUP_ROWS))
                t, c, m, last = t[k:], c[k:], m[k:], max(0, last - k)
                large = large if not len(t) else None
            yield partners(t[:last], c[:last], m[:last])
            held = [t[last:], c[last:], m[last:]]
            if len(held[0]) > GROUP_ROWS:
                large = held[0][0]
                yield batch(kept, *held, np.full(len(held[0]), GROUP_ROWS))
                held = [x[:0] for x in held]
        yield partners(*held)

    dealt = rows.select("text").mapInArrow(tidy(emit), "token long, class long, meta long").repartition("token").sortWithinPartitions("token", "meta", "class")
    return materialize(dealt.mapInArrow(tidy(shared), "token long, class long, meta long, others long"), "jaccard-postings")


# ---------------------------------------------------------------- verification


def parity(u: np.ndarray) -> np.ndarray:
    """A bitmap of 2 to 4 bits a token, of a power of two of bits, in which each token flips one bit.

    The bits in which two such maps differ are no more than the tokens that the sets
    do not share, since a shared token flips the same bit in both.
    """
    bits = max(64, 1 << (2 * len(u) - 1).bit_length())
    out = np.bincount((mix(u) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(out.astype(bool))


def apart_at_least(x: np.ndarray, y: np.ndarray) -> int:
    """A lower bound of the tokens that two sets do not share, by their bitmaps; the longer one is folded."""
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _of_classes(rows: DataFrame, nodes: DataFrame, most: int, ids: Ids, what) -> DataFrame:
    """(class, n, body) of the classes in nodes (and a few others): sizes and what(set) as bytes, one row each."""
    wanted = bloom_of(nodes, "class", most)
    out = pa.schema([("class", pa.int64()), ("n", pa.int64()), ("body", pa.binary())])

    def emit(batches):
        seen: set[int] = set()
        for b in batches:
            for u, at in shingle_slices(b.column(0)):
                c = ids.of(u, at)[0]
                ok = [i for i in np.flatnonzero(wanted.has(c.view(np.uint64)) & (np.diff(at) > 0)).tolist() if not (c[i] in seen or (len(seen) < SEEN_MAX and seen.add(int(c[i]))))]
                for i in range(0, len(ok), 200):
                    part = ok[i : i + 200]
                    yield batch(out, c[part], at[1:][part] - at[part], [what(u[at[k] : at[k + 1]]).tobytes() for k in part])

    return rows.select("text").mapInArrow(tidy(emit), "class long, n long, body binary").dropDuplicates(["class"])


def _compared(pairs: DataFrame, bodies: DataFrame, gap, tag: str) -> DataFrame:
    """(a, b, gap) of the pairs, in either order, for which gap(size a, body a, size b, body b) is not None; the body of the one of more pairs is sent once for PART pairs."""
    many = pairs.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("links"))
    for x in "ab":
        pairs = pairs.join(many.withColumnsRenamed({"class": x, "links": f"links_{x}"}), x)
    turned = F.col("links_a") > F.col("links_b")  # the one of more pairs is the pivot
    pairs = materialize(pairs.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b")), "jaccard-pairs")
    parts = pairs.groupBy("b").agg((F.floor(F.count(F.lit(1)) / PART) + 1).alias("parts"))
    asked = materialize(pairs.join(parts, "b").select("a", "b", F.pmod(F.xxhash64("a"), "parts").alias("part")), "jaccard-asked")
    centres = asked.select(F.col("b").alias("class"), "b", "part", F.lit(None).cast("long").alias("a")).distinct()
    roles = asked.select(F.col("a").alias("class"), "b", "part", "a").union(centres)
    met = bodies.join(roles, "class").select("b", "part", "a", "n", "body")
    link = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("gap", pa.int64())])

    def compare(batches):
        m = x = None
        for rows in batches:
            a, b, g = [], [], []
            for centre, node, n, raw in zip(rows.column(0).to_pylist(), rows.column(2).to_pylist(), rows.column(3).to_pylist(), rows.column(4), strict=True):
                if node is None:
                    m, x = n, raw.as_buffer()
                elif (d := gap(n, raw.as_buffer(), m, x)) is not None:
                    a.append(node)
                    b.append(centre)
                    g.append(d)
            yield batch(link, a, b, g)

    met = met.repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())
    out = materialize(met.mapInArrow(compare, "a long, b long, gap long"), tag)
    release(asked)
    return out


def _alike(pairs: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """(a, b, gap) of the pairs that their bitmaps let be similar: none that is similar is lost, few others stay; gap is the share of tokens apart, in thousandths."""

    def gap(n, x, m, y):
        apart = apart_at_least(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8))
        return 1000 * apart // (n + m) if apart <= n + m - 2 * (-(-percent * (n + m) // (100 + percent))) else None

    return _compared(pairs, bitmaps, gap, "jaccard-alike")


def _verified(pairs: DataFrame, rows: DataFrame, ids: Ids, percent: int) -> DataFrame:
    """The pairs whose sets are similar, by the whole texts of their classes."""

    def gap(n, x, m, y):
        few, many = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
        both = int((many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum())
        return 0 if 100 * both >= percent * (n + m - both) else None

    ends = pairs.select(F.explode(F.array("a", "b")).alias("class"))
    return _compared(pairs, _of_classes(rows, ends, 2 * pairs.count(), ids, lambda u: u), gap, "jaccard-links").select("a", "b")


# ---------------------------------------------------------------- candidates


def _pivots(live: DataFrame) -> DataFrame:
    """(token, p_class, p_meta, p_component): of each token the PIVOTS classes that share most, of those that have not been its pivots."""
    rank = F.row_number().over(Window.partitionBy("token").orderBy(F.desc("score"), "class"))
    best = live.where("not used").withColumn("rank", rank).where(F.col("rank") <= PIVOTS)
    return best.select("token", F.col("class").alias("p_class"), F.col("meta").alias("p_meta"), F.col("component").alias("p_component"))


def _by_pivot(live: DataFrame, pivots: DataFrame, percent: int) -> DataFrame:
    """(a, b): the classes with the pivots, of other components, of each of their tokens."""
    met = live.join(pivots, "token").where("component <> p_component").where(_fits("meta", "p_meta", percent))
    return materialize(met.select(F.least("class", "p_class").alias("a"), F.greatest("class", "p_class").alias("b")).distinct(), "jaccard-pairs")


def _crossing(live: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """(a, b): every candidate pair of two components, a the smaller set.

    A pair has a token in the plain prefixes of its sizes (live has those postings);
    it is a candidate if the prefixes for the matches asked for share as many tokens
    (whole has all postings).
    """
    band = lambda n: F.floor(F.log(n.cast("double")) / math.log(BAND)).cast("int")
    most = F.least(_partner("meta", percent), F.floor(100 * _size("meta") / percent).cast("long"))
    small = live.withColumn("most", most).where(F.col("most") >= _size("meta"))
    small = small.select("token", F.col("class").alias("a"), F.col("meta").alias("am"), F.col("component").alias("ac"), F.explode(F.sequence(band(_size("meta")), band(F.col("most")))).alias("band"))
    large = live.where(100 * _partner("meta", percent) >= percent * _size("meta")).select("token", F.col("class").alias("b"), F.col("meta").alias("bm"), F.col("component").alias("bc"), band(_size("meta")).alias("band"))
    order = (_size("am") < _size("bm")) | ((_size("am") == _size("bm")) & (F.col("a") < F.col("b")))
    met = small.join(large, ["token", "band"]).where((F.col("ac") != F.col("bc")) & order & _fits("am", "bm", percent))
    asked = F.least(_asked("am"), _asked("bm"))
    pairs = materialize(met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.max(asked).alias("asked")), "jaccard-met")
    few = pairs.where("shared < asked").select("a", "b", "asked")
    if no_rows(few):
        return materialize(pairs.select("a", "b"), "jaccard-pairs")
    own = few.join(whole.select(F.col("class").alias("a"), "token", F.col("meta").alias("am")), "a")
    both = own.join(whole.select(F.col("class").alias("b"), "token", F.col("meta").alias("bm")), ["b", "token"]).where(_fits("am", "bm", percent, F.col("asked")))
    enough = both.groupBy("a", "b", "asked").agg(F.count(F.lit(1)).alias("shared")).where("shared >= asked")
    return materialize(pairs.where("shared >= asked").select("a", "b").union(enough.select("a", "b")), "jaccard-pairs")


def _apart(live: DataFrame, group: DataFrame, pivots: DataFrame | None) -> DataFrame:
    """The postings of tokens that classes of two or more components share, with the components of group; the tokens' pivots are used."""
    named = live.drop("component").join(group.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    named = materialize(named, "jaccard-named")
    mixed = named.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("token")
    out = named.join(mixed, "token")
    if pivots is not None:
        own = pivots.select("token", F.col("p_class").alias("class"), F.lit(True).alias("now"))
        out = out.join(own, ["token", "class"], "left").withColumn("used", F.col("used") | F.coalesce("now", F.lit(False))).drop("now")
    out = materialize(out, "jaccard-apart")
    release(named)
    return out


def jaccard_classes(docs: DataFrame, percent: int = PERCENT, ids: Ids | None = None) -> tuple[DataFrame, DataFrame, Ids]:
    """(doc_id, n_shingles, class) of every row, (node, component) of the classes that have links, and the maker of class ids.

    Two different sets never are one class: ids that the sets' check values show
    to be shared (a handful in 10**10 sets) are made anew from both values.
    """
    ids = ids or Ids()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    first = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.int64()), ("checked", pa.int64()), ("block", pa.int32()), ("counts", pa.binary())])

    def describe(batches):
        import zstandard

        often = np.zeros(COUNTERS, np.uint32)
        for b in batches:
            n, c, v = [], [], []
            for u, at in shingle_slices(b.column(1)):
                n.append(np.diff(at))
                own, check = ids.of(u, at)
                c.append(own)
                v.append(check)
                often += np.bincount((u & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS).astype(np.uint32)
            if n:
                yield batch(first, b.column(0), np.concatenate(n), np.concatenate(c), np.concatenate(v), pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary()))
        z, none = zstandard.ZstdCompressor(level=1), [None] * 16
        yield batch(first, none, none, none, none, [*range(16)], [z.compress(x.tobytes()) for x in often.reshape(16, -1)])

    described = materialize(rows.mapInArrow(tidy(describe), "doc_id long, n_shingles long, class long, checked long, block int, counts binary"), "jaccard-docs")
    often = _sketch(described.where("block is not null").select("block", "counts"))
    members = described.where("block is null")
    twice = members.groupBy("class").agg(F.min("checked").alias("x"), F.max("checked").alias("y")).where("x < y")
    bad = frozenset(r[0] for r in twice.select("class").collect())  # sets squared over 2**65: a handful
    if bad:
        ids = Ids(ids.bits, bad)
        again = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.int64())])

        def anew(batches):
            for b in batches:
                parts = [(np.diff(at), ids.of(u, at)[0]) for u, at in shingle_slices(b.column(1))]
                if parts:
                    yield batch(again, b.column(0), np.concatenate([n for n, _ in parts]), np.concatenate([c for _, c in parts]))

        members = materialize(rows.mapInArrow(anew, "doc_id long, n_shingles long, class long"), "jaccard-docs")
    members = members.select("doc_id", "n_shingles", "class")

    posted = _postings(rows, often, ids, percent)
    classes = materialize(posted.groupBy("class").agg(F.sum("others").alias("score")), "jaccard-scores")
    left = classes.count()
    bitmaps = materialize(_of_classes(rows, classes, left, ids, parity), "jaccard-bitmaps")
    whole = posted.drop("others").join(classes, "class").withColumns({"component": F.col("class"), "used": F.lit(False)})
    whole = live = materialize(whole, "jaccard-named")
    release(posted)
    alike = first = None  # pairs that look similar join components for the rounds; they are verified after them
    while left:
        pivots = materialize(_pivots(live), "jaccard-pivots")
        first = pivots if first is None else first
        new = _alike(_by_pivot(live, pivots, percent), bitmaps, percent)
        found = new.count()
        if found:
            alike = new if alike is None else alike.union(new)
        if found <= WORTH * left:
            break
        looks = materialize(components(alike.select("a", "b"), "jaccard-groups"), "jaccard-groups")
        nxt = _apart(live, looks, pivots)
        if live is not whole:
            release(live)
        live = nxt
        left = live.select("class").distinct().count()
    spark = docs.sparkSession
    alike = spark.createDataFrame([], "a long, b long, gap long") if alike is None else alike
    rank = F.row_number().over(Window.partitionBy("a").orderBy("gap", "b"))  # each class's nearest pairs connect most of what is connected
    each = alike.union(alike.select("b", "a", "gap")).withColumn("rank", rank).where(F.col("rank") <= NEAREST)
    each = materialize(each.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "jaccard-pairs")
    links = spark.createDataFrame([], "a long, b long") if no_rows(each) else _verified(each, rows, ids, percent)
    group = materialize(components(links, "jaccard-groups"), "jaccard-groups")
    if first is not None:  # what was met by a first pivot is in alike, or not similar: such pivots' postings meet nothing more
        rest = whole.join(first.select("token", F.col("p_class").alias("class")), ["token", "class"], "left_anti")
        pairs = _alike(_crossing(_apart(rest, group, None), whole, percent), bitmaps, percent).union(alike).select("a", "b").distinct()
        for x in "ab":
            own = group.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
            pairs = pairs.join(own, x, "left").withColumn(f"c{x}", F.coalesce(f"c{x}", x))
        pairs = materialize(pairs.where("ca <> cb").select("a", "b"), "jaccard-pairs")
        if not no_rows(pairs) and not no_rows(new := _verified(pairs, rows, ids, percent)):
            group = materialize(components(links.union(new), "jaccard-groups"), "jaccard-groups")
    for x in (whole, bitmaps, classes):
        release(x)
    return members, group, ids


def jaccard_rows(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, Ids]:
    """(doc_id, n_shingles, class, component) of every row, and the maker of class ids; component is a class id, the same for all rows that links connect, and null without shingles."""
    members, group, ids = jaccard_classes(docs, percent)
    linked = members.where("n_shingles > 0").join(group.withColumnRenamed("node", "class"), "class", "left")
    linked = linked.select("doc_id", "n_shingles", "class", F.coalesce("component", "class").alias("component"))
    return linked.union(members.where("n_shingles = 0").select("doc_id", "n_shingles", "class", F.lit(None).cast("long"))), ids


def jaccard_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for docs (doc_id, text).

    component_id is the smallest doc_id that similar pairs reach, the row's own
    included.  A null or wordless text has no shingles and is linked with nothing;
    rows with equal sets are linked, repeated doc_ids each for its own row (a null
    doc_id takes part and is never the smallest unless alone); an empty table gives
    no rows; other columns are not read.
    """
    members, group, _ = jaccard_classes(docs, percent)
    full = members.where("n_shingles > 0")
    classes = full.groupBy("class").agg(F.min("doc_id").alias("least"))
    named = materialize(classes.join(group.withColumnRenamed("node", "class"), "class", "left").select("class", "least", F.coalesce("component", "class").alias("component")), "jaccard-classes")
    roots = named.groupBy("component").agg(F.min("least").alias("component_id"))
    told = materialize(named.join(roots, "component").select("class", "component_id"), "jaccard-roots")
    linked = full.join(told, "class").select("doc_id", "n_shingles", "component_id")
    return linked.union(members.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs without near copies: of each group of linked rows one stays, that of the least doc_id (nulls last, ties by content).

    Rows are decided, not ids: a doc_id that several rows share keeps each of its
    rows that is first in its own group.  Rows without shingles all stay.
    """
    group, ids = jaccard_rows(docs, percent)
    group = materialize(group, "jaccard-rows")
    chosen = group.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("class"))).alias("x")).select(F.col("x.doc_id").alias("_id"), F.col("x.class").alias("_class"))
    chosen = materialize(chosen, "jaccard-kept")
    again = materialize(group.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("_id")), "jaccard-again")
    gone = group.join(chosen, (F.col("doc_id").eqNullSafe(F.col("_id"))) & (F.col("class") == F.col("_class")), "left_anti").where("component is not null").select(F.col("doc_id").alias("_id")).distinct()
    own = F.col("doc_id").cast("long")
    if no_rows(again):
        return docs.join(gone, own == F.col("_id"), "left_anti")
    single = docs.join(again, own.eqNullSafe(F.col("_id")), "left_anti").join(gone, own == F.col("_id"), "left_anti")
    kept = [*docs.columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", _c long, _n long"
    at = next(i for i, c in enumerate(kept) if c.lower() == "text")

    def classed(batches):
        for b in batches:
            parts = [(np.diff(a), ids.of(u, a)) for u, a in shingle_slices(b.column(at).cast(pa.string()).fill_null(""))]
            c, n = (np.concatenate([p[1][0] for p in parts]), np.concatenate([p[0] for p in parts])) if parts else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(c, pa.int64()), pa.array(n, pa.int64())], names=[*b.schema.names, "_c", "_n"])

    several = docs.join(again, own.eqNullSafe(F.col("_id")), "left_semi").mapInArrow(classed, schema)
    order = Window.partitionBy("doc_id", "_c").orderBy(*[F.col(f"`{c}`") for c in kept if c.lower() != "doc_id"])
    first = several.where("_n > 0").join(chosen, own.eqNullSafe(F.col("_id")) & (F.col("_c") == F.col("_class")), "left_semi").withColumn("_r", F.row_number().over(order)).where("_r = 1")
    cols = [F.col(f"`{c}`") for c in kept]
    return single.select(*cols).union(first.select(*cols)).union(several.where("_n = 0").select(*cols))
