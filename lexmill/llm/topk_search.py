"""Exact top-k inner products by MaxScore over inverted lists of signed terms.

A vector's components are its terms.  In a block of candidates each dimension has
two posting lists, of the positive and of the negative components, with their
greatest magnitudes; a query's term meets the list of its own sign and adds at
most |q| times that bound, while components of the other sign only lower a score.
Terms are split by these bounds: the essential ones are the fewest without which
no candidate can reach the query's current k-th score.  Essential postings are
traversed; the other terms are probed in order of their bounds for the candidates
that still can compete.  Each task keeps k results a query; shards are merged by
a keyed ranking.
"""

from __future__ import annotations

import bisect
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, materialize

#: Candidates in a block, queries that are broadcast at once, terms probed together.
BLOCK, QUERIES, PROBE = 8192, 4096, 4


def exact_type(dim: int, *greatest: int):
    """The fastest type in which sums of products of such magnitudes are exact: float64, int64, or Python's integers."""
    bound = max(1, dim)
    for x in greatest:
        bound *= max(1, x)
    return np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object


def magnitude(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


class Block:
    """Postings of a block: components by dimension, and each signed list's members and bound."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, kind=np.float64):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], np.ascontiguousarray(x[order].T.astype(kind))
        self.bound = np.stack([np.maximum(self.x, 0).max(axis=1), np.maximum(-self.x, 0).max(axis=1)])
        self.lists = [(self.x > 0), (self.x < 0)]


def search(block: Block, query_id: int, q: np.ndarray, k: int, best: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The k best (score, -id) of best and the block's candidates, highest score first, ties to the smaller id."""
    if not len(q):
        return _merged(block, query_id, np.arange(len(block.ids)), np.zeros(len(block.ids)), k, best)
    floor = best[-1][0] if len(best) >= k else None
    q = q.astype(block.x.dtype)
    sign = (q < 0).astype(int)
    bound = np.abs(q) * block.bound[sign, np.arange(len(q))]
    order = np.argsort(-bound, kind="stable")
    rest = [0]  # what the terms from a place on can add, as exact integers
    for x in bound[order][::-1].tolist():
        rest.append(rest[-1] + int(x))
    rest.reverse()
    n = len(q) if floor is None else bisect.bisect_left(rest, True, key=lambda r: r < floor)  # essential: rest[n] < floor
    n = min(n, len(q))
    if n == 0:
        return best
    floor = -(1 << 200) if floor is None else floor
    own = order[:n]
    if n < len(q):
        met = np.zeros(len(block.ids), bool)
        for d in own:
            met |= block.lists[sign[d]][d]
        live = np.flatnonzero(met)
    else:
        live = np.arange(len(block.ids))
    score = q[own] @ (block.x[own] if len(live) == len(block.ids) else block.x[np.ix_(own, live)])
    for at in range(n, len(q), PROBE):
        keep = score + rest[at] >= floor
        live, score = live[keep], score[keep]
        if not len(live):
            return best
        more = order[at : at + PROBE]
        score = score + q[more] @ block.x[np.ix_(more, live)]
    keep = score >= floor
    return _merged(block, query_id, live[keep], score[keep], k, best)


def _merged(block: Block, query_id: int, live: np.ndarray, score: np.ndarray, k: int, best: list) -> list:
    other = block.ids[live] != query_id
    live, score = live[other], score[other]
    if len(live) > k:
        top = np.lexsort((block.ids[live], -score))[:k]
        live, score = live[top], score[top]
    return sorted(itertools.chain(best, zip(map(int, score.tolist()), (-block.ids[live]).tolist(), strict=True)), reverse=True)[:k]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) for vectors and queries (vec_id long, x array<long>).

    All vectors of a query's length but those of its own id are candidates (vectors
    of no components score 0).  Scores are exact; one beyond 64 bits is given as the
    nearest long, but ranked by its true value within a task.  Equal query rows count
    once; a query_id of several vectors gets the k best results of them all; repeated
    candidate rows count each.  Queries go to the executors in blocks of a fixed number, read
    from a written table as they are needed; the vectors are scanned once for each
    block.  An empty side gives no rows.
    """
    spark = vectors.sparkSession
    stored = materialize(queries.select("vec_id", "x").dropDuplicates(["vec_id", "x"]), "topk-queries")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    results, rows = [], stored.toLocalIterator()
    while part := [*itertools.islice(rows, QUERIES)]:
        by_length: dict[int, list] = {}
        for r in part:
            by_length.setdefault(len(r["x"]), []).append(r)
        shared = spark.sparkContext.broadcast({dim: (np.array([r["vec_id"] for r in own], np.int64), np.array([r["x"] for r in own], np.int64).reshape(len(own), dim)) for dim, own in by_length.items()})

        def run(batches, shared=shared):
            best: dict[int, list[list]] = {dim: [[] for _ in ids] for dim, (ids, _) in shared.value.items()}
            for b in batches:
                width = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
                for dim in {*width.tolist()} & best.keys():
                    own = b.filter(pa.array(width == dim))
                    q_ids, q = shared.value[dim]
                    ids = own.column(0).to_numpy(zero_copy_only=False)
                    x = own.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
                    for i in range(0, len(ids), BLOCK):
                        part_ = x[i : i + BLOCK]
                        block = Block(ids[i : i + BLOCK], part_, exact_type(dim, magnitude(part_), magnitude(q)))
                        for j in range(len(q_ids)):
                            best[dim][j] = search(block, int(q_ids[j]), q[j], k, best[dim][j])
            least, most = -(1 << 63), (1 << 63) - 1
            for dim, (q_ids, _) in shared.value.items():
                for i in range(0, len(q_ids), 1000):
                    rows_ = [(int(q_ids[j]), -v, max(least, min(most, s))) for j in range(i, min(i + 1000, len(q_ids))) for s, v in best[dim][j]]
                    yield batch(schema, *([*zip(*rows_, strict=True)] if rows_ else ([], [], [])))

        found = vectors.select("vec_id", "x").mapInArrow(run, "query_id long, vec_id long, score long")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        results.append(found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
        if len(results) > 8:
            results = [materialize(_union(results), "topk-results")]
    return _union(results) if results else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def integer_vectors(embeddings: DataFrame, vec_id: Column, embedding: Column, scale: int = 1024) -> DataFrame:
    """(vec_id, x) with x = floor(scale * component); rows whose vector is null or has a null or non-finite component are left out."""
    ok = embedding.isNotNull() & F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return embeddings.where(vec_id.isNotNull() & F.coalesce(ok, F.lit(False))).select(vec_id.cast("long").alias("vec_id"), F.transform(embedding, lambda v: F.floor(v.cast("double") * scale)).alias("x"))
