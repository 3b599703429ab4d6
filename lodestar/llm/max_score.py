"""Exact top-k inner products by MaxScore over shards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import Scratch, keep

#: Shards at least, rows of a shard and queries of a block at most (give or take the spread of a hash): they bound a task's memory.
SHARDS, SHARD_ROWS, QUERY_BLOCK = 32, 65_536, 8192
#: Rows of a shard that are traversed at a time, and terms that are probed at a time.
CHUNK, PROBE = 1024, 16
#: Scores are exact in double precision below this; beyond it whole numbers of any size are used.
_EXACT = 2**53
_LONG = 2**63 - 1


class Postings:
    """A shard's vectors by term: the term of a component has a posting of every vector, so its list is a column; bounds are each column's least and greatest value."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.low, self.high = weights.min(axis=0), weights.max(axis=0)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The most that a term can add to a query's score of any vector of the shard."""
        return np.maximum(queries * self.low, queries * self.high)


def competitive(queries: np.ndarray, postings: Postings, at: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of all pairs of the postings' rows `at` whose score may reach the query's floor, scores complete.

    A query's terms in order of their bounds: those whose bounds together stay below the floor are non-essential. The
    lists of the essential ones are traversed. The others are probed from the greatest bound down, for vectors only
    whose score so far and remaining bounds still reach the floor.
    """
    x = postings.weights[at]
    bounds = postings.bounds(queries)
    order = np.argsort(bounds, axis=1)
    rising = np.cumsum(np.take_along_axis(bounds, order, axis=1), axis=1)
    few = (rising < floor[:, None]).cumprod(axis=1).sum(axis=1)  # non-essential terms of each query
    place = np.argsort(order, axis=1)  # of a term in its query's order
    score = np.where(place >= few[:, None], queries, 0.0) @ x.T
    left = np.where(few > 0, np.take_along_axis(rising, np.maximum(few - 1, 0)[:, None], axis=1)[:, 0], 0.0)
    alive = score + left[:, None] >= floor[:, None]
    top = int(few.max(initial=0))
    i, j = None, None
    for done in range(0, top, PROBE):
        probed = (place < (few - done)[:, None]) & (place >= (few - done - PROBE)[:, None])
        terms = np.where(probed, queries, 0.0)
        left = left - np.where(probed, bounds, 0.0).sum(axis=1)
        if i is None and alive.mean() > 0.1:  # still many: the lists as a whole
            score += terms @ x.T
            alive &= score + left[:, None] >= floor[:, None]
            continue
        if i is None:
            i, j = np.nonzero(alive)
            score = score[i, j]
        for k in range(0, len(i), 65_536):
            score[k : k + 65_536] += np.einsum("ij,ij->i", terms[i[k : k + 65_536]], x[j[k : k + 65_536]])
        stays = score + left[i] >= floor[i]
        i, j, score = i[stays], j[stays], score[stays]
    if i is None:
        i, j = np.nonzero(alive)
        score = score[i, j]
    return i, at[j], score


def best_of(query: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k highest scores, ties to the smaller id."""
    order = np.lexsort((ident, -score, query))
    q = query[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return order[rank < k]


def shard_top(queries: np.ndarray, own: np.ndarray, weights: np.ndarray, rows: np.ndarray, ident: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of each query's k best rows of a shard, its own row left out."""
    if not len(queries) or not len(weights):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not weights.shape[1] or weights.shape[1] * float(np.abs(queries.astype(float)).max(initial=0)) * float(np.abs(weights.astype(float)).max(initial=0)) >= _EXACT:
        return _huge(queries, own, weights, rows, ident, k)
    q, x = queries.astype(float), weights.astype(float)
    postings = Postings(x)
    falling = np.argsort(-np.einsum("ij,ij->i", x, x), kind="stable")  # long vectors first: they raise the floors soon
    floor = np.full(len(q), -np.inf)
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    for start in range(0, len(x), CHUNK):
        at = falling[start : start + CHUNK]
        i, j, s = competitive(q, postings, at, floor)
        other = own[i] != rows[j]
        i, j, s = np.r_[best[0], i[other]], np.r_[best[1], j[other]], np.r_[best[2], s[other]]
        top = best_of(i, s, ident[j], k)
        best = (i[top], j[top], s[top])
        counts = np.bincount(best[0], minlength=len(q))
        lowest = np.full(len(q), np.inf)
        np.minimum.at(lowest, best[0], best[2])
        floor = np.where(counts == k, lowest, -np.inf)
    return best[0], best[1], best[2].astype(np.int64)


def _huge(queries, own, weights, rows, ident, k):
    """The same for vectors without components, and for such large ones that doubles are not exact: whole numbers of any size, scores held within a long."""
    x, out = [[int(c) for c in v] for v in weights], []
    for i, q in enumerate(queries):
        q = [int(c) for c in q]
        scores = [(-max(-_LONG - 1, min(_LONG, sum(a * b for a, b in zip(q, v)))), int(ident[j]), j) for j, v in enumerate(x) if own[i] != rows[j]]
        out += [(i, j, -s) for s, _, j in sorted(scores)[:k]]
    i, j, s = zip(*out) if out else ((), (), ())
    return np.array(i, np.int64), np.array(j, np.int64), np.array(s, np.int64)


def top_scores(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, shards: int = SHARDS, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Vectors -> (query_id, rank int from 1, vec_id, score long): the k highest inner products of each query with all other rows.

    Each component x counts as floor(scale * x), held within a long. is_query is a condition on the columns of
    `vectors`; null is no. Vectors that are null or hold null or non-finite components take no part; vectors of
    different length never meet, empty ones have score 0 with each other. Ties go to the smaller id, null ids last. A
    row of a repeated id is a query and a candidate of its own. Fewer candidates than k: all of them. Further columns
    are ignored. Scores beyond a long are held at its ends.

    Queries and candidates are dealt by hashes of their rows: a task holds one block of queries and one shard, and
    gives k rows for each of its queries, which are merged. Shards and blocks are of bounded size, whatever is equal.
    """
    scratch = Scratch()
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    raw = vectors.select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.col(vector_col).cast("array<double>").alias("v"))
    raw = raw.where(F.col("v").isNotNull() & F.forall("v", finite))
    rows = scratch(raw.select(F.monotonically_increasing_id().alias("row"), "id", "asks", F.transform("v", lambda x: F.floor(F.lit(scale) * x).cast("long")).alias("w"), F.size("v").alias("len")))
    total, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    shards, blocks = max(shards, -(-total // shard_rows)), max(1, -(-asking // query_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = lambda salt, n: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("int")
    asked = rows.where("asks").select("row", "id", "w", "len", cell(1, blocks).alias("block")).select("*", every(shards).alias("shard"))
    dealt = rows.select("row", "id", "w", "len", cell(2, shards).alias("shard")).select("*", every(blocks).alias("block"))

    def matrix(t: pa.Table) -> np.ndarray:
        n = t.num_rows
        flat = t.column("w").combine_chunks().flatten() if n else pa.array([], pa.int64())
        return flat.to_numpy(zero_copy_only=False).reshape(n, -1) if len(flat) else np.zeros((n, 0), np.int64)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = right.column("id").fill_null(_LONG).to_numpy()
        i, j, score = shard_top(matrix(left), left.column("row").to_numpy(), matrix(right), right.column("row").to_numpy(), ids, k)
        return pa.table({"row": left.column("row").take(pa.array(i)), "query_id": left.column("id").take(pa.array(i)), "vec_id": right.column("id").take(pa.array(j)), "score": pa.array(score, pa.int64())})

    keys = ["block", "shard", "len"]
    found = asked.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(search, "row long, query_id long, vec_id long, score long")
    by_score = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    top = found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    top, _ = keep(top)
    scratch.clear()
    return top
