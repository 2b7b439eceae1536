"""Exact top-k inner products over an impact-ordered index, score at a time.

Vectors become integers, floor(256 * x). Each batch of candidates in a task is one block with an index of its own: posting segments by
descending quantised impact, level 0 the (dimension, vector, value) postings with the largest values, each next level those of less
than half as much. Queries run against the index level by level, adding each segment's contributions to the scores so far. After a
level, what a vector can still gain or lose is bounded by the query's weights and the vector's remaining impacts. A query is done with
a block when the k-th best sure score, of this block or of those that the task has seen before, proves that only a few can still get
in; these few are then scored from the whole vectors. Without such a proof the last level is reached, where the scores are exact.
A block that cannot reach a query's k-th best so far by its largest norm is skipped as a whole.

Queries are the stated, small side: they are broadcast, at most ``query_bytes`` of them at a time, and further ones in passes of their
own over the candidates. So candidates are neither copied nor shuffled, and of each task only the k best a query go on.

Cases: vectors that are null or have a null or non-finite component are left out, as queries too. Shorter vectors count
as padded with zeros; an empty vector scores 0. Equal scores rank by the smaller id. Rows with a null id take no part. Fewer
candidates than k give as many rows as there are. Repeated ids are repeated candidates, none its own id's; a query id that occurs
several times is one query for each, whose results are ranked together. An empty table gives no rows; of longer vectors only as many
components count as the longest query has. Other columns are never read, so their names are no matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, quoted

LEVELS = 6
RESULT = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, vec: str = "embedding", vec_id: str = "vec_id", scale: int = 256) -> DataFrame:
    """Rows (id, q): integer vectors of those rows that are complete and finite."""
    v, x = F.col(quoted(vec)), F.col(quoted(vec_id))
    good = v.isNotNull() & x.isNotNull() & F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    return vectors.where(good).select(x.alias("id"), F.transform(v, lambda c: F.floor(c.cast("double") * float(scale)).cast("long")).alias("q"))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A list column as rows of integers, padded with zeros or cut to ``width``, beyond which no query has a value."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = flat.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values, row = flat.flatten().to_numpy(), np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out, inside = np.zeros((len(lengths), width), dtype=np.int64), place < width
    out[row[inside], place[inside]] = values[inside]
    return out


class ImpactIndex:
    """Posting segments of one block of vectors, by descending impact: for each level and dimension the vectors and their values."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, levels: int = LEVELS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        rest = self.vectors.astype(float)
        self.norm = np.sqrt((rest * rest).sum(1)).max(initial=0)
        self.largest = int(np.abs(self.vectors).max(initial=0))
        self.segments, self.left = [], []
        for i in range(levels):
            size = np.abs(rest)
            floor = -1 if i == levels - 1 else max(self.largest, 1) >> (i + 1)
            vec, dim = np.nonzero((size > max(floor, 0)))
            by_dim = np.argsort(dim, kind="stable")
            vec, dim = vec[by_dim], dim[by_dim]
            self.segments.append((vec, rest[vec, dim], np.searchsorted(dim, np.arange(rest.shape[1] + 1))))
            rest[vec, dim] = 0
            self.left.append((np.sqrt((rest * rest).sum(1)), np.abs(rest).max(1, initial=0)))

    def add(self, scores: np.ndarray, weights: np.ndarray, level: int) -> None:
        """Adds a level's contributions to the scores (queries x vectors). Levels in which most vectors have postings go as one product."""
        vec, value, bounds = self.segments[level]
        if len(vec) * 8 > self.vectors.size:
            dense = np.zeros(self.vectors.shape)
            dense[vec, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))] = value
            scores += weights @ dense.T
            return
        for d in np.flatnonzero(np.diff(bounds)):
            a, b = bounds[d], bounds[d + 1]
            scores[:, vec[a:b]] += weights[:, d, None] * value[a:b]


class Best:
    """The k best (score, id) of each query that a task has seen so far."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        self.query_ids, self.queries, self.k = query_ids, queries, k
        self.weights = queries.astype(float)
        self.norm, self.total = np.sqrt((self.weights**2).sum(1)), np.abs(self.weights).sum(1)
        self.at, self.ids, self.scores = (np.empty(0, np.int64) for _ in range(3))
        self.floor = np.full(len(queries), -np.inf)

    def see(self, index: ImpactIndex, few: int = 64) -> None:
        open_ = np.flatnonzero(self.norm * index.norm * (1 + 1e-9) + 1e-6 >= self.floor)
        for a in range(0, len(open_), 256):
            self._see(index, open_[a : a + 256], few)
        order = np.lexsort((self.ids, -self.scores, self.at))
        at = self.at[order]
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        rank = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at)))) if len(at) else at
        keep = order[rank < self.k]
        self.at, self.ids, self.scores = self.at[keep], self.ids[keep], self.scores[keep]
        last = rank[rank < self.k] == self.k - 1
        self.floor[self.at[last]] = self.scores[last].astype(float)

    def _see(self, index: ImpactIndex, rows: np.ndarray, few: int) -> None:
        n = len(index.ids)
        scores = np.zeros((len(rows), n))
        own = index.ids[None, :] == self.query_ids[rows][:, None]
        for level, (l2, largest) in enumerate(index.left):
            last = level == len(index.left) - 1
            index.add(scores, self.weights[rows], level)
            reach = np.minimum(np.outer(self.norm[rows], l2), np.outer(self.total[rows], largest)) * (1 + 1e-9) + 1e-6
            sure = np.where(own, -np.inf, scores - reach)
            floor = np.maximum(self.floor[rows], np.partition(sure, n - self.k, axis=1)[:, n - self.k] if n >= self.k else -np.inf)
            may = (scores + reach >= floor[:, None]) & ~own
            done = np.ones(len(rows), bool) if last else may.sum(1) <= few
            self._score(index, rows[done], may[done])
            rows, scores, own = rows[~done], scores[~done], own[~done]
            if not len(rows):
                return

    def _score(self, index: ImpactIndex, rows: np.ndarray, may: np.ndarray) -> None:
        """Exact scores of the possible members, from the whole vectors."""
        i, j = np.nonzero(may)
        fits = index.largest * int(np.abs(self.queries).max(initial=0)) * max(self.queries.shape[1], 1) < 2**62
        for a in range(0, len(i), 100_000):
            q, v = self.queries[rows[i[a : a + 100_000]]], index.vectors[j[a : a + 100_000]]
            exact = (q * v).sum(1) if fits else np.array([sum(x * y for x, y in zip(*z)) for z in zip(q.tolist(), v.tolist())])
            self.at, self.ids, self.scores = np.concatenate([self.at, rows[i[a : a + 100_000]]]), np.concatenate([self.ids, index.ids[j[a : a + 100_000]]]), np.concatenate([self.scores, exact])


def search(vectors: DataFrame, is_query: Column, k: int = 5, vec: str = "embedding", vec_id: str = "vec_id", block: int = 4096, query_bytes: int = 32 << 20) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k best other vectors of each vector for which ``is_query`` holds.

    ``is_query`` refers to the column ``id``.
    """
    rows = checkpointed(quantised(vectors, vec, vec_id))
    queries = rows.where(is_query)
    nq, width = queries.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    passes = max(1, -(-nq * max(width, 1) * 8 // query_bytes))
    found = None
    for p in range(passes):
        # one part of the queries, bounded by ``query_bytes``
        part = (queries if passes == 1 else queries.where(F.pmod(F.xxhash64("id", F.lit("pass")), F.lit(passes)) == p)).toArrow()
        shared = vectors.sparkSession.sparkContext.broadcast((part.column("id").to_numpy(), matrix(part.column("q"), width)))

        def best(batches, shared=shared):
            held = Best(*shared.value, k)
            for batch in batches:
                for a in range(0, batch.num_rows, block):
                    piece = batch.slice(a, block)
                    held.see(ImpactIndex(piece.column(0).to_numpy(), matrix(piece.column(1), width)))
            yield pa.RecordBatch.from_arrays([pa.array(held.query_ids[held.at], pa.int64()), pa.array(held.ids, pa.int64()), pa.array(held.scores, pa.int64())], names=["query_id", "vec_id", "score"])

        one = rows.mapInArrow(best, RESULT)
        found = one if found is None else found.unionByName(one)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
