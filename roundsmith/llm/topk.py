"""Exact top-k by integer inner product with pivot-table elimination.

Every vector's distances to many far-apart ``pivots`` are computed once and stored with it.  The distances of a
query and of a candidate to the pivots bound their own distance from below.  In Euclidean space the largest
bound that all of them imply together is found by trilateration: distances give the coordinates in the
pivots' span, and what is left outside the span has a known length, so

    d(q, x)^2 >= |coordinates(q) - coordinates(x)|^2 + (rest(q) - rest(x))^2,

which is at least the triangle inequality's bound for every single pivot.  With 2 <q, x> = |q|^2 + |x|^2 - d(q, x)^2 it
bounds the inner product from above.  A task evaluates each query's candidates in descending order of these bounds until the
bound falls below the k-th best score, so the result is exact.  The k-th score starts from a sample's and
is carried from batch to batch.

Queries go in blocks of ``query_block`` (a bounded broadcast) against all candidates; each task returns
its k best for each query of the block and these meet by query.

Cases: a vector that is null, or holds a null or non-finite component, takes no part; vectors of one
vec_id count once (the smallest of them) and never are candidates of their own query; equal scores go to
the smaller vec_id; vectors of differing lengths never meet; fewer than k candidates give fewer rows; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roundsmith.llm.common import stored

SCALE = 64


def far_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first traversal of a bounded sample."""
    if len(sample) == 0:
        return sample
    chosen, least = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(n, len(sample)):
        least = np.minimum(least, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(least.argmax()))
    return sample[chosen]


def pivot_table(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of every vector to every pivot."""
    square = (vectors**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None] - 2 * vectors @ pivots.T
    return np.sqrt(np.maximum(square, 0))


class Trilateration:
    """Coordinates in the pivots' span, and the length of the rest, from distances and norms alone."""

    def __init__(self, pivots: np.ndarray):
        self.square = (pivots**2).sum(axis=1)
        values, axes = np.linalg.eigh(pivots @ pivots.T)
        held = values > 1e-9 * max(values.max(initial=0), 1)
        self.map = axes[:, held] / np.sqrt(values[held])

    def __call__(self, table: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``norms`` are squared."""
        inner = (norms[:, None] + self.square[None] - table**2) / 2
        at = inner @ self.map
        return at, np.sqrt(np.maximum(norms - (at**2).sum(axis=1), 0))


class Search:
    """The k best of each query among the batches seen; queries of ids ``query_ids``."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, own_table: np.ndarray, pivots: np.ndarray, k: int, seeds: np.ndarray | None = None):
        self.queries, self.query_ids, self.k = queries, query_ids, k
        self.place = Trilateration(pivots)
        self.norms = (queries**2).sum(axis=1)
        self.at, self.rest = self.place(own_table, self.norms)
        self.least = np.full(len(queries), -np.inf) if seeds is None else seeds.astype(np.float64)
        self.ids = [np.zeros(0, np.int64)] * len(queries)
        self.scores = [np.zeros(0)] * len(queries)
        self.evaluated = self.asked = 0

    def add(self, ids: np.ndarray, vectors: np.ndarray, table: np.ndarray, step: int = 128, rows: int = 128) -> None:
        norms = (vectors**2).sum(axis=1)
        at, rest = self.place(table, norms)
        for a in range(0, len(self.queries), rows):
            # <q, x> is at most the product within the span plus the product of the rests' lengths.
            bounds = self.at[a:a + rows] @ at.T + self.rest[a:a + rows, None] * rest[None]
            bounds += 1e-6 * (1 + self.norms[a:a + rows, None])
            open_ = bounds >= self.least[a:a + rows, None]
            for n in range(a, min(a + rows, len(self.queries))):
                self._one(n, np.flatnonzero(open_[n - a]), bounds[n - a], ids, vectors, step)
        self.asked += len(self.queries) * len(ids)

    def _one(self, n: int, some: np.ndarray, bound: np.ndarray, ids: np.ndarray, vectors: np.ndarray, step: int) -> None:
        some = some[ids[some] != self.query_ids[n]]
        some = some[np.argsort(-bound[some], kind="stable")]
        begin = 0
        while begin < len(some) and bound[some[begin]] >= self.least[n]:
            these = some[begin:begin + step]
            these = these[bound[these] >= self.least[n]]
            self.evaluated += len(these)
            score = vectors[these] @ self.queries[n]
            fit = score >= self.least[n]
            own, score = np.append(self.ids[n], ids[these[fit]]), np.append(self.scores[n], score[fit])
            best = np.lexsort((own, -score))[: self.k]
            self.ids[n], self.scores[n] = own[best], score[best]
            if len(best) == self.k:
                self.least[n] = max(self.least[n], self.scores[n][-1])
            begin, step = begin + step, step * 2

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query ids, ids, scores."""
        if not self.ids:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return np.repeat(self.query_ids, [len(i) for i in self.ids]), np.concatenate(self.ids), np.concatenate(self.scores)


def seed_scores(queries: np.ndarray, query_ids: np.ndarray, sample: np.ndarray, sample_ids: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th best score within the sample: no smaller than that is its k-th best of all."""
    scores = queries @ sample.T
    scores[query_ids[:, None] == sample_ids[None]] = -np.inf
    if scores.shape[1] < k:
        return np.full(len(queries), -np.inf)
    return np.sort(scores, axis=1)[:, -k]


def top_k(table: DataFrame, is_query, k: int = 20, pivots: int = 56, sample: int = 1024, query_block: int = 4096) -> DataFrame:
    """``table(vec_id, embedding)``; ``is_query`` selects the query rows. query_id, rank, vec_id, score."""
    spark = table.sparkSession
    raw = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    scaled = table.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(raw, lambda x: F.floor(x * SCALE)).alias("v")).where(F.size("v") > 0)
    vectors = stored(scaled.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    sizes = [r.n for r in vectors.select(F.size("v").alias("n")).distinct().collect()]  # the vector lengths in use
    parts = []
    schema = "query_id long, vec_id long, score long"
    for length in sizes:
        rows = vectors.where(F.size("v") == length).orderBy(F.xxhash64("vec_id")).limit(sample).collect()  # at most ``sample`` rows
        sample_ids, sampled = np.array([r.vec_id for r in rows]), np.array([r.v for r in rows], np.float64)
        far = far_pivots(sampled, pivots)
        own = stored(vectors.where(F.size("v") == length).mapInArrow(_with_distances(far), "vec_id long, v array<long>, distances array<double>"), "pivot-table")
        asked = own.where(is_query)
        blocks = max(1, -(-asked.count() // query_block))
        for block in range(blocks):
            chosen = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).collect()  # about query_block rows
            if not chosen:
                continue
            query_ids, queries = np.array([r.vec_id for r in chosen]), np.array([r.v for r in chosen], np.float64)
            seeds = seed_scores(queries, query_ids, sampled, sample_ids, k)
            held = spark.sparkContext.broadcast((queries, query_ids, np.array([r.distances for r in chosen], np.float64), far, k, seeds))

            def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
                search = Search(*held.value)
                for batch in batches:
                    if batch.num_rows:
                        search.add(batch.column("vec_id").to_numpy(), _matrix(batch, "v"), _matrix(batch, "distances"))
                found = search.found()
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in found], names=["query_id", "vec_id", "score"])

            parts.append(own.mapInArrow(run, schema))
    found = reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.float64)


def _with_distances(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                table = pivot_table(_matrix(batch, "v"), pivots)
                ends = pa.array(np.arange(batch.num_rows + 1) * table.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.ListArray.from_arrays(ends, pa.array(table.reshape(-1)))], names=["vec_id", "v", "distances"])

    return run
