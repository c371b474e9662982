"""Exact top-k inner products by columnar branch-and-bound.

Queries are the rows whose ``vec_id`` is divisible by ``EVERY``.  They are written once and go out in passes
of bounded size; in a pass every partition of candidates answers the pass's queries with its own best k, which
then meet by query.  Rows times queries is the work that the stated query set asks for; nothing but k rows
for each query and partition leaves a task.  With more than one pass, each one's answers are written before
the next begins, so that the driver holds one pass of queries and plans don't grow.

Within a task the candidates lie in vertical layout, a row for each dimension.  Scores add up dimension
block by block, the query's blocks of largest mass first.  After each block a candidate's score lies within
the product of the remaining masses (Cauchy-Schwarz) of what it has so far; the k-th largest of the lower
ends raises the threshold, candidates whose upper end is below it go, and the survivors are compacted.
The threshold of a query is carried from one chunk of candidates to the next.

Defined cases: vectors that are null or hold null or non-finite components, and rows without a
``vec_id``, take no part; an empty vector scores 0; only vectors of a query's length are its
candidates; rows with a query's own id are never its candidates; other rows of equal ids each count;
ties go to the smaller id; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm import shared

EVERY, K, SCALE = 50, 5, 256
#: Dimensions of a block; bytes of the queries of a pass; candidates handled at once; masses up to which sums in doubles are exact.
DIMS, QUERY_BYTES, CHUNK, EXACT = 8, 32 << 20, 16_384, 2.0**52


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and v, an array of longs, of the vectors that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    kept = whole.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return kept.select("vec_id", F.transform("embedding", lambda x: F.floor(x * SCALE)).alias("v"))


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), sizes


class Chunk:
    """Candidates in vertical layout: a row for each dimension, and the squared mass of each block of dimensions."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.ids, wide = ids, vectors.astype(np.float64)
        self.starts = list(range(0, vectors.shape[1], DIMS))
        self.masses = np.stack([(wide[:, a : a + DIMS] ** 2).sum(axis=1) for a in self.starts]) if self.starts else np.zeros((0, len(ids)))
        self.most = float(self.masses.sum(axis=0).max(initial=0.0))
        self.columns = np.ascontiguousarray((wide if self.most < EXACT else vectors).T)
        self.whole = vectors


def best(query: np.ndarray, own: int, chunk: Chunk, k: int, floor_: float = -np.inf) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(ids, scores) of the k best candidates that reach ``floor_``, and how many candidates each block touched."""
    wide = query.astype(np.float64)
    mass = np.array([(wide[a : a + DIMS] ** 2).sum() for a in chunk.starts])
    exact = max(chunk.most, float(mass.sum())) < EXACT
    asked, columns = (wide, chunk.columns) if exact and chunk.columns.dtype == np.float64 else (query, chunk.whole.T)
    order = np.argsort(-mass, kind="stable")
    alive, touched = np.flatnonzero(chunk.ids != own), []
    score = np.zeros(len(alive), columns.dtype)
    rest = chunk.masses[:, alive].sum(axis=0)
    left = float(mass.sum())
    for i in order:
        touched.append(len(alive))
        a = chunk.starts[i]
        score = score + asked[a : a + DIMS] @ (columns[a : a + DIMS] if len(alive) == len(chunk.ids) else columns[a : a + DIMS, alive])
        left, rest = max(0.0, left - float(mass[i])), np.maximum(0.0, rest - chunk.masses[i, alive])
        slack = np.sqrt(left * rest) * (1 + 1e-9) + 1e-6 * (1 + np.sqrt(left))
        if len(alive) > 4 * k:
            low = score - slack
            floor_ = max(floor_, float(low[np.argpartition(low, len(low) - k)[-k:]].min()))
        on = score + slack >= floor_
        if not on.all():
            alive, score, rest = alive[on], score[on], rest[on]
    score = score.astype(np.int64)
    first = np.lexsort((chunk.ids[alive], -score))[:k]
    return chunk.ids[alive[first]], score[first], touched


def _held(queries: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The ids and vectors of a pass's queries by their length."""
    own = queries.select("vec_id", "v").toArrow()
    values, sizes = _matrix(own.column("v").combine_chunks()) if own.num_rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    ends, names = np.cumsum(sizes), own.column("vec_id").to_numpy().astype(np.int64)
    return {int(d): (names[sizes == d], values[(ends[sizes == d] - d)[:, None] + np.arange(d)] if d else np.zeros(((sizes == 0).sum(), 0), np.int64)) for d in np.unique(sizes)}


def _answers(rows: DataFrame, queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """query_id, _copy, vec_id and score of each partition's best k for each query."""
    held = rows.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            values, sizes = _matrix(batch.column("v"))
            ids, ends = batch.column("vec_id").to_numpy(), np.cumsum(sizes)
            for d, (names, vectors) in held.value.items():
                at = np.flatnonzero(sizes == d)
                for a in range(0, len(at), CHUNK):
                    some = at[a : a + CHUNK]
                    chunk = Chunk(values[(ends[some] - d)[:, None] + np.arange(d)] if d else np.zeros((len(some), 0), np.int64), ids[some])
                    for i, (name, q) in enumerate(zip(names.tolist(), vectors)):
                        before = tops.get((d, i, name))
                        floor_ = float(before[1][-1]) if before is not None and len(before[1]) == k else -np.inf
                        x, s, _ = best(q, name, chunk, k, floor_)
                        if before is not None:
                            x, s = np.concatenate([before[0], x]), np.concatenate([before[1], s])
                            order = np.lexsort((x, -s))[:k]
                            x, s = x[order], s[order]
                        tops[d, i, name] = x, s
        if tops:
            n = [len(x) for x, _ in tops.values()]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([q for _, _, q in tops], n).astype(np.int64)), pa.array(np.repeat([i for _, i, _ in tops], n).astype(np.int32)), *(pa.array(np.concatenate([t[j] for t in tops.values()]).astype(np.int64)) for j in (0, 1))], ["query_id", "_copy", "vec_id", "score"])

    return shared.mapped(rows, run, "query_id long, _copy int, vec_id long, score long")


def _ranked(answers: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "_copy").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score."""
    rows = quantised(vectors)
    asked = shared.written(rows.where(F.pmod("vec_id", F.lit(every)) == 0).withColumn("_h", F.xxhash64("vec_id")), "queries")
    size = asked.agg(F.sum(F.size("v") * 8 + 16).alias("bytes")).first()["bytes"] or 0
    passes, done = max(1, -(-size // QUERY_BYTES)), []
    for i in range(passes):
        found = _ranked(_answers(rows, _held(asked.where(F.pmod("_h", F.lit(passes)) == i)), k), k)
        done.append(found if passes == 1 else shared.written(found, "answers"))
    return functools.reduce(DataFrame.unionByName, done)


#: The same in DuckDB's SQL.
SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
