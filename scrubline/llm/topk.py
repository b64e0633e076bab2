"""Exact top-k inner-product search by columnar branch and bound.

Vectors lie dimension by dimension.  Queries are ordered so that like ones share a small tile.  Scores of a tile are summed up one
block of dimensions at a time, the dimensions with most mass first.  After each block a candidate's score can
still grow by the product of the norms of what remains of both vectors; candidates that cannot reach the k-th
best score of any query of the tile are dropped and the columns are packed anew.  A tile that has no k scores yet first sums up the
candidates that lead after one block, so that the bound cuts from the first rows on.

Queries come in blocks of bounded size.  Each block is broadcast and meets every row where it
lies, so the rows are never moved again; each task returns its best k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scrubline.llm.common import stored
from scrubline.session import scratch_path

QUERY_BLOCK = 4096
TILE = 8
CANDIDATES = 4096
DIMENSIONS = 8


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, ints): floor(scale * x) of each component.

    Rows with a null id, a null vector, or a null or non-finite component take no part.  Of rows with one id, the
    smallest vector counts.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return (
        rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.coalesce(finite, F.lit(False)))
        .select("vec_id", F.transform("x", lambda v: F.floor(v * scale)).alias("ints"))
        .groupBy("vec_id").agg(F.min("ints").alias("ints"))
    )


def _matrix(rows: pa.ListArray, width: int) -> np.ndarray:
    """(width, rows) of integers; shorter vectors are filled with zeros."""
    sizes = np.diff(rows.offsets.to_numpy())
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(rows), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out.T


def _exact_type(queries: np.ndarray, base: np.ndarray):
    """The cheapest number type that sums these products without rounding."""
    top = lambda m: float(np.abs(m.astype(np.float64)).max(initial=0.0))
    most = top(queries) * top(base) * max(1, len(base))
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else object


def like_order(queries: np.ndarray) -> np.ndarray:
    """An order of the ``queries`` (dimensions, queries) in which those of like direction follow each other."""
    unit = queries / np.maximum(np.sqrt((queries.astype(np.float64) ** 2).sum(axis=0)), 1e-300)
    pivots = unit[:, :: 2 * TILE]
    likeness = pivots.T @ unit
    nearest = likeness.argmax(axis=0)
    return np.lexsort((-likeness[nearest, np.arange(len(nearest))], nearest))


class Best:
    """The k best (score, id) of each query so far, ties to the smaller id, and the multiplications and sorted rows spent."""

    def __init__(self, queries: int, k: int):
        self.k, self.kth, self.products = k, np.full(queries, -np.inf), 0
        self.sorted = 0
        self.query, self.score, self.id = (np.empty(0, t) for t in (np.int64,) * 3)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(query):
            return
        # rows lie in order of their queries; only those from the first to the last query given are sorted anew
        low, high = np.searchsorted(self.query, [query.min(), query.max() + 1])
        query, ids = np.concatenate([self.query[low:high], query]), np.concatenate([self.id[low:high], ids])
        score = np.concatenate([self.score[low:high], score])
        self.sorted += len(query)
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        first = np.searchsorted(query, query, side="left")
        place = np.arange(len(query)) - first
        kept = place < self.k
        last = place == self.k - 1
        self.kth[query[last]] = score[last].astype(np.float64)
        self.query, self.score, self.id = (
            np.concatenate([old[:low], new[kept], old[high:]])
            for old, new in ((self.query, query), (self.score, score), (self.id, ids))
        )


def _kth(sums: np.ndarray, query_ids: np.ndarray, base_ids: np.ndarray, k: int) -> np.ndarray:
    """The k-th best of whole scores (queries, rows) to rows but the query's own, or what is surely no more."""
    values = np.where(query_ids[:, None] == base_ids[None, :], -np.inf, sums.astype(np.float64))
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    reach = np.partition(values, values.shape[1] - k, axis=1)[:, -k]
    # scores too large for floating point were rounded
    return np.where(np.isfinite(reach), reach - np.abs(reach) * 1e-9, reach) if sums.dtype == object else reach


def search(queries: np.ndarray, query_ids: np.ndarray, base: np.ndarray, base_ids: np.ndarray, best: Best) -> None:
    """Add the best of ``base`` (dimensions, rows) for all ``queries`` (dimensions, queries) to ``best``."""
    kind = _exact_type(queries, base)
    order = np.argsort(-(base.astype(np.float64) ** 2).sum(axis=1), kind="stable")
    queries, base = queries[order], base[order]
    if kind is not object:
        queries, base = queries.astype(kind), np.ascontiguousarray(base.astype(kind))
    else:
        queries, base = queries.astype(object), base.astype(object)
    starts = list(range(0, len(base), DIMENSIONS)) or [0]

    def norms(m: np.ndarray) -> np.ndarray:
        squares = m.astype(np.float64) ** 2
        return np.sqrt(np.stack([squares[s:].sum(axis=0) for s in [*starts, len(m)]])) * (1 + 1e-9)

    base_left, query_left = norms(base), norms(queries)
    for tile in range(0, queries.shape[1], TILE):
        span = slice(tile, tile + TILE)
        need = best.kth[span]
        part, left = queries[:, span], query_left[:, span]
        # with nothing summed yet, the whole norms bound every score
        alive = np.flatnonzero((left[0][:, None] * base_left[0][None, :] >= need[:, None]).any(axis=0))
        sums = np.zeros((part.shape[1], len(alive)), queries.dtype)
        for at, start in enumerate(starts):
            block = slice(start, start + DIMENSIONS)
            sums += part[block].T @ base[block][:, alive]
            best.products += part[block].size * len(alive)
            if at == 0 and len(starts) > 1 and len(alive) > best.k and not np.isfinite(need).all():
                # the whole scores of those that lead so far are a bound for all
                ahead = np.where(query_ids[span][:, None] == base_ids[alive][None, :], -np.inf, sums.astype(np.float64))
                seeds = alive[np.unique(np.argpartition(ahead, len(alive) - best.k, axis=1)[:, -best.k :])]
                best.products += part.size * len(seeds)
                need = np.maximum(need, _kth(part.T @ base[:, seeds], query_ids[span], base_ids[seeds], best.k))
            if np.isfinite(need).any() and at + 1 < len(starts):
                bound = sums.astype(np.float64) + left[at + 1][:, None] * base_left[at + 1][alive][None, :]
                keep = (bound * (1 + 1e-9 * np.sign(bound)) >= need[:, None]).any(axis=0)
                if keep.sum() < 0.9 * len(alive):
                    alive, sums = alive[keep], sums[:, keep]
        own = query_ids[span][:, None] == base_ids[alive][None, :]
        values = np.where(own, -np.inf, sums.astype(np.float64))
        need = np.maximum(need, _kth(sums, query_ids[span], base_ids[alive], best.k))
        row, column = np.nonzero((values >= need[:, None]) & ~own)
        if len(row):
            best.add(row + tile, sums[row, column].astype(np.int64), base_ids[alive[column]])


def top_k(
    vectors: DataFrame, is_query: Column, *, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of each query by integer inner product.

    ``is_query`` is a condition on ``vec_id``.  Candidates are all rows but the query's own; fewer than k give fewer rows.  Vectors of
    unequal length are filled with zeros.  Scores must fit in a long.
    """
    spark = vectors.sparkSession
    rows = stored(integer_vectors(vectors, id_col, vector_col, scale), "vectors")
    width = rows.agg(F.max(F.size("ints"))).first()[0] or 0
    out = scratch_path(spark, "top-k")
    schema = "query_id long, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(out)
    queries = rows.where(is_query)
    after = None
    while True:
        block = (queries if after is None else queries.where(F.col("vec_id") > after)).orderBy("vec_id").limit(QUERY_BLOCK).collect()
        if not block:
            break
        after = block[-1]["vec_id"]
        matrix = np.zeros((width, len(block)), np.int64)
        for at, row in enumerate(block):
            matrix[: len(row["ints"]), at] = row["ints"]
        alike = like_order(matrix)
        shared = spark.sparkContext.broadcast((matrix[:, alike], np.array([row["vec_id"] for row in block])[alike]))

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            wanted, ids = shared.value
            best = Best(len(ids), k)
            for batch in batches:
                column = batch.column("ints")
                found_ids = batch.column("vec_id").to_numpy()
                for start in range(0, len(batch), CANDIDATES):
                    span = column.slice(start, CANDIDATES)
                    base = _matrix(pa.ListArray.from_arrays(
                        pa.array(span.offsets.to_numpy() - span.offsets[0].as_py(), pa.int32()), span.flatten()), width)
                    search(wanted, ids, base, found_ids[start : start + CANDIDATES], best)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[best.query]), pa.array(best.id), pa.array(best.score.astype(np.int64))],
                ["query_id", "vec_id", "score"],
            )

        rows.select("vec_id", "ints").mapInArrow(find, schema).write.mode("append").parquet(out)
        shared.destroy()
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    ranked = spark.read.schema(schema).parquet(out).withColumn("rank", place).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
