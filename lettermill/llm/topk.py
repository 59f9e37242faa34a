"""Operator 5: exact top-k inner-product search by distributed histogram selection.

For a block of queries every partition scores all of its vectors and counts all scores in a histogram. The k-th best score of a
query is found by refining global histograms: first over wide bins of scores, then over narrower bins within the one that holds the
k-th place, until a bin is one score. A partition need only report its bins from the top down to its own k-th score. A last pass
keeps what scores more, and of those that tie with the k-th place the smallest ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lettermill.llm.common import settle

#: Queries of one block, which every task holds: with 64 components 2 MB of numbers. Vectors scored at once, and bits by which bins narrow.
QUERIES, AT_ONCE, NARROW = 4_096, 512, 8
LOWEST = np.int64(-(2**63))


def scaled(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """Columns id and v: floor(scale * x) of each component as a long; vectors that are null or hold null or non-finite components, and null ids, are left out."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return df.where(F.col(id_col).isNotNull() & x.isNotNull() & finite).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(scale)))).alias("v"))


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of a list column as numbers; shorter vectors end in zeros, longer ones are cut where the queries end, since they meet zeros there."""
    ends = np.asarray(column.offsets)
    flat = np.asarray(column.values)[ends[0] : ends[-1]].astype(np.int64, copy=False)
    sizes = np.diff(ends)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    for k, (a, size) in enumerate(zip(ends[:-1] - ends[0], sizes, strict=True)):
        out[k, : min(size, width)] = flat[a : a + min(size, width)]
    return out


def scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Integer inner products; exact in floats where they fit, else in integers of any size, held to the range of a long."""
    top = (int(np.abs(queries.astype(object)).max()) if queries.size else 0) * (int(np.abs(vectors.astype(object)).max()) if vectors.size else 0) * max(1, queries.shape[1])
    if top < 2**53:
        return (queries.astype(np.float64) @ vectors.T.astype(np.float64)).astype(np.int64)
    if top < 2**63:
        return queries @ vectors.T
    exact = queries.astype(object) @ vectors.T.astype(object)
    return np.clip(exact, -(2**63) + 1, 2**63 - 1).astype(np.int64)


def _scored(batches: Iterator[pa.RecordBatch], ids: np.ndarray, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, scores by query) of slices of the vectors; a query's own vector scores LOWEST, which counts for nothing."""
    order = np.argsort(ids)
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(at, AT_ONCE)
            own = np.asarray(part.column(0))
            got = scores(queries, matrix(part.column(1), queries.shape[1]))
            place = np.searchsorted(ids[order], own)
            place[place == len(ids)] = 0
            mine = ids[order][place] == own
            got[order[place[mine]], np.flatnonzero(mine)] = LOWEST
            yield own, got


def _histograms(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, shift: int, low: np.ndarray, span: int, k: int) -> DataFrame:
    """Columns q, bin, n: how many scores of a query are in each bin, score >> shift, of the `span` bins from its `low` on."""
    schema = pa.schema([("q", pa.int32()), ("bin", pa.int64()), ("n", pa.int64())])
    size = len(ids) * span

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size, np.int64)
        rows = (np.arange(len(ids)) * span)[:, None]
        for _, got in _scored(batches, ids, queries):
            bins = (got >> shift) - low[:, None]
            inside = (bins >= 0) & (bins < span) & (got != LOWEST)
            table += np.bincount((rows + bins)[inside], minlength=size)
        table = table.reshape(len(ids), span)
        above = table[:, ::-1].cumsum(1)[:, ::-1] - table
        q, bins = np.nonzero((table > 0) & (above < k))
        for at in range(0, len(q), 100_000):
            part = slice(at, at + 100_000)
            mine, its = q[part], bins[part]
            yield pa.record_batch([pa.array(mine.astype(np.int32)), pa.array(its + low[mine]), pa.array(table[mine, its])], schema=schema)

    return vectors.mapInArrow(run, "q int, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))


def _kth_bins(histograms: DataFrame, wanted: pd.Series | np.ndarray) -> pd.DataFrame:
    """For each query the bin of its k-th place and what lies above it; of all fewer than k, the lowest bin. One row a query."""
    need = histograms.sparkSession.createDataFrame(pd.DataFrame({"q": np.arange(len(wanted), dtype=np.int32), "need": np.asarray(wanted, np.int64)}))
    down = Window.partitionBy("q").orderBy(F.desc("bin"))
    summed = histograms.join(F.broadcast(need), "q").withColumn("upto", F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    return summed.where((F.col("upto") - F.col("n")) < F.col("need")).groupBy("q").agg(F.min("bin").alias("bin"), F.min_by(F.col("upto") - F.col("n"), "bin").alias("above")).toPandas()


def search_block(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """Columns query_id, rank, vec_id, score for one block of queries."""
    bound = vectors.select(F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, c: F.greatest(a, F.abs(c)))).alias("m")).first()["m"] or 0
    bits = max(1, min(63, int(int(bound) * (int(np.abs(queries.astype(object)).max()) if queries.size else 0) * max(1, queries.shape[1])).bit_length()))
    shift = max(0, bits - NARROW)
    low, span = np.full(len(ids), -(1 << (bits - shift)), np.int64), 2 << (bits - shift)
    need = np.full(len(ids), k, np.int64)
    while True:
        found = _kth_bins(_histograms(vectors, ids, queries, shift, low, span, k), need)
        at = np.full(len(ids), LOWEST, np.int64)
        at[found["q"].to_numpy()] = found["bin"].to_numpy()
        need[found["q"].to_numpy()] -= found["above"].to_numpy()
        if shift == 0:
            break
        finer = max(0, shift - NARROW)
        span = 1 << (shift - finer)
        low, shift = np.where(at == LOWEST, 0, at) << (shift - finer), finer
    kth, ties = at, need
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("q", pa.int32()), ("over", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tied: dict[int, list[int]] = {}
        for own, got in _scored(batches, ids, queries):
            q, v = np.nonzero((got > kth[:, None]) & (got != LOWEST))
            if len(q):
                yield pa.record_batch([pa.array(ids[q]), pa.array(own[v]), pa.array(got[q, v]), pa.array(q.astype(np.int32)), pa.array(np.ones(len(q), bool))], schema=schema)
            q, v = np.nonzero((got == kth[:, None]) & (got != LOWEST))
            cuts = np.searchsorted(q, np.arange(len(ids) + 1))
            for one in np.unique(q):
                mine = own[v[cuts[one] : cuts[one + 1]]]
                tied[one] = sorted(tied.get(one, []) + np.sort(mine)[: ties[one]].tolist())[: ties[one]]
        q = np.array([one for one, some in tied.items() for _ in some], np.int32)
        if len(q):
            yield pa.record_batch([pa.array(ids[q]), pa.array([x for some in tied.values() for x in some], pa.int64()), pa.array(kth[q]), pa.array(q), pa.array(np.zeros(len(q), bool))], schema=schema)

    kept = vectors.mapInArrow(run, "query_id long, vec_id long, score long, q int, over boolean")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, block: int = QUERIES) -> DataFrame:
    """Columns query_id, rank (from 1), vec_id, score: the k greatest scores of each query over all vectors but its own, ties to the smaller id.

    `vectors` and `queries` have columns id and v (array<long>), as `scaled` makes them. Queries go through in blocks of about
    `block`, each a bounded number of vectors on the driver and in every task; nothing else is gathered. Fewer than k vectors give
    fewer rows; a query id that repeats is one query, by one of its vectors; vectors of a query's id count as its own; a vector id that repeats may
    appear more than once; no queries or no vectors give no rows; where lengths differ, missing components are zero.
    """
    spark = vectors.sparkSession
    vectors = settle(vectors.select("id", "v"))
    queries = settle(queries.select("id", "v").groupBy("id").agg(F.min("v").alias("v")))
    blocks = max(1, -(-queries.count() // block))
    done = None
    for b in range(blocks):
        mine = (queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b) if blocks > 1 else queries).toArrow()
        if not mine.num_rows:
            continue
        ids = np.asarray(mine.column("id").combine_chunks()).astype(np.int64)
        column = mine.column("v").combine_chunks()
        width = int(max(1, np.diff(np.asarray(column.offsets)).max()))
        part = settle(search_block(vectors, ids, matrix(column, width), k))
        done = part if done is None else done.union(part)
    return done if done is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
