"""Connected components of a links table, by alternating large and small stars.

Every round is a few joins and aggregations over the links; nothing of them reaches the driver but two sums. Each step is set
down in the shared folder, so a lost executor costs one step at most. Hubs do not pile up in a task: minima are aggregated
before the shuffle, and the joins that hand them out are plain joins of two shuffles, which adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.common import settle

_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while x != r:
            up[x], x = r, up.get(x, x)
        return r

    def union(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.up.setdefault(min(a, b), min(a, b))


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the links of each Arrow batch by stars around their smallest members; they connect the same nodes."""
    for batch in batches:
        forest = Forest()
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.union(a, b)
        pairs = [(x, r) for x in forest.up if (r := forest.root(x)) != x]
        if pairs:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*pairs, strict=True)], schema=_LINKS)


def components(links: DataFrame) -> DataFrame:
    """Columns node and root (the smallest node that can be reached) for every node with a link to another one.

    `links` has two columns of longs, in any order; links from a node to itself, nulls and repeated links change nothing; an
    empty table gives no rows.
    """
    a, b = links.columns[:2]
    links = links.dropna(subset=[a, b]).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    links = settle(links.mapInArrow(contract, "u long, v long").distinct())
    seen = None
    while True:
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen or state["n"] == 0:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
        links = _small_star(_large_star(links))


def _large_star(links: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of its neighbours and itself."""
    both = links.select(F.col("u").alias("n"), F.col("v").alias("x")).union(links.select(F.col("v").alias("n"), F.col("u").alias("x")))
    least = settle(both.groupBy("n").agg(F.min("x").alias("m")).select("n", F.least("n", "m").alias("m")))
    return settle(both.where("x > n").join(least, "n").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(links: DataFrame) -> DataFrame:
    """Links a node's smaller neighbours and itself to the smallest of them."""
    least = settle(links.groupBy("u").agg(F.min("v").alias("m")))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return settle(moved.union(least.select("u", F.col("m").alias("v"))).distinct())
