"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ._common import written


#: Rows of an intermediate table that one task writes at least, where the number of edges bounds them.
ROWS = 50_000


def _few(df: DataFrame, edges: int) -> DataFrame:
    """df, which has no more rows than a few times the edges, in no more partitions than these need."""
    parts = max(1, -(-edges // ROWS))
    return df.coalesce(parts) if parts < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def _counted(edges: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """The edges, written, with their number and an order-free hash, seen while they were written."""
    seen = Observation()
    out = written(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")))
    return out, (seen.get["n"], int(seen.get["h"]))


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node with an edge to another; component is the smallest node reachable.

    Every step is two grouped minima joined back, written to the shared folder; the edge count
    never grows, and the number of steps is logarithmic in practice.  Nulls and loops are passed over.
    """
    e = edges.select(F.greatest(u, v).cast("long").alias("u"), F.least(u, v).cast("long").alias("v")).filter(f"{u} IS NOT NULL AND {v} IS NOT NULL AND {u} <> {v}").distinct()
    e, before = _counted(e)
    while n := before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # The minima are written first: the join then has exchanges of its own on both sides, and Spark can split a hub.
        least = written(_few(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), n))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(_few(large, n))
        own = written(_few(large.groupBy("u").agg(F.min("v").alias("m")), n))
        small = large.join(own, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own.withColumnRenamed("m", "v")).filter("u <> v")
        e, after = _counted(_few(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), n))
        if after == before:
            break
        before = after
    stars = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return _few(stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), before[0])
