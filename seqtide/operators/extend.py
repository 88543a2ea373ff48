"""Extension of pattern ends by one more occurrence, linear in the length of a sequence."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@contextmanager
def co_partitioned(spark: SparkSession):
    """Joins and aggregates may keep a partitioning by a subset of their keys."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def extensions(ends: DataFrame, occ: DataFrame, on: list[str]) -> DataFrame:
    """Every pattern extended by every later occurrence of its sequence, at its best: on, pid, ext, acc and occ's other columns.

    ends(on, pid, last, ev, pos, acc) has at most one row for each pattern and event, as a
    pattern's last item stands in an event once.  An occurrence of a later event (ext 1) takes
    the running maximum of the ends before its event, so it is one row for each pattern,
    however many ends there are; one of the same event (ext 0, a larger item) takes that
    event's end.  Both sides keep a partitioning by the columns of on.
    """
    rest = [c for c in occ.columns if c not in on]
    heads = ends.groupBy(*on, "pid").agg(F.min("ev").alias("__from"))
    later = heads.join(occ, on).filter(F.col("ev") > F.col("__from")).select(*on, "pid", *rest)
    marks = ends.select(*on, "pid", "ev", "acc")
    before = Window.partitionBy(*on, "pid").orderBy("ev").rangeBetween(Window.unboundedPreceding, -1)
    best = later.unionByName(marks, allowMissingColumns=True).withColumn("__best", F.max("acc").over(before)).filter(F.col("item").isNotNull())
    s = best.select(*on, "pid", F.lit(1).alias("ext"), (F.col("__best") + F.col("util")).alias("acc"), *rest)
    same = ends.select(*on, "pid", "last", "ev", F.col("acc").alias("__acc")).join(occ, [*on, "ev"]).filter(F.col("item") > F.col("last"))
    return s.unionByName(same.select(*on, "pid", F.lit(0).alias("ext"), (F.col("__acc") + F.col("util")).alias("acc"), *rest))
