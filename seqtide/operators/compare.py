"""Comparison of result sets by their canonical pattern."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hits(result: DataFrame, expected: DataFrame) -> DataFrame:
    return result.join(expected.select("pattern").distinct(), "pattern", "left_semi")


def only_in(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("pattern").distinct(), "pattern", "left_anti")


def contained(a: DataFrame, b: DataFrame) -> bool:
    return only_in(a, b).isEmpty()


def recall_precision(result: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: result_size, oracle_size, oracle_hits, recall, precision (1 where there is nothing to miss)."""
    both = result.select("pattern", F.lit(1).alias("r")).join(expected.select("pattern", F.lit(1).alias("e")), "pattern", "full")
    n = both.agg(F.count("r").alias("result_size"), F.count("e").alias("oracle_size"), F.count(F.when(F.col("r").isNotNull() & F.col("e").isNotNull(), 1)).alias("oracle_hits"))
    share = lambda c: F.when(F.col(c) == 0, F.lit(1.0)).otherwise(F.col("oracle_hits") / F.col(c))
    return n.withColumn("recall", share("oracle_size")).withColumn("precision", share("result_size"))
