"""Figures of runs: medians, speedup and efficiency, and names for data sets."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def speedups(runs: DataFrame, by: str = "threads", seconds: str = "seconds") -> DataFrame:
    """by, median, speedup against the median at 1, efficiency (speedup over by); null where 1 was not run. Rows without a time are passed over."""
    per = runs.filter(F.col(seconds).isNotNull() & F.col(by).isNotNull()).groupBy(by).agg(F.median(seconds).alias("median"))
    one = F.max(F.when(F.col(by) == 1, F.col("median"))).over(Window.partitionBy(F.lit(0)))  # one row for each number of threads
    return per.withColumn("speedup", one / F.col("median")).withColumn("efficiency", F.col("speedup") / F.col(by))


def dataset_tag(path: str) -> str:
    """A data set's name: that of its file, without extension and without the mark of sequence files."""
    return os.path.splitext(os.path.basename(path))[0].replace("_seq", "")


def trim_number(x: float) -> str:
    """A number as short text: 2 for 2.0, and 0.25 as it is."""
    return str(int(x)) if float(x).is_integer() else str(x)
