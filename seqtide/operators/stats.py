"""Totals, sequence-weighted utilities, recurrence gaps and bounds over a sequence database."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .extend import extensions

#: Sequences in one slice: gaps are found slice by slice, then between slices.
SLICE = 4096


def sequence_utility(db: DataFrame) -> DataFrame:
    return db.groupBy("sid").agg(F.sum("util").alias("seq_util"))


def totals(db: DataFrame) -> tuple[int, int]:
    """Utility and number of sequences; sequence ids are dense, so the largest gives their number."""
    r = db.agg(F.coalesce(F.sum("util"), F.lit(0)).alias("u"), (F.coalesce(F.max("sid"), F.lit(-1)) + 1).alias("n")).first()
    return r["u"], r["n"]


def dataset_stats(db: DataFrame) -> DataFrame:
    """n_sequences, distinct_items, avg and max items and events a sequence, total_utility."""
    per = db.groupBy("sid").agg(F.count(F.lit(1)).alias("items"), F.countDistinct("ev").alias("events"), F.sum("util").alias("u"))
    items = db.agg(F.countDistinct("item").alias("distinct_items"))
    return per.agg(
        F.count(F.lit(1)).alias("n_sequences"), F.avg("items").alias("avg_len_items"), F.max("items").alias("max_len_items"),
        F.avg("events").alias("avg_events"), F.max("events").alias("max_events"), F.sum("u").alias("total_utility"),
    ).crossJoin(items)  # one row each


def item_swu(db: DataFrame) -> DataFrame:
    """item, swu: utility of the sequences that hold the item."""
    return db.groupBy("sid", "item").agg(F.first("seq_util").alias("s")).groupBy("item").agg(F.sum("s").alias("swu"))


def eucs_i(db: DataFrame) -> DataFrame:
    """x < y in one event: x, y, swu."""
    a, b = db.select("sid", "ev", F.col("item").alias("x"), "seq_util"), db.select("sid", "ev", F.col("item").alias("y"))
    pairs = a.join(b, ["sid", "ev"]).filter("x < y").groupBy("sid", "x", "y").agg(F.first("seq_util").alias("s"))
    return pairs.groupBy("x", "y").agg(F.sum("s").alias("swu"))


def eucs_s(db: DataFrame) -> DataFrame:
    """x in an earlier event than y, x = y allowed: x, y, swu.

    First and last event of each item in a sequence decide, so the join has a row per pair of items, not of occurrences.
    """
    ends = db.groupBy("sid", "item").agg(F.min("ev").alias("lo"), F.max("ev").alias("hi"), F.first("seq_util").alias("s"))
    a, b = ends.select("sid", F.col("item").alias("x"), "lo", "s"), ends.select("sid", F.col("item").alias("y"), "hi")
    return a.join(b, "sid").filter("lo < hi").groupBy("x", "y").agg(F.sum("s").alias("swu"))


def merged(*parts: DataFrame) -> DataFrame:
    """Sums of tables of one batch each are those of all batches: adds swu over equal other columns."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*[c for c in out.columns if c != "swu"]).agg(F.sum("swu").alias("swu"))


def gaps(per_sequence: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """keys, first_sid, last_sid, intra (largest gap between neighbours, 0 if alone), support, and sums.

    per_sequence has a row per (keys, sid) with a slice column.  Gaps are found within slices,
    where the rows lie together already, and then between the slices of a key, so no key's
    sequences meet in one task: a key has a row for each slice.
    """
    inside = Window.partitionBy("slice", *keys).orderBy("sid")
    within = per_sequence.withColumn("__gap", F.col("sid") - F.lag("sid").over(inside)).groupBy("slice", *keys).agg(
        F.min("sid").alias("__lo"), F.max("sid").alias("__hi"), F.coalesce(F.max("__gap"), F.lit(0)).alias("__in"), F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(c) for c in sums]
    )
    return between(within, keys, sums)


def between(within: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """gaps() of rows that sum up a key in a slice: first and last sid, largest gap and number of sequences (__lo, __hi, __in, __n), and sums."""
    across = Window.partitionBy(*keys).orderBy("slice")
    return within.withColumn("__over", F.coalesce(F.col("__lo") - F.lag("__hi").over(across), F.lit(0))).groupBy(*keys).agg(
        F.min("__lo").alias("first_sid"), F.max("__hi").alias("last_sid"), F.greatest(F.max("__in"), F.max("__over")).alias("intra"), F.sum("__n").alias("support"), *[F.sum(c).alias(c) for c in sums]
    )


def sliced(db: DataFrame, width: int = SLICE) -> DataFrame:
    return db.withColumn("slice", F.floor(F.col("sid") / width).cast("int"))


def item_regularity(db: DataFrame, n: int) -> DataFrame:
    """item, first_sid, last_sid, max_inner (leading gap included), max_intra, periodicity."""
    per = sliced(db).groupBy("slice", "item", "sid").agg(F.first("seq_util").alias("swu"))
    g = gaps(per, ["item"], ["swu"])
    inner = F.greatest(F.col("first_sid") + 1, F.col("intra"))
    return g.select("item", "swu", "first_sid", "last_sid", inner.alias("max_inner"), F.col("intra").alias("max_intra"), F.greatest(inner, F.lit(n) - F.col("last_sid")).alias("periodicity"))


def tier0(db: DataFrame, min_util: int, bound: int | None, n: int, mode: str = "full") -> DataFrame:
    """Items that a result can hold: swu reaches min_util, and the gaps that the mode counts stay within the bound."""
    kept = item_regularity(db, n).filter(F.col("swu") >= min_util)
    if bound is not None:
        kept = kept.filter(F.col({"full": "periodicity", "seed": "max_inner", "window": "max_intra"}[mode]) <= bound)
    return kept


def local_swu(db: DataFrame) -> DataFrame:
    """item, ext (0 same event, 1 later), next, swu: utility of the sequences in which next can extend item."""
    i = eucs_i(db).select(F.col("x").alias("item"), F.lit(0).alias("ext"), F.col("y").alias("next"), "swu")
    return i.unionByName(eucs_s(db).select(F.col("x").alias("item"), F.lit(1).alias("ext"), F.col("y").alias("next"), "swu"))


def peu_items(db: DataFrame) -> DataFrame:
    """item, utility (best occurrence a sequence, summed) and peu (best occurrence with what remains, summed)."""
    per = db.groupBy("sid", "item").agg(F.max("util").alias("u"), F.max(F.col("util") + F.col("rem")).alias("p"))
    return per.groupBy("item").agg(F.sum("u").alias("utility"), F.sum("p").alias("peu"))


def tsu_items(db: DataFrame) -> DataFrame:
    """item, tsu: the first occurrence with what remains after it, summed over sequences."""
    per = db.groupBy("sid", "item").agg(F.min_by(F.col("util") + F.col("rem"), "pos").alias("t"))
    return per.groupBy("item").agg(F.sum("t").alias("tsu"))


def tsu_pairs(db: DataFrame) -> DataFrame:
    """item, ext, next, tsu of the two-item patterns.

    In a sequence where the first item's first occurrence is also its best, the bound is the
    pattern's first instance with what remains after it; elsewhere it is the first item's peu.
    """
    a = db.select("sid", F.col("item").alias("pid"), F.col("item").alias("last"), "ev", "pos", F.col("util").alias("acc"))
    first = db.groupBy("sid", F.col("item").alias("x")).agg(F.max("util").alias("best"), F.min_by("util", "pos").alias("u_first"), F.max(F.col("util") + F.col("rem")).alias("peu"))
    ends = extensions(a, db.select("sid", "item", "ev", "pos", "util", "rem"), ["sid"]).withColumnRenamed("pid", "x")
    found = ends.groupBy("sid", "x", "ext", "item").agg(F.min_by(F.col("acc") + F.col("rem"), "pos").alias("t"))
    bound = F.when(F.col("best") == F.col("u_first"), F.col("t")).otherwise(F.col("peu"))
    return found.join(first, ["sid", "x"]).groupBy(F.col("x").alias("item"), "ext", F.col("item").alias("next")).agg(F.sum(bound).alias("tsu"))
