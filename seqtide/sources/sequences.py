"""Sources and sinks of quantitative sequences.

A sequence database is one row per occurrence:
``sid long, ev int, pos int, item int, util long, rem long, seq_util long, batch_id int``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from .tables import written


def read_profits(spark: SparkSession, path: str) -> DataFrame:
    """item, profit of lines ``item:profit`` or ``item,profit``; other lines are passed over."""
    parts = F.split(F.trim("value"), "[:,]")
    rows = spark.read.text(path).select(F.get(parts, 0).try_cast("int").alias("item"), F.get(parts, 1).try_cast("bigint").alias("profit"))
    return rows.filter("item IS NOT NULL AND profit IS NOT NULL").dropDuplicates(["item"])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, value of a text file in the order of its lines.

    Lines are numbered by byte order: each task counts its own, and the counts before it are
    added, so only one number for each task meets in one place.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("k"))
    nth = rows.withColumn("n", F.row_number().over(Window.partitionBy("f", "b").orderBy("k")))
    counts = nth.groupBy("f", "b").agg(F.max("n").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return nth.join(counts, ["f", "b"]).select((F.col("before") + F.col("n") - 1).alias("line"), "value")


def parse_sequences(lines: DataFrame, profits: DataFrame, default_profit: int = 1, strict: bool = False) -> DataFrame:
    """Occurrences (sid, ev, item, util) of lines(line, value): events end with -1, sequences with -2.

    Tokens are ``item[quantity]``; unless strict also ``item,quantity`` and a bare item of
    quantity 1.  Malformed tokens, empty events and empty sequences are left out; strict also
    passes over lines that begin with #.  An item without a profit counts default_profit.
    """
    token = r"^(-?\d+)\[(-?\d+)\]$" if strict else r"^(-?\d+)(?:\[(-?\d+)\]|,(-?\d+))?$"
    body = F.regexp_replace(F.col("value"), r"(?:^|\s)-2.*$", "")
    if strict:
        lines = lines.filter(~F.trim("value").startswith("#"))
    events = lines.select("line", F.posexplode(F.split(body, r"(?:^|\s)-1(?=\s|$)")).alias("e", "event"))
    tokens = events.select("line", "e", F.explode(F.split(F.trim("event"), r"\s+")).alias("t")).filter(F.regexp_like("t", F.lit(token)))
    quantity = F.regexp_extract("t", token, 2) if strict else F.concat(F.regexp_extract("t", token, 2), F.regexp_extract("t", token, 3))
    rows = tokens.select("line", "e", F.regexp_extract("t", token, 1).try_cast("int").alias("item"), F.when(quantity == "", F.lit(1)).otherwise(quantity.try_cast("bigint")).alias("q")).filter("item IS NOT NULL AND q IS NOT NULL")
    priced = rows.join(profits, "item", "left").withColumn("util", F.col("q") * F.coalesce("profit", F.lit(default_profit)))
    priced = written(priced.select("line", "e", "item", "util"))
    sids = ordered_ids(priced.select("line").distinct(), "line")
    return priced.join(sids, "line").select("sid", F.dense_rank().over(Window.partitionBy("sid").orderBy("e")).cast("int").alias("ev"), "item", "util").withColumn("ev", F.col("ev") - 1)


def ordered_ids(keys: DataFrame, *order: str) -> DataFrame:
    """keys with sid from 0 in the given order: a range sort, each range numbered by itself, and the counts of the ranges before it.

    The ranges are written first, so that both uses of them see the same cuts; only one number
    for each range meets in one task.
    """
    slots = keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    slots = written(slots.withColumn("__n", F.row_number().over(Window.partitionBy("__p").orderBy(*order))))
    before = slots.groupBy("__p").agg(F.max("__n").alias("__c")).withColumn("__before", F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__c")
    return slots.join(before, "__p").withColumn("sid", (F.col("__before") + F.col("__n") - 1).cast("long")).drop("__p", "__n", "__before")


def qsdb(occurrences: DataFrame, batch_id: int | Column = 0, duplicates: str = "error") -> DataFrame:
    """The full table of occurrences(sid, ev, item, util): positions, utility that remains, utility of the sequence.

    Utilities must not be negative (the bounds rest on it).  An item twice in an event is an
    error, or summed if duplicates="sum".
    """
    rows = occurrences.select("sid", "ev", "item", F.col("util").cast("long").alias("util"))
    if duplicates == "sum":
        rows = rows.groupBy("sid", "ev", "item").agg(F.sum("util").alias("util"))
    order = Window.partitionBy("sid").orderBy("ev", "item")
    twice = F.lag("item").over(order).eqNullSafe(F.col("item")) & F.lag("ev").over(order).eqNullSafe(F.col("ev"))
    rows = rows.withColumn("pos", (F.row_number().over(order) - 1).cast("int")).withColumn("__twice", twice)
    wrong = F.when(F.col("util") < 0, F.raise_error(F.lit("negative utility"))).when(F.col("__twice"), F.raise_error(F.lit("an item twice in an event")))
    rows = rows.withColumn("util", F.coalesce(wrong.cast("long"), F.col("util"))).drop("__twice")
    after = order.rowsBetween(1, Window.unboundedFollowing)
    return rows.select(
        "sid", "ev", "pos", "item", "util", F.coalesce(F.sum("util").over(after), F.lit(0)).alias("rem"), F.sum("util").over(Window.partitionBy("sid")).alias("seq_util"),
        (F.lit(batch_id) if isinstance(batch_id, int) else batch_id).cast("int").alias("batch_id"),
    )


def read_sequences(spark: SparkSession, path: str, profits: DataFrame, default_profit: int = 1, strict: bool = False) -> DataFrame:
    return qsdb(parse_sequences(numbered_lines(spark, path), profits, default_profit, strict))


def batch_sizes(n: int, ratios: list[float]) -> list[int]:
    """Rounded shares of n; what is left bounds each, and the last takes the rest."""
    out: list[int] = []
    for r in ratios[:-1]:
        out.append(min(int(n * r + 0.5), n - sum(out)))
    return [*out, n - sum(out)]


def with_batches(db: DataFrame, n: int, ratios: list[float]) -> DataFrame:
    """db with batch_id by the cut points of the ratios."""
    sizes, at, batch = batch_sizes(n, ratios), 0, F.lit(None)
    for k, size in enumerate(sizes):
        batch = F.when((F.col("sid") >= at) & (F.col("sid") < at + size), k) if k == 0 else batch.when((F.col("sid") >= at) & (F.col("sid") < at + size), k)
        at += size
    return db.withColumn("batch_id", batch.cast("int"))


def write_patterns(patterns: DataFrame, path: str, by_utility: bool = False) -> None:
    """Lines ``pattern #UTIL: u #PER: p``; the period is left out where it is negative or null."""
    line = F.concat(F.col("pattern"), F.lit(" #UTIL: "), F.col("utility").cast("string"), F.when(F.col("periodicity") >= 0, F.concat(F.lit(" #PER: "), F.col("periodicity").cast("string"))).otherwise(""))
    ordered = patterns.orderBy(F.desc("utility"), "pattern") if by_utility else patterns
    ordered.select(line.alias("value")).write.text(path)


def write_large_patterns(patterns: DataFrame, path: str) -> None:
    """Lines ``(1 2) 3 #UTIL: u`` of patterns(pat, utility), by utility, largest first."""
    line = F.concat(P.intuitive("pat"), F.lit(" #UTIL: "), F.col("utility").cast("string"))
    patterns.orderBy(F.desc("utility"), line).select(line.alias("value")).write.text(path)


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    form = r"^(.*?) #UTIL: (\d+)(?: #PER: (\d+))?$"
    part = lambda k: F.regexp_extract("value", form, k)
    return spark.read.text(path).select(part(1).alias("pattern"), part(2).cast("long").alias("utility"), F.when(part(3) != "", part(3).cast("int")).otherwise(-1).alias("periodicity"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as sequences: a user's day, one event type per event, ordered by time."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.to_date("ts").alias("day"), "user_id", "ts", "event_id", "event_type", "value")
    items = F.create_map(*[F.lit(x) for pair in (("click", 1), ("error", 2), ("purchase", 3), ("signup", 4), ("view", 5)) for x in pair])
    ids = ordered_ids(e.select("day", "user_id").distinct(), "day", "user_id")
    rows = e.join(ids, ["day", "user_id"])
    ev = (F.row_number().over(Window.partitionBy("sid").orderBy("ts", "event_id")) - 1).cast("int")
    return qsdb(rows.select("sid", ev.alias("ev"), items[F.col("event_type")].alias("item"), (F.floor("value").cast("long") + 1).alias("util")))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as sequences: a customer's year, one order per event, brands as items, quantities as utility."""
    read = lambda t, *c: spark.read.parquet(f"{sf_dir}/{t}.parquet").select(*c)
    o = read("orders", "o_orderkey", "o_custkey", "o_orderdate").withColumn("y", F.year("o_orderdate"))
    li, p = read("lineitem", "l_orderkey", "l_partkey", "l_quantity"), read("part", "p_partkey", "p_brand")
    bought = li.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey", F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("item")).agg(F.sum(F.col("l_quantity").cast("long")).alias("util"))
    # Written, as the ids need the keys of what was bought: the join runs once.
    rows = written(bought.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("y", "o_custkey", "o_orderdate", "o_orderkey", "item", "util"))
    ids = ordered_ids(rows.select("y", "o_custkey").distinct(), "y", "o_custkey")
    rows = rows.join(ids, ["y", "o_custkey"])
    ev = (F.dense_rank().over(Window.partitionBy("sid").orderBy("o_orderdate", "o_orderkey")) - 1).cast("int")
    return qsdb(rows.select("sid", ev.alias("ev"), "item", "util"))
