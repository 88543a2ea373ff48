"""Level-wise mining of high-utility sequential patterns.

The occurrences are dealt out once, by a slice of the sequence ids, packed in blocks, and stay
there.  At each level every slice finds the ends of its patterns again, extends them by every
later occurrence and sums up each candidate (see levels.py); a level shuffles only these
summaries, a row for each candidate and slice.  Slices are therefore few and large: their number
follows the occurrences, not the partitions.  What survives goes to the slices' tries, each
slice's share to it.  The ends, of which there are as many as candidates have occurrences, are
never written or shuffled, and plans stay small however long patterns get.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..sources.tables import forget, written
from . import levels, stats

NO_LIMIT = (1 << 31) - 1
#: Occurrences in one slice and in one block of it, about; a sequence lies in one.
SLICE_ROWS, BLOCK_ROWS = 1 << 20, 1 << 18
#: Few occurrences are dealt over so many slices a core, to even the load, of so many occurrences at least.
SLICES, LEAST_ROWS = 4, 1 << 13


def cut(lo: int, hi: int, rows: int, cores: int) -> tuple[int, int, int]:
    """Of occurrences of sequences lo to hi: number of slices, blocks in a slice, sequence ids in a block."""
    slices = min(hi - lo + 1, max(1, rows // SLICE_ROWS, min(SLICES * cores, rows // LEAST_ROWS)))
    blocks = max(1, -(-(rows // BLOCK_ROWS) // slices))
    return slices, blocks, max(1, -(-(hi - lo + 1) // (slices * blocks)))


@dataclass(frozen=True)
class Options:
    """How to mine; none of the first three changes the answer.

    eucs: join extensions with pairs whose swu reaches the threshold.  bound: what cuts a
    branch: none (local swu), peu, or la (peu over what tier-0 items leave).  prune_regularity:
    cut branches by gaps, not only results.  mode: which gaps count: full, seed (no trailing
    one) or window (only between occurrences).  floor: in seed and window mode also cut where
    the trailing gap passes the bound; right only if the bound holds for good.
    """

    eucs: bool = False
    bound: str = "la"
    prune_regularity: bool = True
    mode: str = "full"
    floor: bool = False
    max_len: int = NO_LIMIT


def empty_result(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "pattern string, pat array<array<int>>, utility long, periodicity long, first_sid long, last_sid long, max_inner long, support long")


def _within(bound: int, n: int, mode: str, floor: bool) -> Column:
    intra, inner, trail = F.col("intra"), F.greatest(F.col("first_sid") + 1, "intra"), F.lit(n) - F.col("last_sid")
    ok = {"full": F.greatest(inner, trail), "seed": inner, "window": intra}[mode] <= bound
    return ok & (trail <= bound) if floor else ok


def mine(db: DataFrame, min_util: int, bound: int | None, n: int, options: Options = Options(), counters: list[dict] | None = None) -> DataFrame:
    """Patterns of db whose utility reaches min_util and, if bound is given, whose gaps stay within it.

    Columns: pattern, pat, utility, periodicity (longest gap, leading and trailing included),
    first_sid, last_sid, max_inner (leading and inner gaps), support.  n is the number of
    sequences that the trailing gap runs to.  An empty database gives an empty result.
    counters gets, for each level, the patterns met, those cut by the bound and by their gaps,
    and those explored.
    """
    if min_util < 1:
        raise ValueError("min_util must be positive")
    if options.max_len < 1:
        return empty_result(db.sparkSession)
    spark = db.sparkSession
    span = db.agg(F.min("sid").alias("lo"), F.max("sid").alias("hi"), F.count(F.lit(1)).alias("rows")).first()
    if span["lo"] is None:
        return empty_result(spark)
    slices, blocks, width = cut(span["lo"], span["hi"], span["rows"], spark.sparkContext.defaultParallelism)
    gap = bound if bound is not None and options.prune_regularity else None
    valid = written(stats.tier0(db, min_util, gap, n, options.mode).select("item"))
    block = F.floor(F.col("sid") / width).cast("int")
    occ = db.join(valid, "item", "left_semi").withColumn("block", block).withColumn("slice", F.floor(F.col("block") / blocks).cast("int"))
    rows = occ.select("slice", "block", "sid", "ev", "item", "util", "seq_util", *([] if options.bound == "la" else ["rem"]))
    # Written, so that the shuffle of the occurrences goes; more partitions than slices, as few should get two.
    pack = written(rows.groupBy("slice", "block").applyInArrow(levels.packed, levels.BLOCKS))
    dealt = pack.repartition(2 * slices, "slice").sortWithinPartitions("slice").persist()
    tries = [spark.createDataFrame([], levels.TRIE)]
    if options.eucs:
        i = stats.eucs_i(occ).select(F.col("x").alias("pid"), F.lit(0).alias("ext"), F.col("y").alias("item"), "swu")
        s = stats.eucs_s(occ).select(F.col("x").alias("pid"), F.lit(1).alias("ext"), F.col("y").alias("item"), "swu")
        pairs = i.unionByName(s).filter(F.col("swu") >= min_util).select(F.lit(-1).alias("level"), F.col("pid").cast("long").alias("pid"), "ext", "item", F.lit(0).cast("long").alias("id"))
        # Each slice gets the pairs of the items that it has.
        here = occ.select("slice", "item").distinct()
        tries.append(written(pairs.join(here, "item").join(here.select("slice", F.col("item").cast("long").alias("pid")), ["slice", "pid"]).select(*tries[0].columns)))

    gaps_ok = F.lit(True) if bound is None else _within(bound, n, options.mode, options.floor)
    upper = F.col("swu" if options.bound == "none" else "peu")
    found, level, parents = [], 1, None
    while True:
        trie = reduce(DataFrame.unionByName, tries)
        within = written(dealt.groupBy("slice").cogroup(trie.groupBy("slice")).applyInArrow(levels.summarised(level), levels.WITHIN))
        summary = written(stats.between(within, ["pid", "ext", "item"], ["utility", "peu", "swu"]).withColumn("regular", gaps_ok))
        bounded, regular = upper >= min_util, F.col("regular") if gap is not None else F.lit(True)
        seen = summary.agg(F.count(F.lit(1)).alias("candidates"), F.count_if(bounded).alias("bounded"), F.count_if(bounded & regular).alias("explored")).first()
        if counters is not None:
            counters.append({"level": level, "candidates": seen["candidates"], "pruned_by_bound": seen["candidates"] - seen["bounded"], "pruned_by_gap": seen["bounded"] - seen["explored"], "explored": seen["explored"]})
        if not seen["explored"]:
            forget(within, summary)
            break
        kept = summary.filter(bounded & regular)
        if parents is None:
            pat = F.array(F.array("item"))
        else:
            kept = kept.join(parents, "pid")
            pat = F.when(F.col("ext") == 0, P.i_concat("parent", "item")).otherwise(P.s_concat("parent", "item"))
        kept = kept.withColumn("pat", pat).withColumn("id", F.monotonically_increasing_id())
        kept = written(kept.select("id", "pid", "ext", "item", "pat", "utility", "regular", "first_sid", "last_sid", "intra", "support"))
        found.append(kept)
        if level < options.max_len:
            tries.append(written(within.join(kept, ["pid", "ext", "item"]).select("slice", F.lit(level).alias("level"), "pid", "ext", "item", "id")))
        forget(within, summary)
        if level >= options.max_len:
            break
        parents = kept.select(F.col("id").alias("pid"), F.col("pat").alias("parent"))
        level += 1
    dealt.unpersist()
    forget(valid, pack, *tries)
    if not found:
        return empty_result(spark)
    out = reduce(DataFrame.unionByName, found)
    inner = F.greatest(F.col("first_sid") + 1, "intra")
    return out.filter((F.col("utility") >= min_util) & F.col("regular")).select(
        P.render("pat").alias("pattern"), "pat", "utility", F.greatest(inner, F.lit(n) - F.col("last_sid")).alias("periodicity"), "first_sid", "last_sid", inner.alias("max_inner"), "support"
    )


def answer(mined: DataFrame) -> DataFrame:
    return mined.select("pattern", "utility", "periodicity")
