"""Incremental mining: tracked patterns as a table, kept up to date by tail appends.

State: the history of occurrences by batch, and patterns(pattern, pat, utility, last_sid,
max_inner).  A batch is matched against the trie of tracked patterns and merged: utilities
add, the gap across the cut is the batch's first sequence less the last one known.  What the
first batch was too weak to show is found at the query, in the increments at the threshold
that the partition lemma leaves, and then matched over the whole history.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import thresholds as T
from ..sources import sequences as S
from ..sources.tables import forget, written
from . import match, stats
from .mine import Options, mine

STATE = ["pattern", "pat", "utility", "last_sid", "max_inner"]
#: Tables of increments that are read side by side before they become one.
TABLES = 8
#: What a miner knows besides its tables.
NUMBERS = ["n", "total", "seeded_at", "first_bound", "theta", "evicted", "lost_from", "_settled", "_appended"]


@dataclass(frozen=True)
class Config:
    """One incremental miner.

    ratio, period_ratio: thresholds as shares of utility and of the number of sequences.
    bound: a constant longest gap in place of period_ratio; regular=False drops the gap clause.
    buffer: how far below the threshold the first batch is mined.  final_sequences: the known
    number of sequences at the end, which bounds gaps while seeding.  seed: ceiling (bound of
    the end, if known), current (that of the first batch, regular patterns only) or current_seed
    (that bound for good, trailing gap ignored: loses patterns, kept as a baseline).  discover: find at the query what was not tracked;
    partition: find it after every batch instead.  evict: drop patterns that can never be
    regular; max_tracked: keep no more patterns than this besides the answer.
    """

    ratio: float
    period_ratio: float = 1.0
    bound: int | None = None
    regular: bool = True
    buffer: T.Buffer = T.Buffer("fix", fixed=1.0, least=1.0, most=1.0)
    final_sequences: int | None = None
    seed: str = "ceiling"
    discover: bool = True
    partition: bool = False
    matcher: str = "trie"
    evict: bool = False
    max_tracked: int | None = None
    max_len: int = Options().max_len


class IncrementalMiner:
    def __init__(self, spark: SparkSession, config: Config) -> None:
        self.spark, self.config = spark, config
        self.batches: list[DataFrame] = []
        self.n = self.total = 0
        self.seeded_at = 0.0
        self.first_bound: int | None = None
        self.theta = 0.0
        self.patterns: DataFrame | None = None
        self.evicted = 0
        self.lost_from: int | None = None
        self._settled = True
        self._appended = 0
        self._saved: dict[int, str] = {}

    # thresholds

    @property
    def min_util(self) -> int:
        return max(1, T.min_utility(self.config.ratio, self.total))

    @property
    def max_period(self) -> int | None:
        c = self.config
        return None if not c.regular else c.bound if c.bound is not None else T.max_period(c.period_ratio, self.n)

    def ceiling(self) -> int | None:
        """The bound that gaps are held to for good; None if there is none. Sound unless seed is current_seed."""
        c = self.config
        if not c.regular:
            return None
        if c.bound is not None:
            return c.bound
        if c.seed == "current_seed":
            return self.first_bound
        if c.seed == "ceiling" and c.final_sequences is not None and c.final_sequences >= self.n:
            return T.max_period(c.period_ratio, c.final_sequences)
        return None

    # batches

    def append(self, batch: DataFrame) -> DataFrame:
        """Number a batch(sid, ev, item, util, ... with sid from 0) behind what is there and store it."""
        rows = batch.select((F.col("sid") + self.n).cast("long").alias("sid"), "ev", "item", "util")
        stored = written(S.qsdb(rows, self._appended))
        u, n = stats.totals(stored)
        self._appended += 1
        self.batches.append(stored)
        if len(self.batches) > TABLES + 1:  # the first batch stays apart, as discovery leaves it out
            merged, old = written(self.history(1)), self.batches[1:]
            self.batches[1:] = [merged]
            forget(*old[:-1])
        self.total += u
        self.n = max(self.n, n)
        return stored

    def history(self, first: int = 0) -> DataFrame | None:
        out = None
        for b in self.batches[first:]:
            out = b if out is None else out.unionByName(b)
        return out

    # state that outlives the application

    def save(self, at: str, version: int) -> None:
        """Write the state as that version under a folder; its row of numbers, written last, makes it valid."""
        for b in self.batches:
            if id(b) not in self._saved:
                self._saved[id(b)] = f"{at}/batch-{version}-{len(self._saved)}"
                b.write.mode("overwrite").parquet(self._saved[id(b)])
        self.patterns.write.mode("overwrite").parquet(f"{at}/patterns-{version}")
        row = json.dumps({"version": version, "batches": [self._saved[id(b)] for b in self.batches]} | {k: getattr(self, k) for k in NUMBERS})
        self.spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/state/version={version}")

    @classmethod
    def load(cls, spark: SparkSession, config: Config, at: str) -> tuple[IncrementalMiner, int]:
        """A miner as it was last saved there, and that version; a new one and -1 where nothing is."""
        miner, to = cls(spark, config), spark._jvm.org.apache.hadoop.fs.Path(f"{at}/state")
        files = to.getFileSystem(spark._jsc.hadoopConfiguration())
        done = [p.getPath().getParent().toString() for p in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(to, "version=*/_SUCCESS")) or ()]
        if not done:
            return miner, -1
        state = json.loads(spark.read.text(max(done, key=lambda p: int(p.rpartition("=")[2]))).first()["value"])
        for k in NUMBERS:
            setattr(miner, k, state[k])
        miner.batches = [spark.read.parquet(p) for p in state["batches"]]
        miner._saved = {id(b): p for b, p in zip(miner.batches, state["batches"], strict=True)}
        miner.patterns = spark.read.parquet(f"{at}/patterns-{state['version']}")
        return miner, state["version"]

    def initial_build(self, batch: DataFrame) -> None:
        c = self.config
        db = self.append(batch)
        self.theta = self.seeded_at = c.buffer.factor(0, 0, self.n, 0, c.ratio) * self.min_util
        threshold = max(1, -int(-self.seeded_at // 1))
        self.first_bound = self.max_period
        ceiling = self.ceiling()
        if c.seed == "current":
            seeds = mine(db, threshold, self.max_period, self.n, Options(max_len=c.max_len))
        else:
            seeds = mine(db, threshold, ceiling, self.n, Options(mode="seed", floor=c.bound is not None and c.regular, max_len=c.max_len))
        self._track(seeds.select(*STATE))

    def process_batch(self, batch: DataFrame) -> None:
        if self.patterns is None:
            self.initial_build(batch)
            return
        before_u, before_n = self.total, self.n
        delta = self.append(batch)
        c = self.config
        self.theta = c.buffer.factor(self.total - before_u, before_u, self.n - before_n, before_n, c.ratio) * self.min_util
        matched = self._match(delta, self.patterns)
        self._track(merge(self.patterns, match.state_of(matched)))
        forget(matched)
        self._settled = False
        if c.partition and self.total > before_u:
            self._discover(delta, max(1, T.min_utility(c.ratio, self.total - before_u)))

    def _match(self, db: DataFrame, patterns: DataFrame) -> DataFrame:
        return {"trie": match.trie_match, "index": match.indexed_match, "cross": match.cross_match}[self.config.matcher](db, patterns)

    def candidates(self, db: DataFrame, threshold: int) -> DataFrame:
        """Untracked patterns that the rows alone bring to the threshold, gaps counted only between their occurrences."""
        c = self.config
        options = Options(mode="window", floor=c.bound is not None and c.regular, max_len=c.max_len)
        return mine(db, threshold, self.ceiling(), self.n, options).select("pattern", "pat").join(self.patterns.select("pattern"), "pattern", "left_anti")

    def _discover(self, db: DataFrame, threshold: int) -> None:
        found = written(self.candidates(db, threshold))
        if found.isEmpty():
            return
        matched = self._match(self.history(), found)
        state = match.state_of(matched).join(found, "pattern")
        new = state.select("pattern", "pat", "utility", "last_sid", F.greatest(F.col("first_sid") + 1, "intra").alias("max_inner"))
        self._track(self.patterns.unionByName(new))
        forget(matched, found)

    def discovery_threshold(self) -> int:
        """What the increments must bring by themselves if the first batch left a pattern untracked."""
        threshold = self.min_util - self.seeded_at
        if threshold <= 0:
            raise ValueError("the first batch was mined above the present threshold: nothing bounds what it missed")
        return max(1, -int(-threshold // 1))

    def _track(self, patterns: DataFrame) -> None:
        """Store the tracked patterns, without those that are of no more use."""
        c, ceiling = self.config, self.ceiling()
        rows = patterns.select(*STATE).withColumn("floor", P.floor_period("max_inner", "last_sid", self.n))
        if c.evict and ceiling is not None:
            kept = written(rows.filter(F.col("floor") <= ceiling))
            self.evicted += patterns.count() - kept.count()
            rows = kept
        if c.max_tracked is not None:
            rows = self._budget(written(rows))
        before, self.patterns = self.patterns, written(rows.select(*STATE))
        forget(before)

    def _budget(self, rows: DataFrame) -> DataFrame:
        """The answer, and of the rest the max_tracked of the least floors; ties at the cut go together."""
        rest = rows.filter(~self._answers())
        over = rest.count() - self.config.max_tracked
        if over <= 0:
            return rows
        least_gone = rest.groupBy("floor").agg(F.count(F.lit(1)).alias("c")).withColumn("upto", F.sum("c").over(Window.orderBy("floor"))).filter(F.col("upto") > self.config.max_tracked).agg(F.min("floor")).first()[0]
        self.lost_from = least_gone if self.lost_from is None else min(self.lost_from, least_gone)
        self.evicted += rest.filter(F.col("floor") >= least_gone).count()
        return rows.filter(self._answers() | (F.col("floor") < least_gone))

    def complete_up_to(self) -> int | None:
        """Every pattern with gaps up to this is still tracked; None: all."""
        return None if self.lost_from is None else self.lost_from - 1

    def _answers(self):
        period = P.floor_period("max_inner", "last_sid", self.n)
        ok = F.col("utility") >= self.min_util
        return ok if self.max_period is None else ok & (period <= self.max_period)

    # queries

    def answer(self) -> DataFrame:
        """pattern, utility, periodicity; exact with discover (at the query) or partition (after every batch).

        The result reads the state's present table, which the next batch replaces: write it to keep it.
        """
        if self.config.discover and not self.config.partition and not self._settled and len(self.batches) > 1:
            self._discover(self.history(1), self.discovery_threshold())
            self._settled = True
        return self.patterns.filter(self._answers()).select("pattern", "utility", P.floor_period("max_inner", "last_sid", self.n).alias("periodicity"))

    def buffered(self) -> DataFrame:
        """Tracked patterns that are regular and between the buffer's threshold and the present one."""
        period = P.floor_period("max_inner", "last_sid", self.n)
        regular = F.lit(True) if self.max_period is None else period <= self.max_period
        return self.patterns.filter(regular & (F.col("utility") < self.min_util) & (F.col("utility") >= self.theta)).select("pattern", "utility", period.alias("periodicity"))

    def counts(self) -> dict[str, int]:
        return {"answer": self.answer().count(), "buffered": self.buffered().count(), "tracked": self.patterns.count(), "evicted": self.evicted}


def merge(patterns: DataFrame, added: DataFrame) -> DataFrame:
    """Tracked patterns with the state(pattern, utility, first_sid, last_sid, intra) of later sequences added."""
    a = added.select("pattern", F.col("utility").alias("u"), "first_sid", F.col("last_sid").alias("hi"), "intra")
    return patterns.join(a, "pattern", "left").select(
        "pattern", "pat", (F.col("utility") + F.coalesce("u", F.lit(0))).alias("utility"), F.coalesce("hi", "last_sid").alias("last_sid"),
        F.greatest("max_inner", F.col("first_sid") - F.col("last_sid"), "intra").alias("max_inner"),
    )


def run(spark: SparkSession, db: DataFrame, n: int, ratios: list[float], config: Config) -> IncrementalMiner:
    """A miner fed with db cut into batches by the ratios; batches may be empty."""
    miner, at = IncrementalMiner(spark, config), 0
    for size in S.batch_sizes(n, ratios):
        part = db.filter((F.col("sid") >= at) & (F.col("sid") < at + size)).withColumn("sid", F.col("sid") - at)
        before = miner.n
        miner.process_batch(part)
        miner.n = before + size
        at += size
    return miner


def remine(db: DataFrame, n: int, ratios: list[float], config: Config) -> list[DataFrame]:
    """The answer after every batch, mined anew each time."""
    out, at = [], 0
    for size in S.batch_sizes(n, ratios):
        at += size
        seen = db.filter(F.col("sid") < at)
        total, _ = stats.totals(seen)
        if total == 0:
            continue
        bound = None if not config.regular else config.bound if config.bound is not None else T.max_period(config.period_ratio, at)
        out.append(mine(seen, max(1, T.min_utility(config.ratio, total)), bound, at, Options(max_len=config.max_len)))
    return out


def with_config(config: Config, **changes) -> Config:
    return replace(config, **changes)
