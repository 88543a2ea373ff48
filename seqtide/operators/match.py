"""Matching known patterns against sequences: by trie levels, or by an inverted index of items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..sources.tables import checkpointed, forget, written
from . import stats
from .extend import co_partitioned, extensions


def trie(patterns: DataFrame) -> DataFrame:
    """Edges (parent, ext, item, node, depth, terminal) of patterns(pat); a node is named by its prefix.

    Each prefix is one row however many patterns share it, so it is evaluated once.
    """
    steps = patterns.select("pat", P.path("pat").alias("path"))
    prefix = lambda k: F.aggregate(F.slice(F.col("path"), 1, k), F.lit(""), lambda a, x: F.concat(a, F.when(x["ext"] == 0, " ").otherwise(")("), x["item"].cast("string")))
    rows = steps.select("path", F.posexplode("path").alias("k", "step")).select(prefix(F.col("k")).alias("parent"), F.col("step.ext").alias("ext"), F.col("step.item").alias("item"), prefix(F.col("k") + 1).alias("node"), (F.col("k") + 1).alias("depth"), (F.col("k") + 1 == F.size("path")).alias("terminal"))
    return rows.groupBy("parent", "ext", "item", "node", "depth").agg(F.max("terminal").alias("terminal"))


def _pattern(node: str):
    return F.concat(F.lit("<"), F.substring(node, 2, 1 << 30), F.lit(")>"))


def trie_match(db: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, sid, u): the best utility of each pattern in each sequence that holds it, as a written table."""
    with co_partitioned(db.sparkSession):
        return _trie_match(db, patterns)


def _trie_match(db: DataFrame, patterns: DataFrame) -> DataFrame:
    edges = written(trie(patterns))
    depth = edges.agg(F.max("depth")).first()[0]
    if depth is None:
        return db.sparkSession.createDataFrame([], "pattern string, sid long, u long")
    occ = db.select("sid", "ev", "pos", "item", "util").repartition(int(db.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sid").persist()
    out, levels = None, []
    for level in range(1, depth + 1):
        own = edges.filter(F.col("depth") == level).select("parent", "ext", "item", "node", "terminal")
        if not levels:
            rows = occ.join(own.drop("parent", "ext"), "item").withColumnRenamed("util", "acc")
        else:
            ends = levels[-1].select("sid", F.col("node").alias("pid"), F.col("item").alias("last"), "ev", "pos", "acc")
            rows = extensions(ends, occ, ["sid"]).withColumnRenamed("pid", "parent").join(own, ["parent", "ext", "item"])
        rows = rows.select("sid", "ev", "pos", "item", "node", "terminal", "acc")
        levels.append(checkpointed(rows) if level < depth else rows)
        done = levels[-1].filter("terminal").groupBy(_pattern("node").alias("pattern"), "sid").agg(F.max("acc").alias("u"))
        out = done if out is None else out.unionByName(done)
    out = written(out)
    occ.unpersist()
    forget(edges, *levels)
    return out


def candidate_sequences(db: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, sid) of the sequences that hold every item of the pattern."""
    items = patterns.select(P.render("pat").alias("pattern"), F.explode(F.array_distinct(F.flatten("pat"))).alias("item"))
    need = items.groupBy("pattern").agg(F.count(F.lit(1)).alias("need"))
    hits = db.select("sid", "item").distinct().join(items, "item").groupBy("pattern", "sid").agg(F.count(F.lit(1)).alias("have"))
    return hits.join(need, "pattern").filter("have = need").select("pattern", "sid")


def indexed_match(db: DataFrame, patterns: DataFrame) -> DataFrame:
    """As trie_match; each pattern looks only at sequences that the inverted index of its items leaves."""
    return _each(db, patterns, candidate_sequences(db, patterns))


def cross_match(db: DataFrame, patterns: DataFrame) -> DataFrame:
    """As trie_match, over all pairs of pattern and sequence: a plain comparison for small inputs only."""
    return _each(db, patterns, patterns.select(P.render("pat").alias("pattern")).crossJoin(db.select("sid").distinct()))


def _each(db: DataFrame, patterns: DataFrame, pairs: DataFrame) -> DataFrame:
    """Best utility for each (pattern, sid), by a fold over the pattern's steps with the sequence as an array."""
    seqs = db.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("pos", "ev", "item", "util"))).alias("o"))  # one sequence each
    rows = pairs.join(patterns.select(P.render("pat").alias("pattern"), P.path("pat").alias("path")), "pattern").join(seqs, "sid")
    none = F.array().cast("array<struct<pos:int,ev:int,acc:bigint>>")

    def extend(ends, step):
        def reach(o):
            before = F.filter(ends, lambda e: (e["pos"] < o["pos"]) & ((e["ev"] == o["ev"]) == (step["ext"] == 0)))
            return F.struct(o["pos"].alias("pos"), o["ev"].alias("ev"), (F.array_max(F.transform(before, lambda e: e["acc"])) + o["util"]).alias("acc"))

        return F.filter(F.transform(F.filter(F.col("o"), lambda o: o["item"] == step["item"]), reach), lambda e: e["acc"].isNotNull())

    first = F.transform(F.filter(F.col("o"), lambda o: o["item"] == F.get("path", 0)["item"]), lambda o: F.struct(o["pos"].alias("pos"), o["ev"].alias("ev"), o["util"].alias("acc")))
    ends = F.aggregate(F.slice("path", 2, 1 << 30), F.coalesce(first, none).cast("array<struct<pos:int,ev:int,acc:bigint>>"), lambda a, s: extend(a, s).cast("array<struct<pos:int,ev:int,acc:bigint>>"))
    return rows.select("pattern", "sid", F.array_max(F.transform(ends, lambda e: e["acc"])).alias("u")).filter("u IS NOT NULL")


def state_of(matches: DataFrame) -> DataFrame:
    """(pattern, utility, first_sid, last_sid, intra) of matches(pattern, sid, u)."""
    return stats.gaps(stats.sliced(matches.withColumnRenamed("u", "utility")), ["pattern"], ["utility"]).drop("support")
