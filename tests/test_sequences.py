"""Sources, statistics, static mining, matching and functions."""

import time
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from seqtide.functions import metrics
from seqtide.functions import patterns as P
from seqtide.functions import thresholds as T
from seqtide.operators import compare, levels, match, mine, stats
from seqtide.operators.extend import extensions
from seqtide.operators.mine import Options
from seqtide.sources import sequences as S
from seqtide.sources import tables
from tests.fixtures import EXAMPLE, EXAMPLE2, EXAMPLE2_ANSWER, EXAMPLE_ANSWER, EXAMPLE_EUCS, brute_answer, brute_patterns, random_rows

SCHEMA = "sid long, ev int, item int, util long"


def read(spark, tmp_path, text, **options):
    (tmp_path / "eui.txt").write_text(text[0])
    (tmp_path / "seq.txt").write_text("\n".join(text[1]) + "\n")
    return S.read_sequences(spark, str(tmp_path / "seq.txt"), S.read_profits(spark, str(tmp_path / "eui.txt")), **options)


def as_dict(df):
    return {r["pattern"]: (r["utility"], r["periodicity"]) for r in df.collect()}


@pytest.mark.parametrize("text,total,answer,husp", [(EXAMPLE, (596, 9), EXAMPLE_ANSWER, 22), (EXAMPLE2, (128, 12), EXAMPLE2_ANSWER, 11)])
def test_golden(spark, tmp_path, text, total, answer, husp):
    db = read(spark, tmp_path, text).cache()
    u, n = stats.totals(db)
    assert (u, n) == total
    threshold, bound = T.min_utility(0.1, u), T.max_period(0.6, n)
    assert as_dict(mine.mine(db, threshold, bound, n)) == answer
    assert mine.mine(db, threshold, None, n).count() == husp


def test_golden_statistics(spark, tmp_path):
    db = read(spark, tmp_path, EXAMPLE).cache()
    assert {(r["x"], r["y"]): r["swu"] for r in stats.eucs_i(db).collect()} == EXAMPLE_EUCS["i"]
    assert {(r["x"], r["y"]): r["swu"] for r in stats.eucs_s(db).collect()} == EXAMPLE_EUCS["s"]
    assert {r["item"]: r["swu"] for r in stats.item_swu(db).collect()} == {1: 596, 2: 380, 3: 186, 4: 332, 5: 332}
    old, new = stats.eucs_s(db.filter("sid < 6")), stats.eucs_s(db.filter("sid >= 6"))
    assert {(r["x"], r["y"]): r["swu"] for r in stats.merged(old, new).collect()} == EXAMPLE_EUCS["s"]


def test_parser_variants(spark, tmp_path):
    text = ("1:2\nbad\n2,3\nx:y", ["1[2] 2 -1 9,4 zz 3[ -2", "# 1[1] -2", "-1 -1 -2", "", "2[1] 1[1] -1 1[5] -2 7[7]"])
    rows = [(r["sid"], r["ev"], r["item"], r["util"]) for r in read(spark, tmp_path, text).orderBy("sid", "pos").collect()]
    assert rows == [(0, 0, 1, 4), (0, 0, 2, 3), (0, 1, 9, 4), (1, 0, 1, 2), (2, 0, 1, 2), (2, 0, 2, 3), (2, 1, 1, 10)]
    strict = [(r["sid"], r["ev"], r["item"], r["util"]) for r in read(spark, tmp_path, text, default_profit=0, strict=True).orderBy("sid", "pos").collect()]
    assert strict == [(0, 0, 1, 4), (1, 0, 1, 2), (1, 0, 2, 3), (1, 1, 1, 10)]


def test_ingest_checks(spark):
    with pytest.raises(PySparkException, match="negative"):
        S.qsdb(spark.createDataFrame([(0, 0, 1, -1)], SCHEMA)).collect()
    twice = spark.createDataFrame([(0, 0, 1, 1), (0, 0, 1, 2)], SCHEMA)
    with pytest.raises(PySparkException, match="twice"):
        S.qsdb(twice).collect()
    assert S.qsdb(twice, duplicates="sum").first()["util"] == 3


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("options", [Options(max_len=3), Options(max_len=3, eucs=True, bound="none"), Options(max_len=4, bound="peu", prune_regularity=False)])
def test_random_against_brute_force(spark, seed, options):
    rows = random_rows(seed)
    db = S.qsdb(spark.createDataFrame(rows, SCHEMA)).cache()
    u, n = stats.totals(db)
    for bound in (6, None):
        assert as_dict(mine.mine(db, 60, bound, n, options)) == brute_answer(rows, 60, bound, n, options.max_len)


def test_no_limit_and_lineage_cut(spark):
    rows = [(s, e, 1 + e % 2, 5) for s in range(3) for e in range(7)]
    db = S.qsdb(spark.createDataFrame(rows, SCHEMA))
    got = as_dict(mine.mine(db, 30, None, 3))
    assert got == brute_answer(rows, 30, None, 3, 9) and any(len(k) > 18 for k in got)


def test_ends_are_not_stored(spark, monkeypatch):
    """Eleven thousand ends of three items from two hundred occurrences: only the occurrences are kept, once."""
    rows = [(s, e, 1 + (s + e) % 7, 1 + e) for s in range(10) for e in range(20)]
    db, kept = S.qsdb(spark.createDataFrame(rows, SCHEMA)).cache(), []
    monkeypatch.setattr(tables, "checkpointed", lambda df: kept.append(df) or df)
    monkeypatch.setattr(mine, "checkpointed", tables.checkpointed, raising=False)
    persist = type(db).persist
    monkeypatch.setattr(type(db), "persist", lambda self, *a: kept.append(self) or persist(self, *a))
    got = as_dict(mine.mine(db, 60, None, 10, Options(max_len=3)))
    assert got == brute_answer(rows, 60, None, 10, 3)
    assert len(kept) == 1 and kept[0].columns[0] == "slice" and "acc" not in kept[0].columns


@pytest.mark.parametrize("piece", [1, 7])
def test_pieces_of_a_level(spark, monkeypatch, piece):
    """A level cut into small pieces, whose rows are merged, sums up the same; so do slices of one sequence and pairs that prune."""
    whole = levels.summarised
    monkeypatch.setattr(levels, "summarised", lambda level: whole(level, piece))
    monkeypatch.setattr(mine, "SLICE_ROWS", 1)
    rows = random_rows(11, sequences=30, items=4)
    db = S.qsdb(spark.createDataFrame(rows, SCHEMA)).cache()
    for options in (Options(max_len=4), Options(max_len=4, eucs=True, bound="peu")):
        assert as_dict(mine.mine(db, 80, 9, 30, options)) == brute_answer(rows, 80, 9, 30, 4)


def test_summaries_follow_occurrences(spark, monkeypatch):
    """Few occurrences lie in one slice whatever the partitions, so a level writes and shuffles one row for each candidate."""
    rows = random_rows(11, sequences=60, items=4)
    db, sizes, seen = S.qsdb(spark.createDataFrame(rows, SCHEMA)).cache(), [], []

    def noted(df):
        out = tables.written(df)
        if out.columns == [c.split()[0] for c in levels.WITHIN.split(", ")]:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(mine, "written", noted)
    assert as_dict(mine.mine(db, 80, 9, 60, Options(max_len=3), seen)) == brute_answer(rows, 80, 9, 60, 3)
    assert sizes == [x["candidates"] for x in seen]
    assert mine.cut(0, 5_000_000, 1 << 25, 8) == (32, 4, 39063) and mine.cut(7, 9, 1 << 25, 8) == (3, 43, 1)


def test_blocks_of_a_slice(spark, monkeypatch):
    """A slice in many blocks has the gaps between them."""
    monkeypatch.setattr(mine, "BLOCK_ROWS", 1)
    rows = random_rows(12, sequences=30, items=4)
    db = S.qsdb(spark.createDataFrame(rows, SCHEMA)).cache()
    for options in (Options(max_len=3), Options(max_len=3, eucs=True, bound="peu")):
        assert as_dict(mine.mine(db, 60, 9, 30, options)) == brute_answer(rows, 60, 9, 30, 3)


def test_sums_in_a_list_are_those_in_arrays(monkeypatch):
    """Both of one block of all sequences, too."""
    rows = pa.table({"sid": [0, 0, 2, 2, 5, 5, 5, 6], "ev": [0, 1, 0, 0, 0, 1, 2, 0], "item": [3, 9, 3, 9, 9, 3, 9, 9], "util": [4, 2, 1, 7, 3, 3, 5, 8], "seq_util": [6, 6, 8, 8, 11, 11, 11, 8]})
    trie = pa.table({"slice": [0, 0], "level": [1, 1], "pid": [-1, -1], "ext": [1, 1], "item": [3, 9], "id": [70, 40]})

    def block(sids):
        part = rows.filter(pc.is_in(rows["sid"], pa.array(sids)))
        zeros = pa.chunked_array([[0] * part.num_rows])
        return levels.packed(part.append_column("slice", zeros).append_column("block", zeros))["data"][0].as_py()

    def found(level, *blocks):
        x = levels.Slice([block(b) for b in blocks], trie, level, 1).summary()
        return sorted(zip(*[x[c].tolist() for c in levels._NAMES[1:]], strict=True))

    for level in (1, 2):
        want = found(level, [0, 2, 5, 6])
        assert want and found(level, [0], [2, 5], [6]) == want
        with monkeypatch.context() as m:
            m.setattr(levels, "SUMS", 0)
            assert found(level, [0, 2, 5, 6]) == found(level, [0], [2, 5], [6]) == want
    # <(3)(9)> in 0 and 5; <(3 9)> in 2; <(9)(3)> and <(9)(9)> in 5.
    assert [x[:8] for x in found(2, [0], [2], [5, 6])] == [(40, 1, 3, 5, 5, 0, 1, 6), (40, 1, 9, 5, 5, 0, 1, 8), (70, 0, 9, 2, 2, 0, 1, 8), (70, 1, 9, 0, 5, 5, 2, 14)]


def test_codes_are_found_in_large_spaces():
    codes = np.array([3, 9, 200])
    asked = np.array([9, 0, 200, 3, 201, 4])
    for space in (300, levels.DENSE + 1):
        assert levels._find(codes, space)(asked[asked < space]).tolist() == [1, -1, 2, 0, -1, -1]
        assert levels._find(codes[:0], space)(asked).tolist() == [-1] * 6


def test_modes(spark):
    rows = random_rows(3, sequences=20)
    db = S.qsdb(spark.createDataFrame(rows, SCHEMA)).cache()
    found = {}
    for pattern, by_sid in brute_patterns(rows, 2).items():
        s = sorted(by_sid)
        intra = max([b - a for a, b in zip(s, s[1:], strict=False)], default=0)
        found[pattern] = (sum(by_sid.values()), s[0] + 1, intra, 20 - s[-1])
    want = lambda ok: {k for k, v in found.items() if v[0] >= 60 and ok(*v[1:])}
    run = lambda **o: {r["pattern"] for r in mine.mine(db, 60, 4, 20, Options(max_len=2, **o)).collect()}
    assert run(mode="seed") == want(lambda lead, intra, trail: max(lead, intra) <= 4)
    assert run(mode="window") == want(lambda lead, intra, trail: intra <= 4)
    assert run(mode="window", floor=True) == want(lambda lead, intra, trail: max(intra, trail) <= 4)


def test_empty_and_bad_arguments(spark):
    db = S.qsdb(spark.createDataFrame([], SCHEMA))
    assert stats.totals(db) == (0, 0) and mine.mine(db, 1, None, 0).collect() == []
    assert stats.dataset_stats(db).first()["n_sequences"] == 0
    with pytest.raises(ValueError):
        mine.mine(db, 0, None, 0)


def test_matchers_agree(spark):
    rows = random_rows(5)
    db = S.qsdb(spark.createDataFrame(rows, SCHEMA)).cache()
    known = mine.mine(db, 40, None, 14, Options(max_len=3)).select("pat").cache()
    want = {(p, s, u) for p, by in brute_patterns(rows, 3).items() if sum(by.values()) >= 40 for s, u in by.items()}
    for how in (match.trie_match, match.indexed_match, match.cross_match):
        assert {(r["pattern"], r["sid"], r["u"]) for r in how(db, known).collect()} == want
    assert match.trie_match(db, known.limit(0)).collect() == []


def test_gaps_across_slices(spark):
    rows = [(s, s // 3, 1) for s in (0, 1, 5, 6, 14)]
    df = spark.createDataFrame([("p", *r) for r in rows], "k string, sid long, slice int, v long")
    r = stats.gaps(df, ["k"], ["v"]).first()
    assert (r["first_sid"], r["last_sid"], r["intra"], r["support"], r["v"]) == (0, 14, 8, 5, 5)


def test_pattern_functions(spark):
    df = spark.createDataFrame([([[1, 2], [3]],), ([[5]],)], "p array<array<int>>")
    first = lambda c: [r[0] for r in df.select(c).collect()]
    assert first(P.render("p")) == ["<(1 2)(3)>", "<(5)>"]
    assert first(P.parse(P.render("p"))) == first(F.col("p"))
    assert first(P.intuitive("p")) == ["(1 2) 3", "5"]
    assert first(P.i_concat("p", F.lit(9))) == [[[1, 2], [3, 9]], [[5, 9]]]
    assert first(P.s_concat("p", F.lit(9))) == [[[1, 2], [3], [9]], [[5], [9]]]
    assert first(P.drop_last(P.i_concat("p", F.lit(9)))) == first(F.col("p")) == first(P.drop_last(P.s_concat("p", F.lit(9))))
    assert first(P.length("p")) == [3, 1]
    odd = spark.createDataFrame([("<(2 1 2)(3)>",), ("<()>",), ("x",), (None,)], "s string")
    assert [r[0] for r in odd.select(P.render(P.canonical(P.parse("s")))).collect()] == ["<(1 2)(3)>", None, None, None]


def test_thresholds():
    assert (T.min_utility(0.07, 100), T.max_period(0.29, 100)) == (8, 28)
    assert T.Buffer("fix", fixed=0.7).factor(1, 1, 1, 1, 0.1) == 0.7
    b = T.Buffer()
    assert b.factor(5, 0, 5, 0, 0.1) == 0.4 and b.factor(1, 1000, 1, 1000, 0.0001) == 0.9 and b.factor(900, 1000, 1, 1000, 0.0001) == 0.4
    assert T.Buffer("growth").factor(900, 1000, 1, 1000, 0.1) == 0.9
    assert T.Buffer(with_base=False).factor(1, 1000, 1, 1000, 0.1) == 0.9


def test_compare(spark):
    df = lambda *names: spark.createDataFrame([(x,) for x in names], "pattern string")
    r = compare.recall_precision(df("a", "b"), df("b", "c", "d")).first()
    assert (r["result_size"], r["oracle_size"], r["oracle_hits"], r["precision"]) == (2, 3, 1, 0.5) and abs(r["recall"] - 1 / 3) < 1e-12
    assert compare.contained(df("a"), df("a", "b")) and not compare.contained(df("a", "z"), df("a"))


def test_pattern_files(spark, tmp_path):
    df = spark.createDataFrame([("<(1)>", 5, 2), ("<(2)>", 9, -1)], "pattern string, utility long, periodicity int")
    S.write_patterns(df, str(tmp_path / "out"), by_utility=True)
    assert {r[0] for r in spark.read.text(str(tmp_path / "out")).collect()} == {"<(1)> #UTIL: 5 #PER: 2", "<(2)> #UTIL: 9"}
    assert sorted(map(tuple, S.read_patterns(spark, str(tmp_path / "out")).collect())) == [("<(1)>", 5, 2), ("<(2)>", 9, -1)]


def test_batch_sizes():
    assert S.batch_sizes(9, [0.4, 0.1, 0.4, 0.1]) == [4, 1, 4, 0] and S.batch_sizes(9, [1 / 16] * 16) == [*[1] * 9, *[0] * 7]
    assert S.batch_sizes(12, [0.1, 0.2, 0.3, 0.4]) == [1, 2, 4, 5]


def test_speedups_and_names(spark):
    runs = spark.createDataFrame([(1, 8.0), (1, 10.0), (1, 90.0), (2, 5.0), (4, 4.0), (4, 1.0), (None, 3.0), (2, None)], "threads int, seconds double")
    assert {r["threads"]: (r["median"], r["speedup"], r["efficiency"]) for r in metrics.speedups(runs).collect()} == {1: (10.0, 1.0, 1.0), 2: (5.0, 2.0, 1.0), 4: (2.5, 4.0, 1.0)}
    assert metrics.speedups(runs.filter("threads > 1")).filter("speedup IS NOT NULL").collect() == []
    assert metrics.dataset_tag("/a/b.c/bible_seq.txt") == "bible" and metrics.trim_number(2.0) == "2" and metrics.trim_number(0.25) == "0.25"


def test_search_counters(spark):
    rows = random_rows(6)
    db = S.qsdb(spark.createDataFrame(rows, SCHEMA)).cache()
    seen, plain = [], []
    mine.mine(db, 60, 6, 14, Options(max_len=3), seen)
    mine.mine(db, 60, 6, 14, Options(max_len=3, bound="none", prune_regularity=False), plain)
    assert all(x["candidates"] == x["pruned_by_bound"] + x["pruned_by_gap"] + x["explored"] for x in seen + plain)
    assert sum(x["explored"] for x in seen) < sum(x["explored"] for x in plain) and all(x["pruned_by_gap"] == 0 for x in plain)


def test_one_long_sequence(spark):
    """Two thousand events in one sequence: the extension has a row for each occurrence, not for each pair."""
    db = S.qsdb(spark.createDataFrame([(0, e, 1 + e % 2, 1) for e in range(2000)], SCHEMA))
    occ = db.select("sid", "ev", "pos", "item", "util")
    ends = occ.select("sid", F.col("item").alias("pid"), F.col("item").alias("last"), "ev", "pos", F.col("util").alias("acc"))
    assert extensions(ends, occ, ["sid"]).groupBy("pid", "ext").count().collect() and extensions(ends, occ, ["sid"]).count() == 1999 + 1998


def test_shuffles_of_a_written_table_go_at_once(spark):
    """What a written table was made from needs no disk any more, though the driver has not collected its garbage."""
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {str(f) for f in blocks.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    spark.sparkContext._jvm.System.gc()
    before, df = shuffles(), spark.range(1000).selectExpr("id % 7 AS k", "id").groupBy("k").count()
    table = tables.written(df)
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before and table.count() == df.count() == 7
    assert shuffles() - before, "the files are looked for in the wrong place"
    tables.forget(table)


def test_a_cluster_needs_a_shared_folder():
    """Without spark.checkpoint.dir only a Spark of one process gets a folder on this machine."""

    def session(master, at=None):
        conf = SimpleNamespace(get=lambda name, default=None: at)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))

    for master in ("spark://a:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError):
            tables.shared_dir(session(master))
        assert tables.shared_dir(session(master, "hdfs://x/y/")) == "hdfs://x/y"
    assert tables.shared_dir(session("local")) == tables.shared_dir(session("local[4]"))
