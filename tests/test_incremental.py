"""Incremental mining: exactness over splits, baselines, eviction, budget, streams."""

import pytest

from seqtide.operators import incremental as I
from seqtide.operators import stats
from seqtide.plans import variants as V
from seqtide.sources import sequences as S
from seqtide.streaming.micro_batches import StreamFeed, start
from tests.fixtures import EXAMPLE, EXAMPLE_ANSWER, EXAMPLE_FIXED, EXAMPLE_SEEDS, brute_answer, random_rows
from tests.test_sequences import SCHEMA, as_dict, read

BASE = I.Config(ratio=0.1, period_ratio=0.6, final_sequences=9)
TWO = [6 / 9, 3 / 9]


@pytest.fixture(scope="module")
def example(spark, tmp_path_factory):
    return read(spark, tmp_path_factory.mktemp("ex"), EXAMPLE).cache()


def test_seeds(spark, example):
    miner = I.IncrementalMiner(spark, V.exact(BASE))
    miner.initial_build(example.filter("sid < 6"))
    assert {r["pattern"]: r["utility"] for r in miner.patterns.collect()} == EXAMPLE_SEEDS
    assert as_dict(miner.answer()) == {"<(1)(2)>": (104, 2), "<(2)>": (96, 2)}


@pytest.mark.parametrize("split", ["A", "C"])
def test_exact_over_splits(spark, example, split):
    assert as_dict(I.run(spark, example, 9, V.SPLITS[split], V.exact(BASE)).answer()) == EXAMPLE_ANSWER


@pytest.mark.parametrize("make", [V.partition, V.inverted_index, lambda c: V.shifted(c, 0.4)])
def test_exact_variants(spark, example, make):
    assert as_dict(I.run(spark, example, 9, TWO, make(BASE)).answer()) == EXAMPLE_ANSWER


def test_constant_bound_evicts(spark, example):
    miner = I.run(spark, example, 9, TWO, V.exact(I.Config(ratio=0.1, bound=5)))
    assert as_dict(miner.answer()) == EXAMPLE_ANSWER and miner.evicted >= 4


def test_fixed_buffer_is_a_subset(spark, example):
    got = as_dict(I.run(spark, example, 9, TWO, V.fixed_buffer(BASE)).answer())
    assert set(got) == EXAMPLE_FIXED and all(EXAMPLE_ANSWER[k] == v for k, v in got.items())


def test_ablation_loses_patterns(spark, example):
    got = as_dict(I.run(spark, example, 9, TWO, V.ablation(BASE, True, False)).answer())
    assert set(got) < set(EXAMPLE_ANSWER)


@pytest.mark.parametrize("seed", [1, 4])
def test_random_exact(spark, seed):
    rows = random_rows(seed, sequences=18)
    db = S.qsdb(spark.createDataFrame(rows, SCHEMA)).cache()
    total, n = stats.totals(db)
    base = I.Config(ratio=0.08, period_ratio=0.4, final_sequences=n, max_len=3)
    want = brute_answer(rows, -(-total * 8 // 100), int(0.4 * n), n, 3)
    assert as_dict(I.run(spark, db, n, V.SPLITS["B"], V.exact(base)).answer()) == want
    husp = brute_answer(rows, -(-total * 8 // 100), None, n, 3)
    assert as_dict(I.run(spark, db, n, V.SPLITS["D"], V.utility_only(base)).answer()) == husp
    last = I.remine(db, n, V.SPLITS["B"], base)[-1]
    assert as_dict(last.select("pattern", "utility", "periodicity")) == want


def test_budget_keeps_its_class(spark):
    rows = random_rows(9, sequences=16)
    db = S.qsdb(spark.createDataFrame(rows, SCHEMA)).cache()
    total, n = stats.totals(db)
    config = I.with_config(V.exact(I.Config(ratio=0.08, period_ratio=0.5, final_sequences=n, max_len=2)), max_tracked=3)
    miner = I.run(spark, db, n, [0.5, 0.5], config)
    got, limit = as_dict(miner.answer()), miner.complete_up_to()
    want = brute_answer(rows, -(-total * 8 // 100), n // 2, n, 2)
    assert limit is not None and set(got) <= set(want)
    assert {k: v for k, v in want.items() if v[1] <= limit}.items() <= got.items()


def test_discovery_needs_a_threshold(spark, example):
    miner = I.run(spark, example, 9, TWO, V.shifted(BASE, 4.0))
    with pytest.raises(ValueError):
        miner.answer()


def test_stream(spark, example, tmp_path):
    rows = example.selectExpr("sid AS seq", "ev", "item", "util")
    for k, (lo, hi) in enumerate(((0, 4), (4, 6), (6, 9))):
        rows.filter(f"seq >= {lo} AND seq < {hi}").coalesce(1).write.parquet(str(tmp_path / f"in/b={k}"))
    feed = StreamFeed(I.IncrementalMiner(spark, V.exact(BASE)))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/b=*"))
    start(stream, feed, str(tmp_path / "checkpoint")).awaitTermination()
    assert as_dict(feed.miner.answer()) == EXAMPLE_ANSWER
    before = feed.miner.n
    feed(rows, feed.last)
    assert feed.miner.n == before


def test_stream_goes_on_after_a_restart(spark, example, tmp_path):
    """A driver is lost after two of three batches, the last of them processed but not saved; a new feed gives the whole answer."""
    rows, state, config = example.selectExpr("sid AS seq", "ev", "item", "util"), str(tmp_path / "state"), V.exact(BASE)

    def run(feed, upto):
        for k, (lo, hi) in enumerate(((0, 4), (4, 6), (6, 9))[:upto]):
            if not (tmp_path / f"in/b={k}").exists():
                rows.filter(f"seq >= {lo} AND seq < {hi}").coalesce(1).write.parquet(str(tmp_path / f"in/b={k}"))
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/b=*"))
        start(stream, feed, str(tmp_path / "checkpoint")).awaitTermination()

    run(StreamFeed.resume(spark, config, state), 1)

    def fail(*_):
        raise RuntimeError("the driver is lost")

    lost = StreamFeed.resume(spark, config, state)
    assert lost.last == 0 and lost.miner.n == 4
    lost.miner.save = fail
    with pytest.raises(Exception, match="lost"):
        run(lost, 2)
    again = StreamFeed.resume(spark, config, state)
    run(again, 3)
    assert again.last == 2 and as_dict(again.miner.answer()) == EXAMPLE_ANSWER
    assert as_dict(StreamFeed.resume(spark, config, state).miner.answer()) == EXAMPLE_ANSWER


def test_increments_become_one_table(spark, example, monkeypatch):
    monkeypatch.setattr(I, "TABLES", 2)
    miner = I.run(spark, example, 9, [1 / 9] * 9, V.exact(BASE))
    assert len(miner.batches) <= 3 and miner._appended == 9 and as_dict(miner.answer()) == EXAMPLE_ANSWER
