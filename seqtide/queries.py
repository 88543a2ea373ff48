"""Queries over the driver's tables, one or more for each operator, with the SQL they must agree with.

Two views serve as sequence databases: ``sess`` (events, one item an event) and ``cust``
(orders, several items an event).  No query limits the length of patterns unless its name
says so.  The SQL of sess is unpruned on purpose: it enumerates every pattern and filters at
the end.  Sequences of cust are too long for that: its SQL drops, level by level, patterns
whose best value with all that remains (peu) is below the threshold.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import metrics as M
from .functions import patterns as P
from .functions import thresholds as T
from .operators import compare, incremental, match, mine, stats
from .operators.incremental import Config
from .plans import variants as V
from .sources import sequences as S
from .sources.tables import shared_dir, written
from .streaming.micro_batches import StreamFeed, start

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SESS = dict(ratio=0.014, period=0.09, bound=350)
CUST = dict(ratio=0.0035, period=0.13, bound=1000)

SQL_VIEWS = {
    "sess": """k AS (SELECT dense_rank() OVER (ORDER BY CAST(ts AS DATE), user_id) - 1 AS sid, ts, event_id, event_type, value FROM events),
o AS (SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY ts, event_id) - 1 AS ev, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 WHEN 'view' THEN 5 END AS item, CAST(floor(value) AS BIGINT) + 1 AS util FROM k)""",
    "cust": """b AS (SELECT l_orderkey, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INT) AS item, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS util FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
k AS (SELECT dense_rank() OVER (ORDER BY year(o_orderdate), o_custkey) - 1 AS sid, o_orderdate, o_orderkey, item, util FROM b JOIN orders ON l_orderkey = o_orderkey),
o AS (SELECT sid, dense_rank() OVER (PARTITION BY sid ORDER BY o_orderdate, o_orderkey) - 1 AS ev, item, util FROM k)""",
}


def _q(view: str) -> str:
    return f"""WITH RECURSIVE {SQL_VIEWS[view]},
q1 AS (SELECT sid, CAST(ev AS INT) AS ev, CAST(row_number() OVER (PARTITION BY sid ORDER BY ev, item) - 1 AS INT) AS pos, item, util FROM o),
q AS (SELECT *, CAST(coalesce(sum(util) OVER (PARTITION BY sid ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS BIGINT) AS rem, CAST(sum(util) OVER (PARTITION BY sid) AS BIGINT) AS seq_util FROM q1),
tot AS (SELECT CAST(sum(util) AS BIGINT) AS u, max(sid) + 1 AS n FROM q)"""


def _patterns(name: str, max_len: int | None = None, where: str = "true", threshold: str | None = None) -> str:
    """CTEs ending in <name>(pattern, utility, first_sid, last_sid, intra, support) over the rows of q that meet the condition.

    With a threshold only patterns whose peu reaches it are extended, and so only they are whole in the result.
    """
    step = f"""SELECT CASE WHEN b.ev = a.ev THEN a.pat || ' ' || b.item ELSE a.pat || ')(' || b.item END AS pat, a.sid, b.ev, b.item AS last, b.pos, max(a.acc + b.util) AS acc, a.len + 1 AS len, any_value(b.rem) AS rem
  FROM {name}_g a JOIN q b ON b.sid = a.sid AND b.pos > a.pos AND (b.ev > a.ev OR b.item > a.last) WHERE {"true" if max_len is None else f"a.len < {max_len}"} GROUP BY ALL"""
    if threshold:
        step = f"""SELECT pat, sid, ev, last, pos, acc, len, rem FROM (SELECT *, sum(CASE WHEN nth = 1 THEN top ELSE 0 END) OVER (PARTITION BY pat) AS peu FROM
  (SELECT *, max(acc + rem) OVER (PARTITION BY pat, sid) AS top, row_number() OVER (PARTITION BY pat, sid ORDER BY pos) AS nth FROM ({step}))) WHERE peu >= {threshold}"""
    return f""",
{name}_g AS (
  SELECT '<(' || item AS pat, sid, ev, item AS last, pos, util AS acc, 1 AS len, rem FROM q WHERE {where}
  UNION ALL
  {step}),
{name}_m AS (SELECT pat || ')>' AS pattern, sid, max(acc) AS u FROM {name}_g GROUP BY ALL),
{name}_w AS (SELECT *, sid - lag(sid) OVER (PARTITION BY pattern ORDER BY sid) AS gap FROM {name}_m),
{name} AS (SELECT pattern, CAST(sum(u) AS BIGINT) AS utility, min(sid) AS first_sid, max(sid) AS last_sid, coalesce(max(gap), 0) AS intra, count(*) AS support FROM {name}_w GROUP BY pattern)"""


_PER = "greatest(first_sid + 1, intra, n - last_sid)"


def _answer(view: str, p: dict, bound: str | None = "abs", regular: str | None = None, cols: str = "pattern, utility, {per} AS periodicity") -> str:
    gap = {"abs": f"{_PER} <= {p['bound']}", "rel": f"{_PER} <= floor({p['period']}::DOUBLE * n)", None: "true"}[bound]
    threshold = f"(SELECT ceil({p['ratio']}::DOUBLE * u) FROM tot)" if view == "cust" else None
    return f"{_q(view)}{_patterns('p', p.get('max_len'), threshold=threshold)} SELECT {cols.format(per=_PER)} FROM p, tot WHERE utility >= ceil({p['ratio']}::DOUBLE * u) AND {regular or gap}"


def _add(name: str, sql: str | None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def _view(view: str, spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, int]:
    """The view's database, written once for the query's many passes, its utility and number of sequences."""
    db = written({"sess": S.sessions, "cust": S.customers}[view](spark, sf_dir))
    return db, *stats.totals(db)


def _mined(view: str, p: dict, spark: SparkSession, sf_dir: str, bound: str | None = "abs", **options) -> DataFrame:
    db, u, n = _view(view, spark, sf_dir)
    gap = {"abs": p["bound"], "rel": T.max_period(p["period"], n), None: None}[bound]
    return mine.mine(db, max(1, T.min_utility(p["ratio"], u)), gap, n, mine.Options(**({"max_len": p["max_len"]} if "max_len" in p else {}), **options))


# tables and statistics

_add("qsdb_build", f"{_q('cust')} SELECT sid, ev, pos, item, util, rem, seq_util FROM q")(lambda spark, d: S.customers(spark, d).drop("batch_id"))
_add("qsdb_rem", f"{_q('sess')} SELECT sid, pos, rem FROM q")(lambda spark, d: S.sessions(spark, d).select("sid", "pos", "rem"))
_add("seq_utility", f"{_q('sess')} SELECT DISTINCT sid, seq_util FROM q")(lambda spark, d: stats.sequence_utility(S.sessions(spark, d)))
_add("dataset_stats", f"""{_q('cust')}, s AS (SELECT sid, count(*) AS i, count(DISTINCT ev) AS e, sum(util) AS u FROM q GROUP BY sid)
SELECT count(*) AS n_sequences, (SELECT count(DISTINCT item) FROM q) AS distinct_items, avg(i) AS avg_len_items, max(i) AS max_len_items, avg(e) AS avg_events, max(e) AS max_events, CAST(sum(u) AS BIGINT) AS total_utility FROM s""")(lambda spark, d: stats.dataset_stats(S.customers(spark, d)))
_SWU = "SELECT item, CAST(sum(seq_util) AS BIGINT) AS swu FROM (SELECT DISTINCT sid, item, seq_util FROM q) GROUP BY item"
_EUCS_I = "SELECT x, y, CAST(sum(seq_util) AS BIGINT) AS swu FROM (SELECT DISTINCT a.sid, a.item AS x, b.item AS y, a.seq_util FROM q a JOIN q b ON a.sid = b.sid AND a.ev = b.ev AND a.item < b.item) GROUP BY x, y"
_EUCS_S = "SELECT x, y, CAST(sum(seq_util) AS BIGINT) AS swu FROM (SELECT DISTINCT a.sid, a.item AS x, b.item AS y, a.seq_util FROM q a JOIN q b ON a.sid = b.sid AND a.ev < b.ev) GROUP BY x, y"
_add("item_swu", f"{_q('cust')} {_SWU}")(lambda spark, d: stats.item_swu(S.customers(spark, d)))
_add("eucs_i", f"{_q('cust')} {_EUCS_I}")(lambda spark, d: stats.eucs_i(S.customers(spark, d)))
_add("eucs_s", f"{_q('cust')} {_EUCS_S}")(lambda spark, d: stats.eucs_s(S.customers(spark, d)))


@_add("eucs_incremental", f"{_q('cust')} {_EUCS_S}")
def eucs_incremental(spark: SparkSession, d: str) -> DataFrame:
    db, _, n = _view("cust", spark, d)
    return stats.merged(*[stats.eucs_s(part) for part in (db.filter(F.col("sid") < n // 2), db.filter(F.col("sid") >= n // 2))])


_ITEMS = f"""{_q('cust')}, d AS (SELECT DISTINCT sid, item, seq_util FROM q), g AS (SELECT *, sid - lag(sid) OVER (PARTITION BY item ORDER BY sid) AS gap FROM d),
r AS (SELECT item, CAST(sum(seq_util) AS BIGINT) AS swu, min(sid) AS first_sid, max(sid) AS last_sid, greatest(min(sid) + 1, coalesce(max(gap), 0)) AS max_inner, coalesce(max(gap), 0) AS max_intra, greatest(min(sid) + 1, coalesce(max(gap), 0), (SELECT n FROM tot) - max(sid)) AS periodicity FROM g GROUP BY item)"""


@_add("item_regularity", f"{_ITEMS} SELECT * FROM r")
def item_regularity(spark: SparkSession, d: str) -> DataFrame:
    db, _, n = _view("cust", spark, d)
    return stats.item_regularity(db, n)


TIER0 = dict(ratio=0.31, bound=35)


def _tier0(mode: str) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        db, u, n = _view("cust", spark, d)
        return stats.tier0(db, T.min_utility(TIER0["ratio"], u), TIER0["bound"], n, mode).select("item", "swu")

    return query


for _mode, _name, _c in (("full", "tier0_items", "periodicity"), ("seed", "tier0_items_seed", "max_inner"), ("window", "tier0_items_window", "max_intra")):
    _add(_name, f"{_ITEMS} SELECT item, swu FROM r, tot WHERE swu >= ceil({TIER0['ratio']}::DOUBLE * u) AND {_c} <= {TIER0['bound']}")(_tier0(_mode))


def _pairs(view: str, later: bool) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        db, _, _ = _view(view, spark, d)
        a = db.select("sid", F.col("pos").alias("pos_a"), F.col("ev").alias("ev_a"), F.col("item").alias("x"))
        b = db.select("sid", F.col("pos").alias("pos_b"), F.col("ev").alias("ev_b"), F.col("item").alias("y"))
        return a.join(b, "sid").filter("ev_b > ev_a" if later else "ev_b = ev_a AND y > x").select("sid", "pos_a", "pos_b", "x", "y")

    return query


for _view_name, _name, _on in (("sess", "s_extension_pairs", "b.ev > a.ev"), ("cust", "i_extension_pairs", "b.ev = a.ev AND b.item > a.item")):
    _add(_name, f"{_q(_view_name)} SELECT a.sid, a.pos AS pos_a, b.pos AS pos_b, a.item AS x, b.item AS y FROM q a JOIN q b ON a.sid = b.sid AND {_on}")(_pairs(_view_name, _view_name == "sess"))


@_add("max_measure_len2", f"{_q('cust')}{_patterns('p', 2)} SELECT pattern, utility, support FROM p")
def max_measure_len2(spark: SparkSession, d: str) -> DataFrame:
    db, _, n = _view("cust", spark, d)
    return mine.mine(db, 1, None, n, mine.Options(max_len=2)).select("pattern", "utility", "support")


_add("peu_bound_len1", f"{_q('cust')} SELECT item, CAST(sum(u) AS BIGINT) AS utility, CAST(sum(p) AS BIGINT) AS peu FROM (SELECT sid, item, max(util) AS u, max(util + rem) AS p FROM q GROUP BY ALL) GROUP BY item")(lambda spark, d: stats.peu_items(S.customers(spark, d)))
_add("local_swu_len1", f"{_q('cust')} SELECT x AS item, 0 AS ext, y AS next, swu FROM ({_EUCS_I}) UNION ALL SELECT x, 1, y, swu FROM ({_EUCS_S})")(lambda spark, d: stats.local_swu(written(S.customers(spark, d))))
_add("tsu_len1", f"{_q('cust')} SELECT item, CAST(sum(t) AS BIGINT) AS tsu FROM (SELECT sid, item, arg_min(util + rem, pos) AS t FROM q GROUP BY ALL) GROUP BY item")(lambda spark, d: stats.tsu_items(S.customers(spark, d)))
_add("tsu_len2", f"""{_q('sess')}, f AS (SELECT sid, item, max(util) AS best, arg_min(util, pos) AS head, max(util + rem) AS peu FROM q GROUP BY ALL),
e AS (SELECT a.sid, a.item AS x, CASE WHEN a.ev = b.ev THEN 0 ELSE 1 END AS ext, b.item AS y, b.pos, max(a.util) + any_value(b.util) + any_value(b.rem) AS t FROM q a JOIN q b ON a.sid = b.sid AND b.pos > a.pos GROUP BY ALL),
h AS (SELECT sid, x, ext, y, arg_min(t, pos) AS t FROM e GROUP BY ALL)
SELECT x AS item, ext, y AS next, CAST(sum(CASE WHEN best = head THEN t ELSE peu END) AS BIGINT) AS tsu FROM h JOIN f ON f.sid = h.sid AND f.item = h.x GROUP BY ALL""")(lambda spark, d: stats.tsu_pairs(written(S.sessions(spark, d))))


@_add("pattern_gaps", f"{_q('sess')}{_patterns('p', 2)} SELECT pattern, first_sid, last_sid, greatest(first_sid + 1, intra) AS max_inner, {_PER} AS periodicity FROM p, tot")
def pattern_gaps(spark: SparkSession, d: str) -> DataFrame:
    db, _, n = _view("sess", spark, d)
    return mine.mine(db, 1, None, n, mine.Options(max_len=2)).select("pattern", "first_sid", "last_sid", "max_inner", "periodicity")


@_add("pattern_floor", f"{_q('sess')}{_patterns('p', 2)} SELECT pattern, greatest(first_sid + 1, intra, n + 100 - last_sid) AS floor FROM p, tot")
def pattern_floor(spark: SparkSession, d: str) -> DataFrame:
    db, _, n = _view("sess", spark, d)
    return mine.mine(db, 1, None, n, mine.Options(max_len=2)).select("pattern", P.floor_period("max_inner", "last_sid", n + 100).alias("floor"))


# static mining

_add("rhusp_static_rel", _answer("sess", SESS, "rel"))(lambda spark, d: mine.answer(_mined("sess", SESS, spark, d, "rel")))
_add("rhusp_static_abs", _answer("cust", CUST))(lambda spark, d: mine.answer(_mined("cust", CUST, spark, d)))
_add("rhusp_static_len3", _answer("cust", CUST | {"max_len": 3}))(lambda spark, d: mine.answer(_mined("cust", CUST | {"max_len": 3}, spark, d)))
_add("rhusp_flags_no_gap_pruning", _answer("sess", SESS))(lambda spark, d: mine.answer(_mined("sess", SESS, spark, d, prune_regularity=False)))
_add("husp_static", _answer("sess", SESS, None))(lambda spark, d: mine.answer(_mined("sess", SESS, spark, d, None)))
_add("husp_static_cust", _answer("cust", CUST, None))(lambda spark, d: mine.answer(_mined("cust", CUST, spark, d, None)))


def _bounded(name: str) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        db, u, n = _view("sess", spark, d)
        return mine.answer(mine.mine(db, T.min_utility(SESS["ratio"], u), SESS["bound"], n, mine.Options(bound=name, eucs=True)))

    return query


for _name in ("none", "peu", "la"):
    _add(f"rhusp_flags_eucs_{_name}", _answer("sess", SESS))(_bounded(_name))

_TOP = 20
_add("rhusp_top_utility", _answer("sess", SESS) + f" ORDER BY utility DESC, pattern LIMIT {_TOP}")(lambda spark, d: mine.answer(_mined("sess", SESS, spark, d)).orderBy(F.desc("utility"), "pattern").limit(_TOP))
_SPACED = "trim(regexp_replace(regexp_replace(regexp_replace(trim(pattern, '<>'), '\\((\\d+)\\)', ' \\1 ', 'g'), '\\)\\(', ') (', 'g'), ' +', ' ', 'g'))"
_scrambled = lambda c: P.render(F.transform(P.parse(c), lambda e: F.concat(F.reverse(e), e)))
_add("canonical_keys", _answer("cust", CUST, cols="pattern"))(lambda spark, d: _mined("cust", CUST, spark, d).select(P.render(P.canonical(P.parse(_scrambled("pattern")))).alias("pattern")))
_add("intuitive_format", _answer("cust", CUST, cols=f"{_SPACED} AS text, utility"))(lambda spark, d: _mined("cust", CUST, spark, d).select(P.intuitive("pat").alias("text"), "utility"))
_INNER, _TRAIL = "greatest(first_sid + 1, intra)", "n - last_sid"
_MODES = {
    "rhusp_seed_mode": (dict(mode="seed"), f"{_INNER} <= {SESS['bound']}"),
    "rhusp_window_mode": (dict(mode="window"), f"intra <= {SESS['bound']}"),
    "rhusp_floor": (dict(mode="window", floor=True), f"intra <= {SESS['bound']} AND {_TRAIL} <= {SESS['bound']}"),
}
for _name, (_options, _sql) in _MODES.items():
    _add(_name, _answer("sess", SESS, regular=_sql))(lambda spark, d, o=_options: mine.answer(_mined("sess", SESS, spark, d, **o)))


_SHORTER = "CASE WHEN len = 1 THEN NULL ELSE regexp_replace(regexp_replace(b.pattern, '(\\(| )\\d+\\)>$', ')>'), '\\)\\)>$', ')>') END"


@_add("search_counters", f"""{_q('sess')}{_patterns('p')}, t AS (SELECT ceil({SESS['ratio']}::DOUBLE * u) AS thr FROM tot),
b AS (SELECT pattern, len, sum(top) AS peu FROM (SELECT pat || ')>' AS pattern, sid, len, max(acc + rem) AS top FROM p_g GROUP BY ALL) GROUP BY ALL),
f AS (SELECT b.*, peu >= thr AS bounded, {_PER} <= {SESS['bound']} AS regular, {_SHORTER} AS shorter FROM b JOIN p ON b.pattern = p.pattern, tot, t)
SELECT len AS level, count(*) AS candidates, count(*) FILTER (NOT bounded) AS pruned_by_bound, count(*) FILTER (bounded AND NOT regular) AS pruned_by_gap, count(*) FILTER (bounded AND regular) AS explored
FROM f WHERE shorter IS NULL OR shorter IN (SELECT pattern FROM f WHERE bounded AND regular) GROUP BY len""")
def search_counters(spark: SparkSession, d: str) -> DataFrame:
    """What the search meets, cuts and explores at each level, without co-occurrence pairs and with the plain bound."""
    db, u, n = _view("sess", spark, d)
    seen: list[dict] = []
    mine.mine(db, max(1, T.min_utility(SESS["ratio"], u)), SESS["bound"], n, mine.Options(bound="peu"), seen)
    return spark.createDataFrame([tuple(x.values()) for x in seen if x["candidates"]], "level int, candidates long, pruned_by_bound long, pruned_by_gap long, explored long")


def _split(name: str) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        db, _, n = _view("sess", spark, d)
        return S.with_batches(db, n, V.SPLITS[name]).groupBy("batch_id").agg(F.countDistinct("sid").alias("sequences"), F.sum("util").alias("utility"))

    return query


for _name, _ratios in V.SPLITS.items():
    _cases, _before = [], "0"
    for _k, _r in enumerate(_ratios[:-1]):
        _before = f"least(n, {_before} + floor(n * {_r!r}::DOUBLE + 0.5))"
        _cases.append(f"WHEN sid < {_before} THEN {_k}")
    _add(f"batch_split_{_name}", f"{_q('sess')} SELECT CASE {' '.join(_cases)} ELSE {len(_ratios) - 1} END AS batch_id, count(DISTINCT sid) AS sequences, CAST(sum(util) AS BIGINT) AS utility FROM q, tot GROUP BY 1")(_split(_name))


@_add("rhusp_minus_husp", f"SELECT * FROM ({_answer('sess', SESS)}) EXCEPT SELECT * FROM ({_answer('sess', SESS, None)})")
def rhusp_minus_husp(spark: SparkSession, d: str) -> DataFrame:
    return compare.only_in(mine.answer(_mined("sess", SESS, spark, d)), mine.answer(_mined("sess", SESS, spark, d, None)))


@_add("husp_minus_rhusp", _answer("sess", SESS, regular=f"{_PER} > {SESS['bound']}"))
def husp_minus_rhusp(spark: SparkSession, d: str) -> DataFrame:
    return compare.only_in(mine.answer(_mined("sess", SESS, spark, d, None)), mine.answer(_mined("sess", SESS, spark, d)))


# incremental mining: sess with a constant bound, batches by split

INC = dict(ratio=0.014, period=0.075, bound=300)


def _config(spark_n: int | None = None, bound: int | None = INC["bound"]) -> Config:
    return Config(ratio=INC["ratio"], period_ratio=INC["period"], bound=bound, final_sequences=spark_n)


def _incremental(split: str, make: Callable[[Config], Config], relative: bool = False) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        db, _, n = _view("sess", spark, d)
        return incremental.run(spark, db, n, V.SPLITS[split], make(_config(n, None if relative else INC["bound"]))).answer()

    return query


for _name in "ABCD":
    _add(f"incremental_exact_{_name}", _answer("sess", INC))(_incremental(_name, V.exact))
_add("incremental_fine", _answer("sess", INC))(_incremental("fine", V.exact))
_add("incremental_relative", _answer("sess", INC, "rel"))(_incremental("A", V.exact, True))
_add("incremental_partition", _answer("sess", INC))(_incremental("A", V.partition))
_add("incremental_invindex", _answer("sess", INC))(_incremental("D", V.inverted_index))
_add("incremental_shifted", _answer("sess", INC))(_incremental("D", lambda c: V.shifted(c, 0.4)))
_add("incremental_husp", _answer("sess", INC, None))(_incremental("A", V.utility_only))


def _old(share: float) -> str:
    return f"{_q('sess')}, cut AS (SELECT floor(n * {share}::DOUBLE + 0.5) AS m FROM tot), old AS (SELECT CAST(sum(util) AS BIGINT) AS u0 FROM q, cut WHERE sid < m)"


def _seeded(mu: float, old_regular: str, final: str, cols: str = f"f.pattern, f.utility, {_PER.replace('first_sid', 'f.first_sid').replace('intra', 'f.intra').replace('last_sid', 'f.last_sid')} AS periodicity") -> str:
    """Patterns that the first 40 % bring to mu of its threshold with regular gaps, as they stand at the end."""
    return f"""{_old(0.4)}{_patterns('s', None, 'sid < (SELECT m FROM cut)')}{_patterns('f')},
seed AS (SELECT pattern FROM s, cut, old WHERE utility >= ceil({mu}::DOUBLE * greatest(1, ceil({INC['ratio']}::DOUBLE * u0))) AND {old_regular})
SELECT {cols} FROM f JOIN seed ON f.pattern = seed.pattern, tot WHERE {final}"""


_END = f"utility >= ceil({INC['ratio']}::DOUBLE * u) AND greatest(f.first_sid + 1, f.intra, n - f.last_sid) <= "
_add("incremental_fixmu", _seeded(0.4, f"greatest(first_sid + 1, intra, m - last_sid) <= floor({INC['period']}::DOUBLE * m)", f"{_END}floor({INC['period']}::DOUBLE * n)"))(_incremental("D", lambda c: V.fixed_buffer(c, 0.4), True))
_add("ablation_ceiling_only", _seeded(1.0, f"{_INNER} <= floor({INC['period']}::DOUBLE * (SELECT n FROM tot))", f"{_END}floor({INC['period']}::DOUBLE * n)"))(_incremental("D", lambda c: V.ablation(c, True, False), True))
_add("ablation_approximate", _seeded(0.4, f"{_INNER} <= floor({INC['period']}::DOUBLE * m)", f"{_END}floor({INC['period']}::DOUBLE * n)"))(_incremental("D", lambda c: V.approximate(c), True))


@_add("evict_permanent", _seeded(1.0, f"{_INNER} <= {INC['bound']} AND m - last_sid <= {INC['bound']}", f"greatest(f.first_sid + 1, f.intra, n - f.last_sid) <= {INC['bound']}"))
def evict_permanent(spark: SparkSession, d: str) -> DataFrame:
    db, _, n = _view("sess", spark, d)
    miner = incremental.run(spark, db, n, V.SPLITS["D"], V.exact(_config(n)))
    return miner.patterns.select("pattern", "utility", P.floor_period("max_inner", "last_sid", n).alias("periodicity"))


@_add("buffered_shs", _seeded(0.4, f"{_INNER} <= floor({INC['period']}::DOUBLE * (SELECT n FROM tot))", f"utility < ceil({INC['ratio']}::DOUBLE * u) AND utility >= 0.4::DOUBLE * ceil({INC['ratio']}::DOUBLE * u) AND greatest(f.first_sid + 1, f.intra, n - f.last_sid) <= floor({INC['period']}::DOUBLE * n)"))
def buffered_shs(spark: SparkSession, d: str) -> DataFrame:
    db, _, n = _view("sess", spark, d)
    return incremental.run(spark, db, n, V.SPLITS["D"], V.shifted(_config(n, None), 0.4)).buffered()


_BUDGET = 10


@_add("budget_class", f"""{_q('sess')}{_patterns('p')}, cut AS (SELECT rtrim(pattern, ')>') AS head FROM p, tot WHERE {_INNER} > floor({INC['period']}::DOUBLE * n)), t AS (SELECT pattern, utility, {_PER} AS floor, utility >= ceil({INC['ratio']}::DOUBLE * u) AND {_PER} <= floor({INC['period']}::DOUBLE * n) AS ok FROM p, tot WHERE utility >= ceil(0.1::DOUBLE * ceil({INC['ratio']}::DOUBLE * u)) AND {_INNER} <= floor({INC['period']}::DOUBLE * n)
  AND NOT EXISTS (SELECT 1 FROM cut WHERE starts_with(pattern, head || ' ') OR starts_with(pattern, head || ')('))),
r AS (SELECT *, count(*) FILTER (NOT ok) OVER (ORDER BY floor RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM t)
SELECT pattern, utility, floor AS periodicity FROM r WHERE ok OR upto <= {_BUDGET}""")
def budget_class(spark: SparkSession, d: str) -> DataFrame:
    db, _, n = _view("sess", spark, d)
    config = incremental.with_config(V.shifted(_config(n, None), 0.1), max_tracked=_BUDGET)
    miner = incremental.IncrementalMiner(spark, config)
    miner.initial_build(db)
    return miner.patterns.select("pattern", "utility", P.floor_period("max_inner", "last_sid", n).alias("periodicity"))


def _remine_sql(ratios: list[float], bound: str) -> str:
    """The answer after each batch, with the batch's number; batches cut as batch_split does."""
    out, before = [], "0"
    for k, r in enumerate(ratios):
        before = "n" if k == len(ratios) - 1 else f"least(n, {before} + floor(n * {r!r}::DOUBLE + 0.5))"
        out.append(f"SELECT * FROM ({_q('sess')}, cut AS (SELECT {before} AS m FROM tot), t AS (SELECT CAST(sum(util) AS BIGINT) AS u FROM q, cut WHERE sid < m){_patterns('p', None, 'sid < (SELECT m FROM cut)')} SELECT {k} AS batch, pattern, utility, greatest(first_sid + 1, intra, CAST(m AS BIGINT) - last_sid) AS periodicity FROM p, cut, t WHERE utility >= ceil({INC['ratio']}::DOUBLE * u) AND greatest(first_sid + 1, intra, m - last_sid) <= {bound})")
    return " UNION ALL ".join(out)


def _remined(split: str) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        db, _, n = _view("sess", spark, d)
        out = None
        for k, x in enumerate(incremental.remine(db, n, V.SPLITS[split], _config(n))):
            rows = mine.answer(x).withColumn("batch", F.lit(k))
            out = rows if out is None else out.unionByName(rows)
        return out

    return query


_add("remine_each_batch", _remine_sql(V.SPLITS["A"], str(INC["bound"])))(_remined("A"))
_add("remine_fine", _remine_sql(V.SPLITS["fine"], str(INC["bound"])))(_remined("fine"))


_MATCH_SQL = f"{_q('sess')}{_patterns('p')} SELECT m.pattern, m.sid, m.u FROM p_m m JOIN p ON m.pattern = p.pattern, tot WHERE p.utility >= ceil({INC['ratio']}::DOUBLE * tot.u) AND greatest(first_sid + 1, intra, n - last_sid) <= {INC['bound']}"


def _matched(how) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        db, u, n = _view("sess", spark, d)
        known = written(mine.mine(db, T.min_utility(INC["ratio"], u), INC["bound"], n).select("pat"))
        return how(db, known).select("pattern", "sid", "u")

    return query


_add("trie_match", _MATCH_SQL)(_matched(match.trie_match))
_add("invindex_match", _MATCH_SQL)(_matched(match.indexed_match))


@_add("discovery_candidates", f"""{_old(0.4)}{_patterns('s', None, 'sid < (SELECT m FROM cut)')}{_patterns('f')}{_patterns('d', None, 'sid >= (SELECT m FROM cut)')},
first AS (SELECT greatest(1, ceil({INC['ratio']}::DOUBLE * u0)) AS theta FROM old),
seed AS (SELECT pattern FROM s, cut, first WHERE utility >= theta AND {_INNER} <= {INC['bound']} AND m - last_sid <= {INC['bound']}),
tracked AS (SELECT f.pattern FROM f JOIN seed ON f.pattern = seed.pattern, tot WHERE {_PER} <= {INC['bound']})
SELECT pattern FROM d, tot, first WHERE utility >= greatest(1, ceil({INC['ratio']}::DOUBLE * u) - theta) AND intra <= {INC['bound']} AND n - last_sid <= {INC['bound']} AND pattern NOT IN (SELECT pattern FROM tracked)""")
def discovery_candidates(spark: SparkSession, d: str) -> DataFrame:
    db, _, n = _view("sess", spark, d)
    miner = incremental.run(spark, db, n, V.SPLITS["D"], V.exact(_config(n)))
    return miner.candidates(miner.history(1), miner.discovery_threshold()).select("pattern")


_STRICTER = INC | {"ratio": 0.0165}


@_add("recall_precision", f"""WITH r AS ({_answer("sess", _STRICTER, None, cols="pattern")}), e AS ({_answer("sess", INC, cols="pattern")}), h AS (SELECT count(*) AS n FROM r WHERE pattern IN (SELECT pattern FROM e))
SELECT (SELECT count(*) FROM r) AS result_size, (SELECT count(*) FROM e) AS oracle_size, n AS oracle_hits, n / (SELECT count(*) FROM e)::DOUBLE AS recall, n / (SELECT count(*) FROM r)::DOUBLE AS "precision" FROM h""")
def recall_precision(spark: SparkSession, d: str) -> DataFrame:
    """A higher threshold without the gap clause against the answer: the one loses patterns, the other lets in too many."""
    return compare.recall_precision(mine.answer(_mined("sess", _STRICTER, spark, d, None)), mine.answer(_mined("sess", INC, spark, d)))


@_add("text_roundtrip", _answer("sess", INC))
def text_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Sequences written as text with unit profits, read back and mined, the answer written and read as text."""
    db, _, _ = _view("sess", spark, d)
    at = f"{shared_dir(spark)}/text-{uuid.uuid4().hex}"
    _as_text(db, f"{at}/seq")
    db.select(F.concat(F.col("item").cast("string"), F.lit(":1")).alias("value")).distinct().write.text(f"{at}/eui")
    back = written(S.read_sequences(spark, f"{at}/seq", S.read_profits(spark, f"{at}/eui")))
    u, n = stats.totals(back)
    found = mine.answer(mine.mine(back, T.min_utility(INC["ratio"], u), INC["bound"], n))
    S.write_patterns(found, f"{at}/out", by_utility=True)
    return S.read_patterns(spark, f"{at}/out")


def _as_text(db: DataFrame, at: str) -> None:
    """The database as lines of sequences, with every utility written as a quantity."""
    events = db.groupBy("sid", "ev").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item", "util"))), lambda x: F.concat(x["item"].cast("string"), F.lit("["), x["util"].cast("string"), F.lit("]"))), " ").alias("t"))
    lines = events.groupBy("sid").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ev", "t"))), lambda x: x["t"]), " -1 "), F.lit(" -2")).alias("value"))
    lines.orderBy("sid").select("value").write.text(at)


@_add("text_profits", f"""{_q('sess')} SELECT item, CAST(sum(util * CASE WHEN item < 4 THEN 10 * item ELSE 1 END) AS BIGINT) AS lenient, CAST(sum(util * CASE WHEN item < 4 THEN 10 * item ELSE 0 END) AS BIGINT) AS strict FROM q GROUP BY item""")
def text_profits(spark: SparkSession, d: str) -> DataFrame:
    """Sequences read as text with profits of three items alone: those missing count 1, and 0 for the strict reader."""
    db, _, _ = _view("sess", spark, d)
    at = f"{shared_dir(spark)}/profits-{uuid.uuid4().hex}"
    _as_text(db, f"{at}/seq")
    spark.range(1, 4).select(F.concat(F.col("id").cast("string"), F.lit(":"), (F.col("id") * 10).cast("string")).alias("value")).write.text(f"{at}/eui")
    profits = S.read_profits(spark, f"{at}/eui")
    total = lambda name, **o: S.read_sequences(spark, f"{at}/seq", profits, **o).groupBy("item").agg(F.sum("util").alias(name))
    return total("lenient").join(total("strict", default_profit=0, strict=True), "item")


@_add("large_patterns", _answer("sess", SESS, None, cols=f"{_SPACED} || ' #UTIL: ' || utility AS line"))
def large_patterns(spark: SparkSession, d: str) -> DataFrame:
    at = f"{shared_dir(spark)}/large-{uuid.uuid4().hex}"
    S.write_large_patterns(_mined("sess", SESS, spark, d, None), at)
    return spark.read.text(at).withColumnRenamed("value", "line")


@_add("pattern_counts", f"""{_q('sess')}{_patterns('p')}, t AS (SELECT ceil({INC['ratio']}::DOUBLE * u) AS thr, floor({INC['period']}::DOUBLE * n) AS most, n FROM tot),
cut AS (SELECT rtrim(pattern, ')>') AS head FROM p, t WHERE {_INNER} > most),
s AS (SELECT utility >= thr AND {_PER} <= most AS ok, utility < thr AND utility >= 0.4::DOUBLE * thr AND {_PER} <= most AS near FROM p, t WHERE utility >= ceil(0.4::DOUBLE * thr) AND {_INNER} <= most
  AND NOT EXISTS (SELECT 1 FROM cut WHERE starts_with(pattern, head || ' ') OR starts_with(pattern, head || ')(')))
SELECT count(*) FILTER (ok) AS answer, count(*) FILTER (near) AS buffered, count(*) AS tracked, CAST(0 AS BIGINT) AS evicted FROM s""")
def pattern_counts(spark: SparkSession, d: str) -> DataFrame:
    """A pattern is not tracked below one whose gaps are too long for good, as its own will be."""
    db, _, n = _view("sess", spark, d)
    miner = incremental.IncrementalMiner(spark, V.shifted(_config(n, None), 0.4))
    miner.initial_build(db)
    return spark.createDataFrame([tuple(miner.counts().values())], "answer long, buffered long, tracked long, evicted long")


_BUFFERS = {k: T.Buffer(k) for k in ("fix", "growth", "minbase", "utilratio", "combined")}


def _buffer_sql() -> str:
    b = T.Buffer()
    risk = lambda x, r: f"{b.most} - pow(least(1.0, greatest(0.0, ({x} - {r[0]}) / ({r[1]} - {r[0]}))), 0.25) * ({b.most} - {b.least})"
    u, g, m = risk("du / bu", b.utility_range), risk("dn / bn", b.growth_range), risk(f"{INC['ratio']}", b.base_range)
    kinds = {"fix": f"{b.fixed}", "growth": g, "minbase": m, "utilratio": u, "combined": f"least({u}, {g}, {m})"}
    parts = " UNION ALL ".join(f"SELECT '{k}' AS strategy, batch, round(CAST(CASE WHEN batch = 0 THEN {b.fixed if k == 'fix' else b.least} ELSE greatest({b.least}, least({b.most}, {e})) END AS DOUBLE), 9) AS factor FROM f" if k != "fix" else f"SELECT 'fix' AS strategy, batch, round(CAST({b.fixed} AS DOUBLE), 9) AS factor FROM f" for k, e in kinds.items())
    return f"""{_q('sess')}, c AS (SELECT least(n, floor(n * 0.1::DOUBLE + 0.5)) AS a, n FROM tot), c2 AS (SELECT a, least(n, a + floor(n * 0.2::DOUBLE + 0.5)) AS b, n FROM c), c3 AS (SELECT a, b, least(n, b + floor(n * 0.3::DOUBLE + 0.5)) AS c, n FROM c2),
w AS (SELECT CASE WHEN sid < a THEN 0 WHEN sid < b THEN 1 WHEN sid < c THEN 2 ELSE 3 END AS batch, sum(util)::DOUBLE AS du, count(DISTINCT sid)::DOUBLE AS dn FROM q, c3 GROUP BY 1),
f AS (SELECT batch, du, dn, sum(du) OVER (ORDER BY batch) - du AS bu, sum(dn) OVER (ORDER BY batch) - dn AS bn FROM w) {parts}"""


@_add("adaptive_buffers", _buffer_sql())
def adaptive_buffers(spark: SparkSession, d: str) -> DataFrame:
    """The buffer factor of every strategy at each of four growing batches."""
    db, _, n = _view("sess", spark, d)
    seen = {r["batch_id"]: (r["u"], r["n"]) for r in S.with_batches(db, n, V.SPLITS["B"]).groupBy("batch_id").agg(F.sum("util").alias("u"), F.countDistinct("sid").alias("n")).collect()}
    rows, before = [], (0, 0)
    for k in sorted(seen):
        rows += [(name, k, round(b.factor(seen[k][0], before[0], seen[k][1], before[1], INC["ratio"]), 9)) for name, b in _BUFFERS.items()]
        before = (before[0] + seen[k][0], before[1] + seen[k][1])
    return spark.createDataFrame(rows, "strategy string, batch int, factor double")


@_add("speedup_table", "WITH m AS (SELECT l_linenumber AS threads, median(l_extendedprice) AS median FROM lineitem GROUP BY 1) SELECT threads, median, (SELECT median FROM m WHERE threads = 1) / median AS speedup, (SELECT median FROM m WHERE threads = 1) / median / threads AS efficiency FROM m")
def speedup_table(spark: SparkSession, d: str) -> DataFrame:
    """Line numbers stand for threads and prices for times."""
    return M.speedups(spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_linenumber").alias("threads"), F.col("l_extendedprice").alias("seconds")))


@_add("stream_foreachbatch", _answer("sess", INC))
def stream_foreachbatch(spark: SparkSession, d: str) -> DataFrame:
    """The view as a stream of four files into the incremental miner."""
    db, _, n = _view("sess", spark, d)
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    size = -(-n // 4)
    rows = db.select(F.col("sid").alias("seq"), "ev", "item", "util")
    for k in range(4):
        rows.filter((F.col("seq") >= k * size) & (F.col("seq") < (k + 1) * size)).coalesce(1).write.parquet(f"{at}/in/batch={k}")
    feed = StreamFeed(incremental.IncrementalMiner(spark, V.exact(_config(n))))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{at}/in/batch=*")
    start(stream, feed, f"{at}/checkpoint").awaitTermination()
    return feed.miner.answer()

