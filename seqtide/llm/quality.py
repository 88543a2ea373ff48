"""Quality rules by weak supervision, in DataFrame expressions only.

Each rule votes good, bad or abstains on counts of the text.  The votes of all documents fall
into at most 2**len(RULES) patterns; expectation-maximisation over the pattern counts
estimates the share of good documents and how often each rule votes on good and on bad ones,
and so its accuracy; and a document is kept when its posterior probability of being good reaches one half.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import written

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: name -> (vote, when): 0 votes bad, 1 votes good, over the measured columns; it abstains otherwise.
RULES: dict[str, tuple[int, str]] = {
    "symbols": (0, "n_symbols * 100 > word_chars * 6"),
    "dup_lines": (0, "n_lines >= 4 AND n_dup_lines * 100 > n_lines * 30"),
    "repeats": (0, "n_repeat_words * 100 > n_words * 15"),
    "word_length": (0, "word_chars < n_words * 2.5 OR word_chars > n_words * 12"),
    "length": (0, "n_words < 15"),
    "no_sentences": (0, "n_words >= 60 AND n_ends * 100 < n_words"),
    "few_short_words": (0, "n_words >= 40 AND n_short * 100 < n_words * 8"),
    "digits": (0, "n_digits * 100 > word_chars * 30"),
    "prose": (1, "n_words >= 15 AND n_ends > 0 AND n_ends * 2 <= n_words AND n_symbols * 100 <= word_chars * 2"),
    "no_repeats": (1, "n_words >= 15 AND n_dup_lines = 0 AND n_repeat_words = 0"),
    "short_words": (1, "n_short * 100 >= n_words * 20 AND word_chars >= n_words * 3"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_short", "n_ends", "n_digits")
ROUNDS = 20
#: Before any document is seen a rule is taken to vote on this share of the documents of its side, and of the other, as if seen this often.
PRIOR = {0: (0.3, 0.02), 1: (0.8, 0.2)}
PRIOR_SEEN = 20.0


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _repeat_words(words: Column) -> Column:
    """Words covered by the WINDOW-word windows that occur twice or more."""

    def over_hashes(h: Column) -> Column:
        def over_sorted(s: Column) -> Column:
            twin = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
            at = F.array_sort(F.transform(twin, lambda x: x["i"]))
            start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
            step = lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last"))
            return F.aggregate(at, start, step, lambda a: a["n"])

        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(ordered, over_sorted))

    def over_words(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
        return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(_let(windows, over_hashes))

    return _let(F.transform(words, lambda x: F.xxhash64(x)), over_words)


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the counts that the rules read, as long columns, in place of columns of their names.

    A null text counts as empty; all counts are then 0.
    """
    docs = docs.drop(*MEASURES)
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: _without(x, SPACES) != "")
    of_words = lambda w: F.struct(F.size(w).alias("n_words"), _repeat_words(w).alias("n_repeat_words"), F.size(F.filter(w, lambda x: F.length(x) <= 3)).alias("n_short"))
    of_lines = lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))
    count = lambda chars: F.length(text) - F.length(_without(text, chars))
    rows = docs.select("*", _let(words, of_words).alias("__w"), _let(lines, of_lines).alias("__l"), F.length(_without(text, SPACES)).alias("__c"), count(SYMBOLS).alias("__s"), count(".!?").alias("__e"), count("0123456789").alias("__d"))
    long = lambda c, name: F.col(c).cast("long").alias(name)
    return rows.select(
        *[docs[c] for c in docs.columns],
        long("__w.n_words", "n_words"), long("__c", "word_chars"), long("__s", "n_symbols"), long("__l.n_dup_lines", "n_dup_lines"), long("__w.n_repeat_words", "n_repeat_words"),
        long("__l.n_lines", "n_lines"), long("__w.n_short", "n_short"), long("__e", "n_ends"), long("__d", "n_digits"),
    )


def votes(measured: DataFrame, rules: dict[str, tuple[int, str]] = RULES) -> DataFrame:
    """measured with a column vote_<rule> for each rule: 1 good, 0 bad, -1 abstains."""
    return measured.select("*", *[F.expr(f"CASE WHEN {when} THEN {side} ELSE -1 END").alias(f"vote_{name}") for name, (side, when) in rules.items()])


@dataclass(frozen=True)
class LabelModel:
    """Share of good documents, and for each rule the share of the good and of the bad ones that it votes on."""

    good: float
    fires: dict[str, tuple[float, float]]

    def posterior(self) -> Column:
        total = F.lit(math.log(self.good / (1 - self.good)))
        for name, (on_good, on_bad) in self.fires.items():
            total = total + F.when(F.col(f"vote_{name}") >= 0, F.lit(math.log(on_good / on_bad))).otherwise(F.lit(math.log((1 - on_good) / (1 - on_bad))))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def accuracy(self, rules: dict[str, tuple[int, str]] = RULES) -> dict[str, float]:
        """How often each rule is right when it votes."""
        side = {n: (self.good * g, (1 - self.good) * b) for n, (g, b) in self.fires.items()}
        return {n: (g if rules[n][0] else b) / (g + b) for n, (g, b) in side.items()}


def fit(voted: DataFrame, rules: dict[str, tuple[int, str]] = RULES, rounds: int = ROUNDS) -> LabelModel:
    """Expectation-maximisation over the counts of the vote patterns of all rows; no rows leave the prior.

    A rule is held to vote at least as often on its own side as on the other.
    """
    prior = {n: PRIOR[side][::-1] if side == 0 else PRIOR[side] for n, (side, _) in rules.items()}
    patterns = written(voted.groupBy(*[f"vote_{n}" for n in rules]).agg(F.count(F.lit(1)).alias("n")).coalesce(1))
    model = LabelModel(0.8, prior)
    for _ in range(rounds):
        p, n = model.posterior(), F.col("n")
        sums = [F.sum(n).alias("n"), F.sum(n * p).alias("good")]
        for name in rules:
            fired = F.col(f"vote_{name}") >= 0
            sums.append(F.sum(F.when(fired, n * p).otherwise(0.0)).alias(f"{name}_good"))
            sums.append(F.sum(F.when(fired, n * (1 - p)).otherwise(0.0)).alias(f"{name}_bad"))
        s = patterns.agg(*sums).first()
        if not s["n"]:
            return model
        now = {}
        for name, (side, _) in rules.items():
            parts = zip((s[f"{name}_good"], s[f"{name}_bad"]), (s["good"], s["n"] - s["good"]), prior[name], strict=True)
            on_good, on_bad = (min(0.999, max(0.001, (x + PRIOR_SEEN * before) / (all_ + PRIOR_SEEN))) for x, all_, before in parts)
            now[name] = (max(on_good, on_bad), on_bad) if side else (on_good, max(on_good, on_bad))
        before, model = model, LabelModel(min(0.99, max(0.01, s["good"] / s["n"])), now)
        if max(abs(a - b) for x in rules for a, b in zip(before.fires[x], now[x], strict=True)) < 1e-4:
            break
    return model


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the counts, base_failed, the posterior quality probability and kept.

    base_failed: under 20 words, or over 30 % of the words in repeated windows.  A null or empty
    text fails.  Ids may be null or repeated; every row is judged by itself.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = written(votes(measure(base).drop("text")))
    model = fit(rows)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = rows.withColumn("base_failed", failed).withColumn("quality_prob", model.posterior())
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("quality_prob") >= 0.5)).alias("kept"), "quality_prob", *[f"vote_{n}" for n in RULES])
