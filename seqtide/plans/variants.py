"""Named configurations of the incremental miner, and the splits by which batches arrive."""

from __future__ import annotations

from dataclasses import replace

from ..functions.thresholds import Buffer
from ..operators.incremental import Config

# Shares of the sequences in each batch.
SPLITS: dict[str, list[float]] = {
    "A": [0.25] * 4,
    "B": [0.1, 0.2, 0.3, 0.4],
    "C": [0.4, 0.1, 0.4, 0.1],
    "D": [0.4, 0.3, 0.2, 0.1],
    "fine": [1 / 16] * 16,
}


def _fixed(mu: float) -> Buffer:
    return Buffer("fix", fixed=mu, least=mu, most=mu)


def exact(base: Config) -> Config:
    """Seeds at the first batch's own threshold, discovery at the query; evicts under a constant bound."""
    return replace(base, buffer=_fixed(1.0), seed="ceiling", discover=True, partition=False, evict=base.bound is not None)


def partition(base: Config) -> Config:
    """Exact after every batch: each is mined at its own threshold."""
    return replace(exact(base), discover=False, partition=True)


def shifted(base: Config, mu: float) -> Config:
    """The exact miner with its seeds at another share of the threshold; the answer stays."""
    return replace(exact(base), buffer=_fixed(mu))


def inverted_index(base: Config) -> Config:
    return replace(exact(base), matcher="index")


def ablation(base: Config, ceiling: bool, discovery: bool, mu: float = 1.0) -> Config:
    """With or without the bound of the end while seeding, and discovery; only both are exact."""
    return replace(base, buffer=_fixed(mu), seed="ceiling" if ceiling else "current_seed", discover=discovery, partition=False, evict=False)


def approximate(base: Config, mu: float = 0.4) -> Config:
    return ablation(base, False, False, mu)


def fixed_buffer(base: Config, mu: float = 0.4) -> Config:
    """Seeds once below the threshold, regular in the first batch, and only maintains: a subset of the answer."""
    return replace(base, buffer=_fixed(mu), seed="current", discover=False, partition=False, evict=False)


def utility_only(base: Config) -> Config:
    """Incremental mining without the gap clause."""
    return replace(exact(base), regular=False, evict=False)
