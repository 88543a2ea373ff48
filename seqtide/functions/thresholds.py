"""Thresholds and adaptive buffer factors, in double arithmetic."""

from __future__ import annotations

import math
from dataclasses import dataclass


def min_utility(ratio: float, total: int) -> int:
    return math.ceil(float(ratio) * float(total))


def max_period(ratio: float, sequences: int) -> int:
    return int(float(ratio) * float(sequences))


def risk(value: float, lower: float, upper: float) -> float:
    """The fourth root of where the value stands between the bounds, from 0 to 1."""
    return min(1.0, max(0.0, (value - lower) / (upper - lower))) ** 0.25


@dataclass(frozen=True)
class Buffer:
    """How far below the threshold patterns are tracked: a constant, or less when a batch is risky.

    The signals are the batch's utility and size against what was there, and the utility ratio;
    strategy: fix, growth, minbase, utilratio, or combined (the least of all).
    """

    strategy: str = "combined"
    fixed: float = 0.4
    least: float = 0.4
    most: float = 0.9
    with_base: bool = True
    # Ranges over which the signals count.
    utility_range: tuple[float, float] = (0.01, 0.20)
    base_range: tuple[float, float] = (0.001, 0.005)
    growth_range: tuple[float, float] = (0.05, 0.25)

    def factor(self, batch_utility: int, before_utility: int, batch_size: int, before_size: int, ratio: float) -> float:
        if self.strategy == "fix":
            return self.fixed
        if not before_utility or not before_size:
            return self.least
        signals = {
            "utilratio": (batch_utility / before_utility, self.utility_range),
            "growth": (batch_size / before_size, self.growth_range),
            "minbase": (ratio, self.base_range),
        }
        scaled = {k: self.most - risk(v, *between) * (self.most - self.least) for k, (v, between) in signals.items()}
        if self.strategy == "combined":
            chosen = min(v for k, v in scaled.items() if self.with_base or k != "minbase")
        else:
            chosen = scaled[self.strategy]
        return max(self.least, min(self.most, chosen))
