"""Decay score, fidelity tiers and threshold arithmetic as Column expressions (JVM-side)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from memlake.config import DECAY_LAMBDA, DEFAULT_THRESHOLDS, Thresholds


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hours_since(last_accessed="last_accessed", now: int | Column = 0) -> Column:
    now_c = now if isinstance(now, Column) else F.lit(int(now))
    return (now_c - _c(last_accessed)) / F.lit(3600.0)


def decay_score(importance="importance", last_accessed="last_accessed", now: int | Column = 0,
                lam: float = DECAY_LAMBDA) -> Column:
    """importance * exp(-lambda * max(0, hours since last access))."""
    h = F.greatest(F.lit(0.0), hours_since(last_accessed, now))
    return _c(importance) * F.exp(F.lit(-float(lam)) * h)


def fidelity(score="score", th: Thresholds = DEFAULT_THRESHOLDS) -> Column:
    s = _c(score)
    return (F.when(s >= th.hot, "hot").when(s >= th.warm, "warm").when(s >= th.cool, "cool")
            .when(s >= th.faded, "faded").otherwise("gone"))


def js_round(x: Column) -> Column:
    """Math.round: nearest integer, halves go up."""
    return F.floor(x + F.lit(0.5)).cast("bigint")


def hot_hours(importance="importance", th: Thresholds = DEFAULT_THRESHOLDS,
              lam: float = DECAY_LAMBDA) -> Column:
    """Hours a memory stays hot: round(ln(importance / hot) / lambda); negative below hot."""
    return js_round(F.log(_c(importance) / F.lit(th.hot)) / F.lit(lam))


def half_life_hours(lam: float = DECAY_LAMBDA) -> int:
    return int(math.floor(math.log(2) / lam + 0.5))


def threshold_scale(budget, max_budget) -> Column:
    """1 / max(0.1, budget / max_budget): thresholds rise as the budget shrinks."""
    return F.lit(1.0) / F.greatest(F.lit(0.1), _c(budget) / _c(max_budget))
