"""Window statistics and the phase, research and version-1 robust scores, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .backtest import INVALID

VALID = -1e8


def _clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def phase_score(trades: Column, ret: Column, drawdown: Column, profit_factor: Column, windows: Column, positive: Column, median: Column, worst: Column, min_trades: Column, sample: float = 300.0, base: float = 0.20, low: float = 0.25, high: float = 1.8, least_windows: int = 2) -> Column:
    value = (
        ret / F.greatest(drawdown, F.lit(2.0)) * _clip(profit_factor, 0.0, 3.0) * F.sqrt(F.least(trades, F.lit(int(sample))) / sample) * (F.lit(base) + F.lit(1 - base) * positive)
        * (F.lit(1.0) / (F.lit(1.0) + F.greatest(-worst, F.lit(0.0)) / 10.0)) * _clip(F.lit(1.0) + median / 10.0, low, high)
    )
    return F.when((trades < min_trades) | (windows < least_windows), INVALID).otherwise(value)


def research_score(sel: Column, val: Column, sel_pos: Column, val_pos: Column, sel_med: Column, val_med: Column) -> Column:
    low, high = F.least(sel, val), F.greatest(sel, val)
    both = F.sqrt(sel * val) * (F.lit(1.0) / (F.lit(1.0) + F.abs(sel_med - val_med) / 8.0)) * (F.lit(0.30) + F.lit(0.70) * F.least(sel_pos, val_pos)) * (F.lit(0.35) + F.lit(0.65) * F.sqrt(F.greatest(low / high, F.lit(0.0))))
    return F.when(low <= VALID, INVALID).when(low <= 0.0, low - F.lit(0.25) * F.abs(sel - val)).otherwise(both)


def robust_v1(score: Column, balance: list[tuple[Column, Column]]) -> Column:
    """A version-1 phase score (sample 350, base .15, median .30 to 1.80, four windows) times the balance over regimes that
    occur; balance: (windows, positive ratio) of each regime."""
    rates = F.array_compact(F.array(*(F.when(n > 0, p) for n, p in balance)))
    factor = F.when(F.size(rates) > 0, F.lit(0.55) + F.lit(0.45) * F.array_min(rates)).otherwise(0.55)
    return F.when(score <= VALID, INVALID).otherwise(score * factor)


def window_stats(rows: DataFrame, group: list[str], value: str = "return_pct", when: Column | None = None, prefix: str = "") -> list[Column]:
    """Aggregates of window returns: windows, positive_ratio, median, worst and best (0 without windows)."""
    x = F.col(value) if when is None else F.when(when, F.col(value))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return [
        F.count(x).alias(f"{prefix}windows"), zero(F.avg(F.when(x > 0, 1.0).when(x <= 0, 0.0))).alias(f"{prefix}positive_ratio"), zero(F.median(x)).alias(f"{prefix}median_return_pct"),
        zero(F.min(x)).alias(f"{prefix}worst_return_pct"), zero(F.max(x)).alias(f"{prefix}best_return_pct"), zero(F.avg(x)).alias(f"{prefix}avg_return_pct"),
    ]
