"""Drill-down into any result row: its signal rebuilt as runs, and its trades by part of the plan.

Rows are named by ``rank``. Base rows have atr_period, mult_e4 and mode; ADAPTIVE_V2 rows have long_ and short_ periods and
multipliers and the regime columns. Trends are made once a distinct setting and regimes once a distinct configuration,
whatever the number of rows. A row of a series without candles has no runs; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.sources.written import stash

from . import backtest, indicators, reports
from .indicators import REGIME, SERIES

_RUN = (*SERIES, "rank", "first_idx", "last_idx", "side")


def base_runs(candles: DataFrame, rows: DataFrame) -> DataFrame:
    runs = indicators.trend_runs(candles, rows)
    met = runs.join(rows.select(*SERIES, "rank", "atr_period", "mult_e4", "mode"), [*SERIES, "atr_period", "mult_e4"])
    side = F.when(F.col("mode") == "LONG", 1).when(F.col("mode") == "SHORT", -1).otherwise(F.col("side"))
    return met.where(F.col("side") == side).select(*_RUN)


def adaptive_runs(candles: DataFrame, rows: DataFrame) -> DataFrame:
    ids = stash(rows.select(*REGIME).distinct().select(F.xxhash64(*REGIME).alias("regime_id"), *REGIME), "audit-regimes")
    named = rows.select(*SERIES, "rank", F.xxhash64(*REGIME).alias("regime_id"), *(f"{s}_{c}" for s in ("long", "short") for c in ("atr_period", "mult_e4")))
    regime = stash(indicators.regime_runs(candles, ids), "audit-regime-runs")

    def part(name: str, side: int) -> DataFrame:
        own = named.select(*SERIES, "rank", "regime_id", F.col(f"{name}_atr_period").alias("atr_period"), F.col(f"{name}_mult_e4").alias("mult_e4"))
        met = indicators.meet_runs(indicators.trend_runs(candles, own), regime, side, [])
        return met.join(own, [*SERIES, "atr_period", "mult_e4", "regime_id"]).select(*_RUN)

    return part("long", 1).unionByName(part("short", -1))


def selected_runs(candles: DataFrame, rows: DataFrame) -> DataFrame:
    """The signal of every row, as runs (symbol, tf, rank, first_idx, last_idx, side)."""
    found = base_runs(candles, rows.where("strategy_type = 'BASE'")) if {"atr_period", "mult_e4", "mode"} <= set(rows.columns) else None
    if {"long_atr_period", "short_atr_period", *REGIME} <= set(rows.columns):
        more = adaptive_runs(candles, rows.where("strategy_type = 'ADAPTIVE_V2'"))
        found = more if found is None else found.unionByName(more)
    return found


def audit(candles: DataFrame, rows: DataFrame, plan: DataFrame, fee: float, slippage: float) -> DataFrame:
    """Every trade of every row in the parts SELECTION, VALIDATION and HOLDOUT; short parts are not left out."""
    return backtest.trades(selected_runs(candles, rows), reports.audit_segments(plan), candles, ["rank"], fee, slippage, least_bars=0)
