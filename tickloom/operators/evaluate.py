"""Evaluation of settings over a plan: trades of all segments, metrics of the phases, window statistics and scores, one row a
setting in the flat result form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.sources.written import stash

from . import backtest, scoring
from .indicators import SERIES

PHASES = ("RESEARCH", "SELECTION", "VALIDATION", "HOLDOUT")


def evaluate(runs: DataFrame, settings: DataFrame, keys: list[str], segments: DataFrame, candles: DataFrame, fee: float, slippage: float, min_trades: int, raise_to: str | None = None, fused: bool = False) -> DataFrame:
    """settings: one row a (series, keys). Results: selection_, validation_ and wf_ window statistics, up_, down_ and flat_
    regime statistics, train_ (research) and test_ (hold-out) metrics, selection_score, validation_score, robust_score."""
    group = [*SERIES, *keys]
    made = stash(backtest.trades(runs, segments, candles, keys, fee, slippage, raise_to), "trades")  # phases, months and windows read them
    kinds = segments.select(*SERIES, "segment_id", "phase", "regime", "min_trades")
    asked = settings.select(*group).distinct().join(kinds, list(SERIES))
    is_phase = F.col("segment_id").isin(*PHASES)
    m = backtest.metrics(made.where(is_phase), keys, asked.where(is_phase), fused)
    wide = m.groupBy(*group).agg(*(F.max(F.when(F.col("segment_id") == s, F.struct(*backtest.METRICS))).alias(s) for s in PHASES))
    w = backtest.returns(made.where(~is_phase), keys, asked.where(~is_phase)).join(kinds.select(*SERIES, "segment_id", "phase", "regime"), [*SERIES, "segment_id"])
    stats = [*scoring.window_stats(w, group, prefix="wf_"), F.count(F.when(F.col("return_pct") > 0, 1)).alias("wf_positive_windows")]
    for prefix, test in (("selection_", F.col("phase") == "SELECTION_WINDOW"), ("validation_", F.col("phase") == "VALIDATION_WINDOW"), *((f"{r.lower()}_", F.col("regime") == r) for r in ("UP", "DOWN", "FLAT"))):
        stats += scoring.window_stats(w, group, when=test, prefix=prefix)
    ws = w.groupBy(*group).agg(*stats)
    df = wide.join(ws, group, "left").fillna(0)
    none = {"score": scoring.INVALID}
    part = lambda s, c: F.coalesce(F.col(f"{s}.{c}"), F.lit(none.get(c, 0)))

    def phase(s, prefix, least):
        return scoring.phase_score(part(s, "trades"), part(s, "total_return_pct"), part(s, "max_drawdown_pct"), part(s, "profit_factor"), F.col(f"{prefix}windows"), F.col(f"{prefix}positive_ratio"), F.col(f"{prefix}median_return_pct"), F.col(f"{prefix}worst_return_pct"), F.lit(least))

    df = df.withColumn("selection_score", phase("SELECTION", "selection_", max(6, min_trades // 2)))
    df = df.withColumn("validation_score", F.when(F.col("validation_windows") >= 2, phase("VALIDATION", "validation_", 1)).otherwise(F.col("selection_score")))
    seen = F.col("validation_windows") > 0
    either = lambda c: F.when(seen, F.col(f"validation_{c}")).otherwise(F.col(f"selection_{c}"))
    df = df.withColumn("robust_score", scoring.research_score(F.col("selection_score"), F.col("validation_score"), F.col("selection_positive_ratio"), either("positive_ratio"), F.col("selection_median_return_pct"), either("median_return_pct")))
    flat = [part(s, c).cast("long" if c in backtest._COUNTS else "double").alias(f"{p}_{c}") for s, p in (("RESEARCH", "train"), ("HOLDOUT", "test")) for c in backtest.METRICS]
    kept = [c for c in df.columns if c not in PHASES and not (c.endswith("_best_return_pct") and c != "wf_best_return_pct") and not (c.endswith("_avg_return_pct") and c.split("_")[0] in ("wf", "selection", "validation")) and not (c.split("_")[0] in ("up", "down", "flat") and c.split("_")[1] in ("median", "worst"))]
    return df.select(*kept, *flat)


def evaluate_v1(runs: DataFrame, settings: DataFrame, keys: list[str], segments: DataFrame, candles: DataFrame, fee: float, slippage: float, min_trades: int) -> DataFrame:
    """The version-1 evaluation of adaptive settings: the fused metrics of research and hold-out, and the robust score that
    weighs the balance over regimes."""
    df = evaluate(runs, settings, keys, segments, candles, fee, slippage, min_trades, fused=True).drop("selection_score", "validation_score")
    base = scoring.phase_score(F.col("train_trades"), F.col("train_total_return_pct"), F.col("train_max_drawdown_pct"), F.col("train_profit_factor"), F.col("wf_windows"), F.col("wf_positive_ratio"), F.col("wf_median_return_pct"), F.col("wf_worst_return_pct"), F.lit(min_trades), 350.0, 0.15, 0.30, 1.80, 4)
    return df.withColumn("robust_score", scoring.robust_v1(base, [(F.col(f"{r}_windows"), F.col(f"{r}_positive_ratio")) for r in ("up", "down", "flat")]))
