"""Runs to trades to metrics, for all settings and segments in one query.

A setting is the columns named in keys (e.g. atr_period, mult_e4, mode) of a series (symbol, tf). A signal seen on bar i
trades at the open of bar i + 1; a run that reaches its segment's end leaves at the close of the segment's last bar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.sources.candles import month_code

from .indicators import SERIES, overlapping

INVALID = -1e9
METRICS = ("trades", "wins", "losses", "win_rate", "total_return_pct", "profit_factor", "max_drawdown_pct", "avg_trade_pct", "median_trade_pct", "best_trade_pct", "worst_trade_pct", "long_return_pct", "short_return_pct", "long_trades", "short_trades", "profitable_months", "months", "profitable_month_ratio", "score")
_COUNTS = {"trades", "wins", "losses", "long_trades", "short_trades", "profitable_months", "months"}


def with_mode(runs: DataFrame, grid: DataFrame) -> DataFrame:
    """Runs of every grid row: LONG keeps side +1, SHORT side -1, BOTH all. Runs are maximal, so a masked one is flat."""
    df = runs.join(grid.select(*SERIES, "atr_period", "mult_e4", "mode").distinct(), [*SERIES, "atr_period", "mult_e4"])
    return df.where((F.col("mode") == "BOTH") | ((F.col("mode") == "LONG") & (F.col("side") == 1)) | ((F.col("mode") == "SHORT") & (F.col("side") == -1)))


def bounded(segments: DataFrame, candles: DataFrame) -> DataFrame:
    """Segments with their bounds clamped to the series: start at least 0, end at most the last bar."""
    last = candles.groupBy(*SERIES).agg(F.max("idx").alias("_last"))
    return segments.join(last, list(SERIES)).withColumns({"start_idx": F.greatest("start_idx", F.lit(0)), "end_idx": F.least("end_idx", "_last")}).drop("_last")


def trades(runs: DataFrame, segments: DataFrame, candles: DataFrame, keys: list[str], fee: float, slippage: float, raise_to: str | None = None, least_bars: int = 3) -> DataFrame:
    """One row a trade. segments: symbol, tf, segment_id, start_idx, end_idx, and where raise_to is given raised (whether
    the start is at least that column of the run); segments of fewer than least_bars bars have no trades."""
    segs = bounded(segments, candles).select(*SERIES, "segment_id", "start_idx", "end_idx", *(["raised"] if raise_to else []))
    segs = segs.withColumn("_last_signal", F.col("end_idx") - 1).where("_last_signal >= start_idx")
    df = overlapping(runs, segs, list(SERIES), ("first_idx", "last_idx"), ("start_idx", "_last_signal")).drop("_last_signal")
    if raise_to:
        df = df.withColumn("start_idx", F.when(F.col("raised"), F.greatest("start_idx", F.col(raise_to))).otherwise(F.col("start_idx")))
    df = df.where((F.col("end_idx") - F.col("start_idx") >= least_bars) & (F.col("last_idx") >= F.col("start_idx")))
    df = df.withColumns({"f": F.greatest("first_idx", "start_idx"), "l": F.least("last_idx", F.col("end_idx") - 1)})
    ended = F.col("l") < F.col("end_idx") - 1
    df = df.withColumns({"entry_idx": F.col("f") + 1, "exit_idx": F.when(ended, F.col("l") + 2).otherwise(F.col("end_idx")), "at_open": ended})
    entry = candles.select(*SERIES, F.col("idx").alias("entry_idx"), F.col("open").alias("entry_open"), F.col("timestamp").alias("entry_ts"))
    leave = candles.select(*SERIES, F.col("idx").alias("exit_idx"), F.col("open").alias("exit_open"), F.col("close").alias("exit_close"), F.col("timestamp").alias("exit_ts"))
    df = df.join(entry, [*SERIES, "entry_idx"]).join(leave, [*SERIES, "exit_idx"])
    return priced(df, fee, slippage).select(*SERIES, *keys, "segment_id", "side", "entry_idx", "exit_idx", "entry_ts", "exit_ts", "entry_price", "exit_price", "gross", "net", month_code(F.col("exit_ts")).alias("month"))


def priced(df: DataFrame, fee: float, slippage: float) -> DataFrame:
    """entry_price and exit_price after slippage, gross and net returns (net is floored at -0.999999)."""
    up, down = F.lit(1.0) + F.lit(slippage), F.lit(1.0) - F.lit(slippage)
    raw = F.when(F.col("at_open"), F.col("exit_open")).otherwise(F.col("exit_close"))
    long = F.col("side") == 1
    df = df.withColumns({"entry_price": F.col("entry_open") * F.when(long, up).otherwise(down), "exit_price": raw * F.when(long, down).otherwise(up)})
    gain = F.col("exit_price") - F.col("entry_price")
    df = df.withColumn("gross", F.when(long, gain).otherwise(-gain) / F.col("entry_price"))
    return df.withColumn("net", F.greatest(F.col("gross") - F.lit(2.0) * F.lit(fee), F.lit(-0.999999)))


def equity(trade_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Trades with number, equity after them, peak (1 at least) and drawdown."""
    order = Window.partitionBy(*SERIES, *keys, "segment_id").orderBy("entry_idx")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    df = trade_rows.withColumns({"trade_no": F.row_number().over(order), "equity": F.product(F.lit(1.0) + F.col("net")).over(run)})
    df = df.withColumn("peak", F.greatest(F.max("equity").over(run), F.lit(1.0)))
    return df.withColumn("drawdown", F.col("equity") / F.col("peak") - 1.0)


def metrics(trade_rows: DataFrame, keys: list[str], wanted: DataFrame | None = None, fused: bool = False) -> DataFrame:
    """The METRICS of every (series, setting, segment_id). wanted: rows that must be in the result even without trades, with
    their min_trades (else 1). fused: the short form without median, months and their factor in the score."""
    group = [*SERIES, *keys, "segment_id"]
    grown = lambda c: (F.product(F.when(c, F.lit(1.0) + F.col("net")).otherwise(1.0)) - 1.0) * 100.0
    win, long = F.col("net") > 0, F.col("side") == 1
    count = lambda c: F.count(F.when(c, 1))
    df = equity(trade_rows, keys).groupBy(*group).agg(
        F.count("*").alias("trades"), count(win).alias("wins"), count(~win).alias("losses"), (F.max_by("equity", "trade_no") - 1.0).alias("_ret"),
        F.sum(F.when(win, F.col("net")).otherwise(0.0)).alias("_gp"), F.abs(F.sum(F.when(win, 0.0).otherwise(F.col("net")))).alias("_gl"), F.abs(F.min("drawdown") * 100.0).alias("max_drawdown_pct"),
        (F.avg("net") * 100.0).alias("avg_trade_pct"), (F.median("net") * 100.0).alias("median_trade_pct"), (F.max("net") * 100.0).alias("best_trade_pct"), (F.min("net") * 100.0).alias("worst_trade_pct"),
        grown(long).alias("long_return_pct"), grown(~long).alias("short_return_pct"), count(long).alias("long_trades"), count(~long).alias("short_trades"),
    )
    by_month = trade_rows.groupBy(*group, "month").agg((F.product(F.lit(1.0) + F.col("net")) - 1.0).alias("m"))
    df = df.join(by_month.groupBy(*group).agg(F.count("*").alias("months"), count(F.col("m") > 0).alias("profitable_months")), group)
    df = df.withColumns({"win_rate": F.col("wins") / F.col("trades") * 100.0, "total_return_pct": F.col("_ret") * 100.0, "profit_factor": F.when(F.col("_gl") > 1e-12, F.col("_gp") / F.col("_gl")).otherwise(F.when(F.col("_gp") > 0, 99.0).otherwise(0.0)), "profitable_month_ratio": F.col("profitable_months") / F.col("months")})
    if fused:
        df = df.withColumns({"median_trade_pct": F.lit(0.0), "months": F.lit(0).cast("long"), "profitable_months": F.lit(0).cast("long"), "profitable_month_ratio": F.lit(0.0)})
    df = df.drop("_ret", "_gp", "_gl")
    if wanted is not None:
        df = wanted.select(*group, "min_trades").join(df, group, "left")
        df = df.fillna(0, [c for c in METRICS if c != "score"])
    else:
        df = df.withColumn("min_trades", F.lit(1))
    return df.withColumn("score", score(fused)).select(*group, *(F.col(c).cast("long") if c in _COUNTS else F.col(c) for c in METRICS))


def score(fused: bool = False) -> Column:
    """Return over drawdown, times a capped profit factor, a sample factor and (not fused) month stability."""
    value = F.col("total_return_pct") / F.greatest("max_drawdown_pct", F.lit(1.0)) * F.greatest(F.least("profit_factor", F.lit(3.0)), F.lit(0.0)) * F.sqrt(F.least("trades", F.lit(250)) / 250.0)
    if not fused:
        value = value * (F.lit(0.45) + F.lit(0.55) * F.col("profitable_month_ratio"))
    return F.when((F.col("trades") >= F.greatest("min_trades", F.lit(1))) & (F.col("total_return_pct") > -99.9), value).otherwise(INVALID)


def returns(trade_rows: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """Only total_return_pct of every wanted (series, setting, segment_id): 0 without trades."""
    group = [*SERIES, *keys, "segment_id"]
    df = trade_rows.groupBy(*group).agg(((F.product(F.lit(1.0) + F.col("net")) - 1.0) * 100.0).alias("return_pct"))
    return wanted.select(*group).join(df, group, "left").fillna(0.0, ["return_pct"])
