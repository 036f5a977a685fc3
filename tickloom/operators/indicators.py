"""Indicator operators. Recurrences run in one task a series and period (cogrouped with the grid that asks for them) and
leave as run-length rows; everything that a lag can express stays in the JVM."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import kernels as K

SERIES = ("symbol", "tf")


_PANDAS = {"string": object, "int": np.int32, "long": np.int64, "double": np.float64}


def _no_rows(schema: str) -> pd.DataFrame:
    return pd.DataFrame({name: pd.Series([], dtype=_PANDAS[kind]) for name, kind in (c.split() for c in schema.split(", "))})


def _by_time():
    return Window.partitionBy(*SERIES).orderBy("idx")


def _prices(pdf: pd.DataFrame):
    pdf = pdf.sort_values("idx")
    return pdf, *(pdf[c].to_numpy(np.float64) for c in ("high", "low", "close"))


def _per_series(candles: DataFrame, column: str, kind: str, kernel) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, high, low, close = _prices(pdf)
        return pd.DataFrame({"symbol": pdf["symbol"], "tf": pdf["tf"], "idx": pdf["idx"], column: kernel(high, low, close)})

    return candles.select(*SERIES, "idx", "high", "low", "close").groupBy(*SERIES).applyInPandas(run, f"symbol string, tf int, idx long, {column} {kind}")


def true_range(candles: DataFrame) -> DataFrame:
    before = F.lag("close").over(_by_time())
    value = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    return candles.select(*SERIES, "idx", value.alias("tr"))


def directional_movement(candles: DataFrame) -> DataFrame:
    up, down = F.col("high") - F.lag("high").over(_by_time()), F.lag("low").over(_by_time()) - F.col("low")
    df = candles.select(*SERIES, "idx", up.alias("up"), down.alias("down"))
    move = lambda a, b: F.when((F.col(a) > F.col(b)) & (F.col(a) > 0), F.col(a)).otherwise(0.0)
    return df.select(*SERIES, "idx", move("up", "down").alias("plus_dm"), move("down", "up").alias("minus_dm"))


def atr(candles: DataFrame, period: int) -> DataFrame:
    """NaN before it is defined becomes null."""
    df = _per_series(candles, "atr", "double", lambda h, low, c: K.wilder_atr(h, low, c, period))
    return df.withColumn("atr", F.when(~F.isnan("atr"), F.col("atr")))


def ema(candles: DataFrame, period: int) -> DataFrame:
    return _per_series(candles, "ema", "double", lambda h, low, c: K.ema(c, period))


def adx(candles: DataFrame, period: int) -> DataFrame:
    return _per_series(candles, "adx", "double", lambda h, low, c: K.adx(h, low, c, period))


def band_line(candles: DataFrame, period: int, multiplier: float) -> DataFrame:
    """trend and line of one setting, a row a bar; line is null where trend is 0."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, high, low, close = _prices(pdf)
        trend, line = K.band_trend(high, low, close, K.wilder_atr(high, low, close, period), np.array([multiplier]), lines=True)
        return pd.DataFrame({"symbol": pdf["symbol"], "tf": pdf["tf"], "idx": pdf["idx"], "trend": trend[:, 0].astype(np.int32), "line": line[:, 0]})

    df = candles.select(*SERIES, "idx", "high", "low", "close").groupBy(*SERIES).applyInPandas(run, "symbol string, tf int, idx long, trend int, line double")
    return df.withColumn("line", F.when(~F.isnan("line"), F.col("line")))


def regime_v1(candles: DataFrame, hours: int, threshold_pct: float) -> DataFrame:
    """+1, -1 or 0 by the return over max(2, rint(hours * 60 / tf)) bars."""
    bars = F.greatest(F.rint(F.lit(hours * 60.0) / F.col("tf")).cast("int"), F.lit(2))
    sized = candles.withColumn("bars", bars)
    past = sized.select(*SERIES, (F.col("idx") + F.col("bars")).alias("idx"), F.col("close").alias("past"))
    change = F.when(F.col("past") > 0, (F.col("close") / F.col("past") - 1.0) * 100.0).otherwise(0.0)
    df = sized.join(past, [*SERIES, "idx"], "left").withColumn("change", F.when(F.col("past").isNotNull(), change))
    return df.select(*SERIES, "idx", F.when(F.col("change") >= threshold_pct, 1).when(F.col("change") <= -threshold_pct, -1).otherwise(0).alias("regime"))


def regime_v2(candles: DataFrame, params: dict) -> DataFrame:
    return _per_series(candles, "regime", "int", lambda h, low, c: K.regime_v2(h, low, c, params).astype(np.int32))


def runs_of(series: DataFrame, column: str) -> DataFrame:
    """Run-length rows of a signal column: maximal runs whose side is not 0 (gaps and islands)."""
    change = F.when(F.lag(column).over(_by_time()) == F.col(column), 0).otherwise(1)
    df = series.withColumn("_change", change).withColumn("_run", F.sum("_change").over(_by_time()))
    return df.groupBy(*SERIES, "_run").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.first(column).cast("int").alias("side")).where("side <> 0").drop("_run")


_RUNS = "symbol string, tf int, atr_period int, mult_e4 long, first_idx long, last_idx long, side int"


def trend_runs(candles: DataFrame, grid: DataFrame) -> DataFrame:
    """Band-trend runs of every distinct (symbol, tf, atr_period, mult_e4) of grid.

    A task has one series and period: ATR once, all multipliers as one vector. Bars are sent once a period.
    """
    wanted = grid.select(*SERIES, "atr_period", "mult_e4").distinct()
    bars = candles.select(*SERIES, "idx", "high", "low", "close").join(wanted.select(*SERIES, "atr_period").distinct(), list(SERIES))

    def run(bars: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(bars) or not len(asked):
            return _no_rows(_RUNS)
        bars, high, low, close = _prices(bars)
        period, mults = int(asked["atr_period"].iloc[0]), np.sort(asked["mult_e4"].to_numpy())
        trend = K.band_trend(high, low, close, K.wilder_atr(high, low, close, period), mults / 10000.0)
        found = [K.run_lengths(trend[:, k]) for k in range(len(mults))]
        sizes = [len(f[0]) for f in found]
        at = bars["idx"].to_numpy()
        first, last, side = (np.concatenate([f[j] for f in found]) for j in range(3))
        return pd.DataFrame({"symbol": bars["symbol"].iloc[0], "tf": bars["tf"].iloc[0], "atr_period": period, "mult_e4": np.repeat(mults, sizes), "first_idx": at[first.astype(np.int64)], "last_idx": at[last.astype(np.int64)], "side": side.astype(np.int32)})

    keys = [*SERIES, "atr_period"]
    wanted = wanted.toDF(*wanted.columns)  # columns of its own: bars come from the same tables
    return bars.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInPandas(run, _RUNS)


REGIME = ("ema_fast", "ema_slow", "adx_period", "adx_threshold", "separation_atr", "confirm_bars", "min_hold_bars")
_REGIME_RUNS = "symbol string, tf int, regime_id long, first_idx long, last_idx long, side int"


def regime_runs(candles: DataFrame, configs: DataFrame, groups: int = 64) -> DataFrame:
    """Confirmed-regime runs of configs (regime_id and REGIME columns) for every series; configs are dealt over groups tasks a
    series, each of which keeps the averages that its configs share."""
    asked = configs.withColumn("deal", F.pmod("regime_id", F.lit(groups)).cast("int"))
    series = candles.select(*SERIES).distinct()
    asked = asked.crossJoin(F.broadcast(series))
    bars = candles.select(*SERIES, "idx", "high", "low", "close").join(asked.select(*SERIES, "deal").distinct(), list(SERIES))

    def run(bars: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(bars) and len(asked):
            bars, high, low, close = _prices(bars)
            at, seen = bars["idx"].to_numpy(), {}

            def kept(key, make):
                if key not in seen:
                    seen[key] = make()
                return seen[key]

            for p in asked.sort_values("regime_id").to_dict("records"):
                period, confirm = max(2, int(p["adx_period"])), max(1, int(p["confirm_bars"]))
                strength = kept(("adx", period), lambda: K.adx(high, low, close, period))  # noqa: B023
                reach = kept(("atr", period), lambda: np.nan_to_num(K.wilder_atr(high, low, close, period)))  # noqa: B023
                fast, slow = (kept(("ema", int(p[c])), lambda c=c: K.ema(close, int(p[c]))) for c in ("ema_fast", "ema_slow"))  # noqa: B023
                regime = K.confirmed_regime(K.raw_regime(fast, slow, strength, reach, p["adx_threshold"], p["separation_atr"], confirm), confirm, p["min_hold_bars"])
                first, last, side = K.run_lengths(regime)
                out.append(pd.DataFrame({"symbol": bars["symbol"].iloc[0], "tf": bars["tf"].iloc[0], "regime_id": int(p["regime_id"]), "first_idx": at[first], "last_idx": at[last], "side": side.astype(np.int32)}))
        return pd.concat(out) if out else _no_rows(_REGIME_RUNS)

    keys = [*SERIES, "deal"]
    asked = asked.toDF(*asked.columns)
    return bars.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(run, _REGIME_RUNS)


#: Bars a bin: runs and segments meet in the bins that they cover, by equality.
BIN = 64


def binned(df: DataFrame, first: str, last: str) -> DataFrame:
    """A row for each bin that first to last covers, as _bin."""
    place = lambda c: F.floor(F.col(c) / BIN).cast("long")
    return df.withColumn("_bin", F.explode(F.sequence(place(first), place(last))))


def overlapping(a: DataFrame, b: DataFrame, on: list[str], a_range: tuple[str, str], b_range: tuple[str, str]) -> DataFrame:
    """Rows of a and b with equal on whose inclusive index ranges overlap, each pair once: in the bin where the overlap starts.
    No join by range, and a long series is spread over its bins. Ranges must not be empty."""
    met = binned(a, *a_range).join(binned(b, *b_range), [*on, "_bin"])
    start, end = F.greatest(a_range[0], b_range[0]), F.least(a_range[1], b_range[1])
    return met.where((start <= end) & (F.floor(start / BIN) == F.col("_bin"))).drop("_bin")


def meet_runs(runs: DataFrame, regimes: DataFrame, side: int, keys: list[str]) -> DataFrame:
    """The parts of the runs of one side that lie in regime runs of that side."""
    b = regimes.where(F.col("side") == side).withColumnsRenamed({"first_idx": "_f", "last_idx": "_l"}).drop("side")
    cut = overlapping(runs.where(F.col("side") == side), b, [*SERIES, *keys], ("first_idx", "last_idx"), ("_f", "_l"))
    return cut.withColumns({"first_idx": F.greatest("first_idx", "_f"), "last_idx": F.least("last_idx", "_l")}).drop("_f", "_l")


def combine_runs(long_runs: DataFrame, short_runs: DataFrame, regimes: DataFrame, keys: list[str]) -> DataFrame:
    """The adaptive signal as runs: long-trend runs where the regime is +1 and short-trend runs where it is -1. Inputs are
    maximal runs, so no two pieces of one side touch. keys are columns common to all three besides the series."""
    return meet_runs(long_runs, regimes, 1, keys).unionByName(meet_runs(short_runs, regimes, -1, keys), allowMissingColumns=True)
