"""The reference operators' queries and their SQL.

Most run over daily candles of a walk over orders. Doubles that come from sums or products are rounded to six places on
both sides (floor(x * 1e6 + 0.5) / 1e6).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.operators import audit, backtest, evaluate, grid, indicators, reports, scoring, select, walkforward
from tickloom.sources import candles as C
from tickloom.sources import store
from tickloom.sources.written import stash

from . import oracle as O
from .oracle import FEE, MIN_TRADES, SLIP, query

KEYS = ["atr_period", "mult_e4", "mode"]
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def register(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*((F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily candles, written once: a query's branches all read them."""
    return stash(C.orders_daily(spark, sf_dir), "candles")


def planned(bars: DataFrame) -> DataFrame:
    """The segments of the walk-forward plan, written once."""
    return stash(walkforward.segments(bars, MIN_TRADES), "segments")


def _grid(spark: SparkSession, candles: DataFrame, periods, mults, modes=("BOTH",)) -> DataFrame:
    return grid.product(spark, periods, mults, modes).crossJoin(F.broadcast(candles.select("symbol", "tf").distinct()))


def _one(spark: SparkSession, sf_dir: str, mode: str = "BOTH"):
    bars = daily(spark, sf_dir)
    g = _grid(spark, bars, [14], [25000], [mode])
    runs = backtest.with_mode(indicators.trend_runs(bars, g), g)
    return bars, runs


def _trades(spark: SparkSession, sf_dir: str, mode: str = "BOTH") -> DataFrame:
    bars, runs = _one(spark, sf_dir, mode)
    return backtest.trades(runs, walkforward.whole_range(bars), bars, KEYS, FEE, SLIP)


def swept(spark: SparkSession, sf_dir: str, periods=O.PERIODS, mults=O.MULTS) -> DataFrame:
    """A sweep in the flat result form; the small one, unless told otherwise, is what the report queries share."""
    bars = daily(spark, sf_dir)
    g = stash(_grid(spark, bars, periods, mults, O.MODES), "grid")
    runs = stash(backtest.with_mode(indicators.trend_runs(bars, g), g), "runs")
    df = evaluate.evaluate(runs, g, KEYS, planned(bars), bars, FEE, SLIP, MIN_TRADES, "atr_period")
    return stash(df.withColumns({"strategy_type": F.lit("BASE"), "stage": F.lit("coarse")}), "swept")


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The small sweep, near copies of its rows (one period and 0.1 on, scores a little lower), and a second series in which
    selection and validation have changed places: what selection and reports have to tell apart."""
    df = swept(spark, sf_dir)
    near = df.withColumns({"atr_period": F.col("atr_period") + 1, "mult_e4": F.col("mult_e4") + 1000, **{c: F.col(c) - 0.125 for c in select.SCORES}})
    other = df.withColumns({"symbol": F.lit("OTHER"), "tf": F.lit(2880), "selection_score": F.col("validation_score"), "validation_score": F.col("selection_score")})
    return stash(df.unionByName(near).unionByName(other), "pool")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of one setting over the whole range, in its three modes."""
    bars = daily(spark, sf_dir)
    g = _grid(spark, bars, [14], [25000], O.MODES)
    runs = backtest.with_mode(indicators.trend_runs(bars, g), g)
    return backtest.metrics(backtest.trades(runs, walkforward.whole_range(bars), bars, KEYS, FEE, SLIP), KEYS)


# --- candles ---


@register(query(O.ORDERS, "SELECT * FROM bars"))
def candles_daily_orders(spark, d):
    return C.orders_daily(spark, d)


@register(query(O.EVENTS, "SELECT * FROM bars"))
def candles_hourly_events(spark, d):
    return C.events_hourly(spark, d)


@register(query(O.ORDERS, """SELECT symbol, tf, count(*) AS n_rows, min(timestamp) AS first_ts, max(timestamp) AS last_ts, count(*) - count(DISTINCT timestamp) AS duplicate_timestamps, count(*) FILTER (step <= 0) AS non_monotonic_steps, count(*) FILTER (step > 86400000) AS gap_events,
  coalesce(sum(greatest(step // 86400000 - 1, 0)) FILTER (step > 86400000), 0)::BIGINT AS missing_candles, count(*) FILTER (high < greatest(open, close, low) OR low > least(open, close, high)) AS invalid_ohlc_rows, count(*) FILTER (least(open, high, low, close) <= 0) AS nonpositive_rows
FROM (SELECT *, timestamp - lag(timestamp) OVER (ORDER BY idx) AS step FROM bars) GROUP BY symbol, tf"""))
def candle_quality(spark, d):
    return C.quality(C.orders_daily(spark, d))


@register(query(O.ORDERS, "SELECT symbol, tf, idx, timestamp, gap_ms, greatest(gap_ms // 86400000 - 1, 0)::BIGINT AS missing FROM (SELECT *, timestamp - lag(timestamp) OVER (ORDER BY idx) AS gap_ms FROM bars) WHERE gap_ms > 86400000"))
def candle_gaps(spark, d):
    return C.gaps(C.orders_daily(spark, d))


@register(query(f"""{O.ORDERS}, raw AS (SELECT timestamp::VARCHAR AS t, open::VARCHAR AS o, high::VARCHAR AS h, low::VARCHAR AS l, close::VARCHAR AS c, volume::VARCHAR AS v, -idx AS arrival FROM bars
  UNION ALL SELECT timestamp::VARCHAR, open::VARCHAR, high::VARCHAR, low::VARCHAR, '1.0', volume::VARCHAR, 1000000 - idx FROM bars UNION ALL SELECT (7 + 3 * idx)::VARCHAR, 'n/a', high::VARCHAR, low::VARCHAR, close::VARCHAR, volume::VARCHAR, -idx FROM bars WHERE idx < 20
  UNION ALL SELECT (timestamp + 1)::VARCHAR, open::VARCHAR, high::VARCHAR, low::VARCHAR, close::VARCHAR, NULL, -idx FROM bars WHERE idx % 7 = 0),
typed AS (SELECT try_cast(t AS BIGINT) AS timestamp, try_cast(o AS DOUBLE) AS open, try_cast(h AS DOUBLE) AS high, try_cast(l AS DOUBLE) AS low, try_cast(c AS DOUBLE) AS close, coalesce(try_cast(v AS DOUBLE), 0) AS volume, arrival FROM raw),
once AS (SELECT * FROM typed WHERE timestamp IS NOT NULL AND open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL QUALIFY row_number() OVER (PARTITION BY timestamp ORDER BY arrival) = 1)""",
    "SELECT 'ORDERS' AS symbol, 1440 AS tf, (row_number() OVER (ORDER BY timestamp) - 1)::BIGINT AS idx, timestamp, open, high, low, close, volume, 0.0::DOUBLE AS turnover FROM once"))
def candles_cleaned(spark, d):
    """The cleaning of text candles that come in reverse, twice (the later row loses), with bad rows, without volume here and there, and without turnover."""
    bars = daily(spark, d)
    text = bars.select(*(F.col(c).cast("string").alias(c) for c in ("timestamp", "open", "high", "low", "close", "volume")), (-F.col("idx")).alias("arrival"))
    late = text.withColumns({"close": F.lit("1.0"), "arrival": F.col("arrival") + 1_000_000})
    bad = text.where("arrival > -20").withColumns({"open": F.lit("n/a"), "timestamp": (F.lit(7) - F.col("arrival") * 3).cast("string")})
    bare = text.where("arrival % 7 = 0").withColumns({"timestamp": (F.col("timestamp").cast("long") + 1).cast("string"), "volume": F.lit(None).cast("string")})
    return C.clean(text.unionByName(late).unionByName(bad).unionByName(bare), "arrival", "ORDERS", 1440)


@register(query(f"{O.ORDERS}, files(path, modified, gap) AS (VALUES ('a', 1, 0), ('b', 3, 400), ('c', 2, 0), ('d', 4, 2000))", "SELECT path, modified FROM files, (SELECT count(*) AS n FROM bars) WHERE gap < n * 0.01 ORDER BY modified DESC LIMIT 1"))
def cache_lookup(spark, d):
    bars = C.orders_daily(spark, d).agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b"), F.count("*").alias("n"))
    files = spark.sql("SELECT * FROM VALUES ('a', 1, 0), ('b', 3, 400), ('c', 2, 0), ('d', 4, 2000) AS t(path, modified, gap)")
    a, b, _ = bars.first()
    catalog = files.select("path", "modified", F.lit("ORDERS").alias("symbol"), F.lit(1440).alias("tf"), (F.lit(a) + F.col("gap").cast("long") * F.lit(C.DAY_MS)).alias("first_ts"), F.lit(b).alias("last_ts"))
    return C.find_reusable(catalog, "ORDERS", 1440, a, b).select("path", "modified")


# --- indicators ---


@register(query(f"{O.ORDERS}, {O.TR}", "SELECT 'ORDERS' AS symbol, 1440 AS tf, idx, tr FROM tr"))
def true_range(spark, d):
    return indicators.true_range(C.orders_daily(spark, d))


@register(query(f"{O.ORDERS}, {O.TR}", "SELECT 'ORDERS' AS symbol, 1440 AS tf, idx, CASE WHEN h - ph > pl - l AND h - ph > 0 THEN h - ph ELSE 0 END AS plus_dm, CASE WHEN pl - l > h - ph AND pl - l > 0 THEN pl - l ELSE 0 END AS minus_dm FROM tr"))
def directional_movement(spark, d):
    return indicators.directional_movement(C.orders_daily(spark, d))


@register(query(f"{O.ORDERS}, {O.TR}, {O.trend(O.ONE)}", "SELECT 'ORDERS' AS symbol, 1440 AS tf, i AS idx, atr FROM st"))
def atr_wilder(spark, d):
    return indicators.atr(C.orders_daily(spark, d), 14)


@register(query(f"{O.ORDERS}, {O.TR}, {O.ema(21, 'ef')}", "SELECT 'ORDERS' AS symbol, 1440 AS tf, i AS idx, v AS ema FROM ef"))
def ema_series(spark, d):
    return indicators.ema(C.orders_daily(spark, d), 21)


@register(query(f"{O.ORDERS}, {O.TR}, {O.adx(14)}", f"SELECT 'ORDERS' AS symbol, 1440 AS tf, i AS idx, {O.r('v', 'adx')} FROM ax"))
def adx_series(spark, d):
    return rounded(indicators.adx(C.orders_daily(spark, d), 14))


@register(query(f"{O.ORDERS}, {O.TR}, {O.trend(O.ONE)}", "SELECT 'ORDERS' AS symbol, 1440 AS tf, i AS idx, t AS trend FROM st"))
def supertrend_trend(spark, d):
    return indicators.band_line(C.orders_daily(spark, d), 14, 2.5).drop("line")


@register(query(f"{O.ORDERS}, {O.TR}, {O.trend(O.ONE)}", "SELECT 'ORDERS' AS symbol, 1440 AS tf, i AS idx, t AS trend, CASE WHEN t > 0 THEN lo WHEN t < 0 THEN u END AS line FROM st"))
def supertrend_line(spark, d):
    return indicators.band_line(C.orders_daily(spark, d), 14, 2.5)


_V1 = "v1 AS (SELECT idx, CASE WHEN past > 0 THEN (close / past - 1.0::DOUBLE) * 100.0::DOUBLE WHEN past IS NULL THEN NULL ELSE 0 END AS ch FROM (SELECT idx, close, lag(close, 10) OVER (ORDER BY idx) AS past FROM bars)), regime AS (SELECT idx, CASE WHEN ch >= 1.0 THEN 1 WHEN ch <= -1.0 THEN -1 ELSE 0 END AS regime FROM v1)"


@register(query(f"{O.ORDERS}, {_V1}", "SELECT 'ORDERS' AS symbol, 1440 AS tf, idx, regime FROM regime"))
def regime_v1(spark, d):
    return indicators.regime_v1(C.orders_daily(spark, d), 240, 1.0)


@register(query(f"{O.ORDERS}, {O.TR}, {O.regime_v2()}", "SELECT 'ORDERS' AS symbol, 1440 AS tf, idx, regime FROM regime"))
def regime_v2(spark, d):
    return indicators.regime_v2(C.orders_daily(spark, d), O.REGIME)


_PARTS = "parts AS (SELECT 'SELECTION' AS part, research_start AS a, greatest(research_start, validation_start - 1) AS b FROM plan UNION ALL SELECT 'VALIDATION', validation_start, greatest(validation_start, holdout_start - 1) FROM plan UNION ALL SELECT 'HOLDOUT', holdout_start, n - 1 FROM plan)"


@register(query(f"{O.ORDERS}, {O.TR}, {O.regime_v2()}, {O.PLAN}, {_PARTS}", f"SELECT 'ORDERS' AS symbol, 1440 AS tf, part, {O.r('avg(CASE WHEN regime = 1 THEN 1.0::DOUBLE ELSE 0 END)', 'up_ratio')}, {O.r('avg(CASE WHEN regime = -1 THEN 1.0::DOUBLE ELSE 0 END)', 'down_ratio')}, {O.r('avg(CASE WHEN regime = 0 THEN 1.0::DOUBLE ELSE 0 END)', 'flat_ratio')}, coalesce(sum(c), 0)::BIGINT AS switches FROM (SELECT *, CASE WHEN regime <> lag(regime) OVER (PARTITION BY part ORDER BY idx) THEN 1 ELSE 0 END AS c FROM regime JOIN parts ON idx BETWEEN a AND b) GROUP BY part"))
def regime_mix(spark, d):
    bars = daily(spark, d)
    return rounded(reports.regime_mix(indicators.regime_v2(bars, O.REGIME), walkforward.plan(bars)))


@register(query(f"{O.ORDERS}, {O.TR}, {O.regime_v2()}", "SELECT 'ORDERS' AS symbol, 1440 AS tf, idx, timestamp, close, CASE regime WHEN 1 THEN 'UP' WHEN -1 THEN 'DOWN' ELSE 'FLAT' END AS state FROM bars JOIN regime USING (idx), size WHERE idx % greatest(1, n // 400) = 0"))
def regime_samples(spark, d):
    bars = daily(spark, d)
    return reports.regime_samples(bars, indicators.regime_v2(bars, O.REGIME))


# --- runs, trades, metrics ---

_SIG = "sig AS (SELECT p AS atr_period, m AS mult_e4, i, t FROM st)"
_RUNS = f"{O.ORDERS}, {O.TR}, {O.trend(O.ONE)}, {_SIG}, {O.runs('sig', 'atr_period, mult_e4', 't', 'i')}"


@register(query(_RUNS, "SELECT 'ORDERS' AS symbol, 1440 AS tf, atr_period, mult_e4::BIGINT AS mult_e4, first_idx, last_idx, side FROM runs"))
def signal_runs(spark, d):
    bars = daily(spark, d)
    return indicators.trend_runs(bars, _grid(spark, bars, [14], [25000]))


@register(query(_RUNS, "SELECT 'ORDERS' AS symbol, 1440 AS tf, first_idx, last_idx, side FROM runs"))
def signal_runs_relational(spark, d):
    """The same runs, from a column of signals by windows (gaps and islands)."""
    return indicators.runs_of(indicators.band_line(C.orders_daily(spark, d), 14, 2.5), "trend")


def _base(modes) -> str:
    return f"{_RUNS}, {O.moded(modes)}, {O.FULL}, {O.trades(O.BASE_KEYS)}"


for _mode in O.MODES:
    register(query(_base([_mode]), "SELECT 'ORDERS' AS symbol, 1440 AS tf, atr_period, mult_e4::BIGINT AS mult_e4, mode, segment_id, side, entry_idx, exit_idx, entry_ts, exit_ts, entry_price, exit_price, gross, net, month FROM trades"), f"trades_base_{_mode.lower()}")(lambda spark, d, mode=_mode: _trades(spark, d, mode))


@register(query(f"{_base(['BOTH'])}, {O.equity(O.BASE_KEYS)}", f"SELECT trade_no, side, {O.r('equity')}, {O.r('peak')}, {O.r('equity / peak - 1', 'drawdown')} FROM eq"))
def equity_curve(spark, d):
    return rounded(backtest.equity(_trades(spark, d), KEYS).select("trade_no", "side", "equity", "peak", "drawdown"))


_ALL = ", ".join(O.r(c) if c not in O.COUNTS else c for c in O.METRICS)
_WANT = "SELECT DISTINCT atr_period, mult_e4, mode, 'FULL' AS segment_id, 1 AS min_trades FROM set_runs"


@register(query(f"{_base(O.MODES)}, {O.metrics(O.BASE_KEYS, _WANT)}", f"SELECT 'ORDERS' AS symbol, 1440 AS tf, atr_period, mult_e4::BIGINT AS mult_e4, mode, segment_id, {_ALL} FROM met"))
def metrics_full(spark, d):
    return rounded(flagship(spark, d))


@register(query(_base(["BOTH"]), f"SELECT side, count(*) AS trades, {O.r('(product(1 + net) - 1) * 100', 'return_pct')}, {O.r('avg(net) * 100', 'avg_pct')}, {O.r('median(net) * 100', 'median_pct')} FROM trades GROUP BY side"))
def metrics_by_side(spark, d):
    return rounded(_trades(spark, d).groupBy("side").agg(F.count("*").alias("trades"), ((F.product(1 + F.col("net")) - 1) * 100).alias("return_pct"), (F.avg("net") * 100).alias("avg_pct"), (F.median("net") * 100).alias("median_pct")))


@register(query(_base(["BOTH"]), f"SELECT month, count(*) AS trades, {O.r('(product(1 + net) - 1) * 100', 'return_pct')} FROM trades GROUP BY month"))
def metrics_monthly(spark, d):
    return rounded(_trades(spark, d).groupBy("month").agg(F.count("*").alias("trades"), ((F.product(1 + F.col("net")) - 1) * 100).alias("return_pct")))


# --- walk-forward ---


@register(query(f"{O.ORDERS}, {O.PLAN}", "SELECT 'ORDERS' AS symbol, 1440 AS tf, n, total_days, holdout_days, warmup_days, windows, research_start, selection_end, validation_start, holdout_start FROM plan"))
def walk_forward_plan(spark, d):
    return walkforward.plan(daily(spark, d))


@register(query(f"{O.ORDERS}, {O.PLAN}", "SELECT 'ORDERS' AS symbol, 1440 AS tf, window_no, a, b, bench_pct, regime, phase FROM wins"))
def walk_forward_windows(spark, d):
    return walkforward.windows(daily(spark, d))


@register(query(f"{O.ORDERS}, {O.PLAN}, {O.SEGS}", "SELECT 'ORDERS' AS symbol, 1440 AS tf, segment_id, phase, start_idx, end_idx, raised, min_trades, regime, bench_pct FROM segs"))
def walk_forward_segments(spark, d):
    return walkforward.segments(daily(spark, d), MIN_TRADES)


_SEGMENTED = f"{_RUNS}, {O.moded(['BOTH'])}, {O.PLAN}, {O.SEGS}, {O.trades(O.BASE_KEYS, 'atr_period')}"
_WINDOWED = f"{_SEGMENTED}, wr AS (SELECT segment_id, phase, regime, coalesce(ret, 0) AS return_pct FROM segs LEFT JOIN (SELECT segment_id, (product(1 + net) - 1) * 100 AS ret FROM trades GROUP BY segment_id) USING (segment_id) WHERE phase LIKE '%WINDOW')"


def _window_returns(spark, d):
    bars, runs = _one(spark, d)
    segs = planned(bars)
    made = backtest.trades(runs, segs, bars, KEYS, FEE, SLIP, "atr_period")
    wanted = _grid(spark, bars, [14], [25000]).join(segs.where("phase like '%WINDOW'").select("symbol", "tf", "segment_id"), ["symbol", "tf"])
    return backtest.returns(made, KEYS, wanted).join(segs.select("symbol", "tf", "segment_id", "phase", "regime"), ["symbol", "tf", "segment_id"])


@register(query(_WINDOWED, f"SELECT segment_id, phase, regime, {O.r('return_pct')} FROM wr"))
def window_returns(spark, d):
    return rounded(_window_returns(spark, d).select("segment_id", "phase", "regime", "return_pct"))


_STATS = f"count(*) AS windows, {O.r('avg(CASE WHEN return_pct > 0 THEN 1.0::DOUBLE ELSE 0 END)', 'positive_ratio')}, {O.r('median(return_pct)', 'median_return_pct')}, {O.r('min(return_pct)', 'worst_return_pct')}, {O.r('max(return_pct)', 'best_return_pct')}, {O.r('avg(return_pct)', 'avg_return_pct')}"


@register(query(_WINDOWED, f"SELECT phase, {_STATS} FROM wr GROUP BY phase"))
def window_return_stats(spark, d):
    return rounded(_window_returns(spark, d).groupBy("phase").agg(*scoring.window_stats(None, [])))


@register(query(_WINDOWED, f"SELECT regime, {_STATS} FROM wr GROUP BY regime"))
def regime_window_stats(spark, d):
    return rounded(_window_returns(spark, d).groupBy("regime").agg(*scoring.window_stats(None, [])))


_PHASES = "'RESEARCH', 'SELECTION', 'VALIDATION', 'HOLDOUT'"


@register(query(f"{_SEGMENTED}, {O.metrics(O.BASE_KEYS, f'SELECT 14 AS atr_period, 25000 AS mult_e4, {chr(39)}BOTH{chr(39)} AS mode, segment_id, min_trades FROM segs WHERE phase IN ({_PHASES})')}", f"SELECT segment_id, {_ALL} FROM met"))
def segment_metrics(spark, d):
    bars, runs = _one(spark, d)
    segs = planned(bars).where(F.col("phase").isin("RESEARCH", "SELECTION", "VALIDATION", "HOLDOUT"))
    made = backtest.trades(runs, segs, bars, KEYS, FEE, SLIP, "atr_period")
    wanted = _grid(spark, bars, [14], [25000]).join(segs.select("symbol", "tf", "segment_id", "min_trades"), ["symbol", "tf"])
    return rounded(backtest.metrics(made, KEYS, wanted).select("segment_id", *backtest.METRICS))


# --- sweep, scores, grids ---

_ID = "atr_period, mult_e4::BIGINT AS mult_e4, mode"
_SCORES = ", ".join(O.r(c) for c in ("selection_score", "validation_score", "robust_score"))


@register(query(O.SWEPT, f"SELECT {_ID}, selection_windows, validation_windows, {_SCORES} FROM swept"))
def phase_scores(spark, d):
    return rounded(swept(spark, d).select(*KEYS, "selection_windows", "validation_windows", "selection_score", "validation_score", "robust_score"))


_FLAT = ["wf_windows", "wf_positive_windows", "wf_positive_ratio", "wf_median_return_pct", "wf_worst_return_pct", "wf_best_return_pct", "selection_windows", "selection_positive_ratio", "selection_median_return_pct", "selection_worst_return_pct", "validation_windows", "validation_positive_ratio", "validation_median_return_pct", "validation_worst_return_pct",
         *(f"{g}_{c}" for g in ("up", "down", "flat") for c in ("windows", "positive_ratio", "avg_return_pct")), *(f"{p}_{c}" for p in ("train", "test") for c in O.METRICS), "selection_score", "validation_score", "robust_score"]
_INTS = {c for c in _FLAT if c.endswith("_windows") or c.partition("_")[2] in O.COUNTS}


@register(query(O.SWEPT, f"SELECT strategy_type, symbol, tf, stage, {_ID}, {', '.join(c if c in _INTS else O.r(c) for c in _FLAT)} FROM swept"))
def flat_results(spark, d):
    return rounded(swept(spark, d).select("strategy_type", "symbol", "tf", "stage", *KEYS, *_FLAT))


@register(query(O.SWEPT, f"SELECT {_ID}, {_SCORES} FROM swept ORDER BY swept.robust_score DESC, swept.validation_score DESC, swept.selection_score DESC, atr_period, mult_e4, mode LIMIT 10"))
def sweep_small_topk(spark, d):
    return rounded(reports.ranked_top(swept(spark, d), 10).select(*KEYS, "selection_score", "validation_score", "robust_score"))


def _range_sql(r: range) -> str:
    return f"range({r.start}, {r.stop}, {r.step})"


def _steps_sql(steps: list[int]) -> str:
    return "(VALUES " + ", ".join(f"({s})" for s in steps) + ")"


def _product_sql(periods: range, mults: list[int], modes) -> str:
    return f"SELECT p::INTEGER AS atr_period, m::BIGINT AS mult_e4, mode FROM {_range_sql(periods)} a(p), {_steps_sql(mults)} b(m), (VALUES {', '.join(f'({m!r})' for m in modes)}) c(mode)"


_PRESET = grid.PRESETS["standard"]
_COARSE = _product_sql(_PRESET.periods, _PRESET.mults, grid.MODES)


@register(_COARSE)
def grid_coarse(spark, d):
    return grid.coarse(spark, _PRESET)


@register(f"({' UNION '.join(_product_sql(*p) for p in _PRESET.probes)}) EXCEPT ({_COARSE})")
def grid_breadth_minus_coarse(spark, d):
    return grid.breadth(spark, _PRESET)


@register("WITH v AS (SELECT * FROM (VALUES (8, 21), (12, 26), (20, 50)) e(ema_fast, ema_slow), (VALUES (14)) a(adx_period), (VALUES (18.0::DOUBLE), (25.0::DOUBLE)) t(adx_threshold), (VALUES (0.10::DOUBLE), (0.25::DOUBLE)) s(separation_atr), (VALUES (2)) c(confirm_bars), (VALUES (3), (6)) h(min_hold_bars)) SELECT *, row_number() OVER (ORDER BY ema_fast, ema_slow, adx_period, adx_threshold, separation_atr, confirm_bars, min_hold_bars) - 1 AS regime_id FROM v")
def regime_grid(spark, d):
    return grid.regime_grid(spark, _PRESET.regimes)


@register("WITH s(p, m) AS (VALUES (10, 20000), (3, 3000)) SELECT DISTINCT a::INTEGER AS atr_period, b::BIGINT AS mult_e4, 'BOTH' AS mode FROM s, range(2, 400) x(a), range(1500, 170000, 500) y(b) WHERE a BETWEEN greatest(2, p - 4) AND p + 4 AND b BETWEEN greatest(1500, m - 4000) AND m + 4000 AND (b - greatest(1500, m - 4000)) % 500 = 0")
def grid_around_seeds(spark, d):
    seeds = spark.sql("SELECT * FROM VALUES (10, 20000L, 'BOTH'), (3, 3000L, 'BOTH') AS t(atr_period, mult_e4, mode)")
    return grid.around(seeds, _PRESET.fine)


# --- adaptive ---


def _adaptive(spark, d):
    bars = daily(spark, d)
    side = lambda p, m: indicators.trend_runs(bars, _grid(spark, bars, [p], [m])).drop("atr_period", "mult_e4")
    config = spark.range(1).select(F.lit(0).cast("long").alias("regime_id"), *(F.lit(v).alias(k) for k, v in O.REGIME.items()))
    regimes = indicators.regime_runs(bars, config).drop("regime_id")
    runs = indicators.combine_runs(side(*O.LONG), side(*O.SHORT), regimes, []).withColumn("one", F.lit(0))
    return bars, runs


@register(query(O.ADAPTIVE, "SELECT first_idx, last_idx, side FROM set_runs"))
def adaptive_signal(spark, d):
    return _adaptive(spark, d)[1].select("first_idx", "last_idx", "side")


@register(query(f"{O.ADAPTIVE}, {O.FULL}, {O.trades('one')}", "SELECT side, entry_idx, exit_idx, entry_price, exit_price, gross, net, month FROM trades"))
def adaptive_trades(spark, d):
    bars, runs = _adaptive(spark, d)
    return backtest.trades(runs, walkforward.whole_range(bars), bars, ["one"], FEE, SLIP).select("side", "entry_idx", "exit_idx", "entry_price", "exit_price", "gross", "net", "month")


_AD = f"{O.ADAPTIVE}, {O.PLAN}, {O.SEGS}, {O.trades('one')}, {O.results('one', 'SELECT 0 AS one', fused=True)}"


@register(query(_AD, f"SELECT {', '.join(c if c in _INTS else O.r(c) for c in _FLAT)} FROM res"))
def adaptive_metrics(spark, d):
    bars, runs = _adaptive(spark, d)
    settings = bars.select("symbol", "tf").distinct().withColumn("one", F.lit(0))
    return rounded(evaluate.evaluate(runs, settings, ["one"], planned(bars), bars, FEE, SLIP, MIN_TRADES, fused=True).select(*_FLAT))


@register(query(f"{_AD}, bal AS (SELECT *, list_filter([CASE WHEN up_windows > 0 THEN up_positive_ratio END, CASE WHEN down_windows > 0 THEN down_positive_ratio END, CASE WHEN flat_windows > 0 THEN flat_positive_ratio END], lambda x: x IS NOT NULL) AS rates FROM res)", f"""SELECT wf_windows, train_trades, {O.r("CASE WHEN train_trades < 24 OR wf_windows < 4 THEN -1e9 ELSE train_total_return_pct / greatest(train_max_drawdown_pct, 2) * greatest(least(train_profit_factor, 3), 0) * sqrt(least(train_trades, 350) / 350.0::DOUBLE) * (0.15 + 0.85 * wf_positive_ratio) * (1 / (1 + greatest(-wf_worst_return_pct, 0) / 10)) * greatest(least(1 + wf_median_return_pct / 10, 1.8), 0.3) * (0.55 + coalesce(0.45 * list_min(rates), 0)) END", 'robust_score')} FROM bal"""))
def adaptive_v1_score(spark, d):
    bars, runs = _adaptive(spark, d)
    settings = bars.select("symbol", "tf").distinct().withColumn("one", F.lit(0))
    return rounded(evaluate.evaluate_v1(runs, settings, ["one"], planned(bars), bars, FEE, SLIP, MIN_TRADES).select("wf_windows", "train_trades", "robust_score"))


# --- reports ---

_VALID = "robust_score > -1e8"
_SURVIVE = "train_total_return_pct > 0 AND test_total_return_pct > 0"
_STRICT = "test_profit_factor > 1 AND test_max_drawdown_pct <= 20 AND test_trades >= 5"


def _share(test: str, name: str, where: str = "true") -> str:
    return O.r(f"coalesce(avg(CASE WHEN {test} THEN 1.0::DOUBLE ELSE 0 END) FILTER ({where}), 0)", name)


def _mid(value: str, name: str, where: str = "true") -> str:
    return O.r(f"coalesce(median({value}) FILTER ({where}), 0)", name)


@register(query(O.SWEPT, f"""SELECT strategy_type, tf, count(*) AS candidates, count(*) FILTER ({_VALID}) AS valid_candidates, {_share('selection_score > 0', 'selection_positive_ratio', _VALID)}, {_share('validation_score > 0', 'validation_positive_ratio', _VALID)}, {_share('test_total_return_pct > 0', 'holdout_positive_ratio', _VALID)},
  count(*) FILTER ({_VALID} AND {_SURVIVE}) AS survivors, count(*) FILTER ({_VALID} AND {_SURVIVE} AND {_STRICT}) AS strict_survivors, {_mid('validation_median_return_pct', 'median_validation_window_pct', _VALID)}, {_mid('test_total_return_pct', 'median_holdout_pct', _VALID)}, {O.r(f'coalesce(max(test_total_return_pct) FILTER ({_VALID}), 0)', 'best_holdout_pct')} FROM swept GROUP BY strategy_type, tf"""))
def strategy_summary(spark, d):
    return rounded(reports.strategy_summary(swept(spark, d)))


@register(query(O.SWEPT, f"SELECT {_ID}, {_SCORES}, {O.r('test_total_return_pct')}, {_STRICT} AS strict_survivor FROM swept WHERE {_VALID} AND {_SURVIVE}"))
def survivors(spark, d):
    return rounded(reports.survivors(swept(spark, d)).select(*KEYS, "selection_score", "validation_score", "robust_score", "test_total_return_pct", "strict_survivor"))


@register(query(O.SWEPT, "SELECT strategy_type, tf, stage, count(*) AS candidates, min(atr_period) AS atr_min, max(atr_period) AS atr_max, count(DISTINCT atr_period) AS atr_unique, min(mult_e4)::BIGINT AS mult_min, max(mult_e4)::BIGINT AS mult_max, count(DISTINCT mult_e4) AS mult_unique, string_agg(DISTINCT mode, ',' ORDER BY mode) AS modes FROM swept GROUP BY ALL"))
def parameter_coverage(spark, d):
    return reports.parameter_coverage(swept(spark, d))


_POOL_COLUMNS = ", ".join(("strategy_type", "stage", "mode", *_FLAT))
_LESS = _POOL_COLUMNS
for _c in select.SCORES:
    _LESS = _LESS.replace(f", {_c}", f", {_c} - 0.125::DOUBLE AS {_c}")
_SWAPPED = _POOL_COLUMNS.replace("selection_score, validation_score", "validation_score AS selection_score, selection_score AS validation_score")
POOL = f"""{O.SWEPT}, pool AS MATERIALIZED (SELECT 'ORDERS' AS symbol, 1440 AS tf, atr_period::INTEGER AS atr_period, mult_e4::BIGINT AS mult_e4, {_POOL_COLUMNS} FROM swept
UNION ALL SELECT 'ORDERS', 1440, atr_period + 1, mult_e4 + 1000, {_LESS} FROM swept UNION ALL SELECT 'OTHER', 2880, atr_period, mult_e4, {_SWAPPED} FROM swept)"""
_NAMED = "symbol, tf, atr_period, mult_e4, mode"
_PICKED = ["symbol", "tf", *KEYS]


def _greedy(order: str, near: str, limit: int, where: str, by: str = "symbol", start: str = "[]") -> str:
    """chosen(by, chosen): the greedy choice of each group of pool, as a list; c is a row chosen before, r the row at hand."""
    row = "{{'tf': r.tf, 'atr_period': r.atr_period, 'mult_e4': r.mult_e4, 'mode': r.mode, 'rn': r.rn}}".replace("{{", "{").replace("}}", "}")
    kind = "STRUCT(tf INTEGER, atr_period INTEGER, mult_e4 BIGINT, mode VARCHAR, rn BIGINT)[]"
    return f"""ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS rn FROM pool WHERE {where}),
steps AS (SELECT DISTINCT {by}, 0::BIGINT AS rn, []::{kind} AS chosen FROM ranked
  UNION ALL SELECT {', '.join('s.' + x.strip() for x in by.split(','))}, r.rn, CASE WHEN len(s.chosen) < {limit} AND len(list_filter(s.chosen, lambda c: {near})) = 0 THEN list_append(s.chosen, {row}) ELSE s.chosen END
  FROM steps s JOIN ranked r ON {' AND '.join(f's.{x.strip()} = r.{x.strip()}' for x in by.split(','))} AND r.rn = s.rn + 1),
chosen AS (SELECT {by}, unnest(arg_max(chosen, rn)) AS x FROM steps GROUP BY {by})"""


@register(query(POOL, f"""SELECT tf, mode, atr_bucket, mult_bucket, count(*) AS members, {_share('selection_score > 0', 'selection_positive_ratio')}, {_share('validation_score > 0', 'validation_positive_ratio')}, {_mid('selection_score', 'median_selection_score')}, {_mid('validation_score', 'median_validation_score')}, {_mid('validation_median_return_pct', 'median_validation_window_pct')}, {_share('test_total_return_pct > 0', 'holdout_positive_ratio')}, {_mid('test_total_return_pct', 'median_holdout_pct')}
FROM (SELECT *, (atr_period // 10 * 10)::BIGINT AS atr_bucket, (round_even(mult_e4 / 2500.0::DOUBLE, 0) * 2500)::BIGINT AS mult_bucket FROM pool WHERE selection_score > -1e8) GROUP BY tf, mode, atr_bucket, mult_bucket HAVING count(*) >= 3"""))
def cluster_landscape(spark, d):
    return rounded(reports.cluster_landscape(pool(spark, d)))


def _neighbours(columns: dict[str, int], types: str) -> str:
    same = " AND ".join(f"abs(n.{c} - t.{c}) <= {far}" for c, far in columns.items())
    return f"""SELECT t.rank::INTEGER AS rank, t.strategy_type, t.symbol, t.tf, t.mode, {', '.join(f't.{c}' for c in columns)}, count(n.mode) AS neighbours, {_share('n.selection_score > 0', 'selection_positive_ratio', 'n.mode IS NOT NULL')}, {_share('n.validation_score > 0', 'validation_positive_ratio', 'n.mode IS NOT NULL')}, {_share('n.test_total_return_pct > 0', 'holdout_positive_ratio', 'n.mode IS NOT NULL')}, {_mid('n.validation_score', 'median_validation_score')}, {_mid('n.test_total_return_pct', 'median_holdout_pct')}
FROM top t LEFT JOIN {types} n ON n.symbol = t.symbol AND n.tf = t.tf AND n.mode = t.mode AND {same} AND n.robust_score > -1e8 WHERE t.rank <= 20 GROUP BY ALL"""


_TOP = "top AS (SELECT *, row_number() OVER (ORDER BY robust_score DESC, validation_score DESC, selection_score DESC, atr_period, mult_e4, mode, symbol) AS rank FROM {0})"


def _leaders(df: DataFrame) -> DataFrame:
    order = [F.desc("robust_score"), F.desc("validation_score"), F.desc("selection_score"), "atr_period", "mult_e4", "mode", "symbol"]
    return df.orderBy(*order).limit(20).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


@register(query(f"{POOL}, {_TOP.format('pool')}", _neighbours(reports.REACH["BASE"], "pool")))
def neighbour_stability(spark, d):
    df = pool(spark, d)
    return rounded(reports.neighbour_stability(df, _leaders(df)))


_TWO_SIDED = "two AS MATERIALIZED (SELECT * REPLACE ('ADAPTIVE_V2' AS strategy_type, 'ADAPTIVE' AS mode), atr_period AS long_atr_period, mult_e4 AS long_mult_e4, atr_period + 3 AS short_atr_period, mult_e4 + 500 AS short_mult_e4 FROM pool)"


@register(query(f"{POOL}, {_TWO_SIDED}, {_TOP.format('two')}", _neighbours(reports.REACH["ADAPTIVE"], "two").replace("t.mode, ", "t.mode, t.atr_period, t.mult_e4, ", 1)))
def neighbour_stability_adaptive(spark, d):
    """The rule of adaptive rows, on rows that have two sides."""
    df = pool(spark, d).withColumns({"strategy_type": F.lit("ADAPTIVE_V2"), "mode": F.lit("ADAPTIVE"), "long_atr_period": F.col("atr_period"), "long_mult_e4": F.col("mult_e4"), "short_atr_period": F.col("atr_period") + 3, "short_mult_e4": F.col("mult_e4") + 500})
    return rounded(reports.neighbour_stability(df, _leaders(df)))


@register(query(O.SWEPT, f"""SELECT * FROM (SELECT strategy_type, tf, mode, stage, atr_period, mult_e4::BIGINT AS mult_e4, {_SCORES}, {O.r('test_total_return_pct')}, concat_ws(';', CASE WHEN swept.selection_score > 0 AND swept.validation_score <= 0 THEN 'selection_positive_validation_nonpositive' END, CASE WHEN selection_median_return_pct > 0 AND validation_median_return_pct < 0 THEN 'median_sign_flip' END,
  CASE WHEN validation_positive_ratio < 0.5 THEN 'less_than_half_validation_windows_positive' END, CASE WHEN swept.test_total_return_pct < 0 THEN 'holdout_negative' END) AS flags FROM swept WHERE swept.selection_score > -1e8) WHERE flags <> ''"""))
def overfit_flags(spark, d):
    return rounded(reports.overfit_flags(swept(spark, d)))


@register(query(O.SWEPT, f"SELECT tf, atr_period, mult_e4::BIGINT AS mult_e4, {', '.join(O.r(f'max(robust_score) FILTER (mode = {m!r})', m.lower()) for m in O.MODES)} FROM swept GROUP BY tf, atr_period, mult_e4"))
def heatmap_pivot(spark, d):
    return rounded(reports.heatmap(swept(spark, d)))


@register(query(O.SWEPT, f"SELECT count(*) AS candidates, count(*) FILTER ({_VALID}) AS valid_candidates, count(*) FILTER (isnan(robust_score)) AS nan_scores, count(*) FILTER ({_VALID} AND {_SURVIVE}) AS survivors, count(*) FILTER ({_VALID} AND {_SURVIVE} AND {_STRICT}) AS strict_survivors FROM swept"))
def report_summary(spark, d):
    return reports.summary(swept(spark, d))


@register(query(f"{_RUNS}, {O.moded(['BOTH'])}, {O.PLAN}, {_PARTS}, segs AS (SELECT part AS segment_id, a AS start_idx, b AS end_idx, false AS raised FROM parts), {O.trades(O.BASE_KEYS, least=0)}", "SELECT segment_id, side, entry_idx, exit_idx, entry_ts, exit_ts, entry_price, exit_price, gross, net FROM trades"))
def trade_audit(spark, d):
    bars, runs = _one(spark, d)
    made = backtest.trades(runs, reports.audit_segments(walkforward.plan(bars)), bars, KEYS, FEE, SLIP, least_bars=0)
    return made.select("segment_id", "side", "entry_idx", "exit_idx", "entry_ts", "exit_ts", "entry_price", "exit_price", "gross", "net")


@register(query(f"{O.SWEPT}, a AS (SELECT 1 AS o, atr_period, mult_e4, mode FROM swept ORDER BY robust_score DESC, validation_score DESC, selection_score DESC, atr_period, mult_e4, mode LIMIT 15), b AS (SELECT 2 AS o, atr_period, mult_e4, mode FROM swept WHERE mode = 'LONG')", "SELECT min(o) AS o, atr_period, mult_e4::BIGINT AS mult_e4, mode FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY atr_period, mult_e4, mode"))
def audit_union(spark, d):
    """The keyed union of two leader tables: of one setting, the first table's row."""
    df = swept(spark, d)
    a = reports.ranked_top(df, 15).select(F.lit(1).alias("o"), *KEYS)
    return reports.keyed_union(a, df.where("mode = 'LONG'").select(F.lit(2).alias("o"), *KEYS), KEYS)


_TOP_ORDER = "robust_score DESC, validation_score DESC, selection_score DESC, strategy_type, symbol, tf, mode, atr_period, mult_e4"


@register(query(f"{POOL}, {_greedy(_TOP_ORDER, 'abs(c.atr_period - r.atr_period) <= 1 AND abs(c.mult_e4 - r.mult_e4) <= 1200', 20, 'robust_score > -1e8', 'symbol, mode')}", f"""SELECT symbol, tf, atr_period, mult_e4, mode, {O.r('robust_score')} FROM (
  SELECT *, CASE WHEN g <= 2 THEN 0 WHEN g IS NOT NULL THEN 1 ELSE 2 END AS turn FROM (
    SELECT r.*, c.g FROM ranked r LEFT JOIN (SELECT symbol, mode, x.rn AS rn, row_number() OVER (PARTITION BY symbol, mode ORDER BY x.rn) AS g FROM chosen) c USING (symbol, mode, rn)))
QUALIFY row_number() OVER (ORDER BY turn, CASE WHEN turn = 0 THEN tf END, CASE WHEN turn = 0 THEN symbol END, CASE WHEN turn = 0 THEN mode END, CASE WHEN turn = 0 THEN g END, {_TOP_ORDER}) <= 20"""))
def diversified_top(spark, d):
    return rounded(select.diversified_top(pool(spark, d), 20).select(*_PICKED, "robust_score"))


@register(query(f"{POOL}, {_greedy('selection_score DESC, mode DESC, atr_period, mult_e4', 'c.mode = r.mode AND abs(c.atr_period - r.atr_period) <= 2 AND abs(c.mult_e4 - r.mult_e4) <= 5000', 12, 'selection_score > -1e8')}", """SELECT symbol, x.tf AS tf, x.atr_period AS atr_period, x.mult_e4 AS mult_e4, x.mode AS mode FROM chosen UNION ALL
  SELECT symbol, tf, atr_period, mult_e4, mode FROM pool WHERE symbol NOT IN (SELECT symbol FROM chosen) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY selection_score DESC, mode DESC, atr_period, mult_e4) <= 12"""))
def choose_seeds(spark, d):
    return select.choose_seeds(pool(spark, d), 12).select(*_PICKED)


@register(query(f"{POOL}, {_greedy('selection_score + 0.6::DOUBLE * up_positive_ratio + up_avg_return_pct / 35.0::DOUBLE DESC, atr_period, mult_e4', 'abs(c.atr_period - r.atr_period) <= 2 AND abs(c.mult_e4 - r.mult_e4) <= 1800', 5, 'mode = $$LONG$$ AND selection_score > -1e8')}", "SELECT symbol, x.tf AS tf, x.atr_period AS atr_period, x.mult_e4 AS mult_e4, x.mode AS mode FROM chosen"))
def components(spark, d):
    return select.components(pool(spark, d), "LONG", 5).select(*_PICKED)


def _retained(limit: int) -> str:
    ranks = ", ".join(f"row_number() OVER (PARTITION BY symbol ORDER BY {c} DESC, mode, atr_period, mult_e4) AS r{i}" for i, c in enumerate(select.SCORES))
    each = f"greatest(25, {limit} // greatest(20, 3 * 8))"
    return f"""{POOL}, placed AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n, {ranks}, row_number() OVER (PARTITION BY symbol, mode ORDER BY selection_score DESC, atr_period, mult_e4) AS rf FROM pool),
leaders AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY greatest(selection_score, validation_score, robust_score) DESC, mode, atr_period, mult_e4) AS rb FROM placed WHERE n > {limit} AND (r0 <= {limit // 2} OR r1 <= {limit // 4} OR r2 <= {limit // 4} OR rf <= {each})),
kept AS (SELECT {_NAMED}, selection_score FROM leaders WHERE rb <= {limit} UNION ALL SELECT {_NAMED}, selection_score FROM placed WHERE n <= {limit})"""


@register(query(_retained(60), f"SELECT {_NAMED}, {O.r('selection_score')} FROM kept"))
def retained_rows(spark, d):
    """Retention of a pool that came in twice: the first series has more rows than the limit, the second fewer."""
    df = pool(spark, d)
    return rounded(select.retain(df.unionByName(df), 60).select(*_PICKED, "selection_score"))


@register(query(_retained(30), f"SELECT {_NAMED}, {O.r('selection_score')} FROM kept"))
def retained_few(spark, d):
    return rounded(select.retain(pool(spark, d), 30).select(*_PICKED, "selection_score"))


@register(query(O.SWEPT, "SELECT strategy_type, tf, stage, count(*) AS n FROM swept GROUP BY ALL"))
def store_counts(spark, d):
    return store.counts(swept(spark, d).select("strategy_type", "tf", "stage", *KEYS))


_CONFIG = dict(symbol="ORDERS", months=18, tfs=[1440], fee=FEE, slippage=SLIP, depth="standard")


@register(query(O.ORDERS, f"""SELECT substr(sha256('{{"config":' || '{json.dumps(_CONFIG, sort_keys=True, separators=(",", ":"))}' || ',"data":[{{"first_close":' || round(arg_min(close, timestamp), 8) || ',"first_ts":' || min(timestamp) || ',"last_close":' || round(arg_max(close, timestamp), 8) || ',"last_ts":' || max(timestamp) || ',"rows":' || count(*) || ',"symbol":"ORDERS","tf":1440}}],"version":"1"}}'), 1, 16) AS signature FROM bars"""))
def run_signature(spark, d):
    return spark.range(1).select(F.lit(store.signature(_CONFIG | {"workers": 3}, C.orders_daily(spark, d))).alias("signature"))


@register(query(O.ORDERS, """SELECT 'ORDERS' AS symbol, 1440 AS tf, (row_number() OVER (ORDER BY timestamp) - 1)::BIGINT AS idx, timestamp, close FROM bars, (SELECT min(timestamp) AS a, max(timestamp) AS b FROM bars) WHERE timestamp BETWEEN a + 10 * 86400000::BIGINT AND b - 5 * 86400000::BIGINT AND timestamp + 86400000 <= b - 7 * 86400000::BIGINT"""))
def candles_cleaned_span(spark, d):
    """Cleaning within bounds, and without the bar that has not closed yet."""
    bars = daily(spark, d)
    a, b = bars.agg(F.min("timestamp"), F.max("timestamp")).first()
    return C.clean(bars, "idx", "ORDERS", 1440, start_ms=a + 10 * C.DAY_MS, end_ms=b - 5 * C.DAY_MS, now_ms=b - 7 * C.DAY_MS).select("symbol", "tf", "idx", "timestamp", "close")


@register("""WITH l(a, m) AS (VALUES (12, 22000), (7, 9000)), s(a, m) AS (VALUES (20, 31000)), r AS (SELECT unnest(range(0, 24)) AS regime_id)
SELECT 'S' AS symbol, 60 AS tf, l.a AS long_atr_period, l.m::BIGINT AS long_mult_e4, s.a AS short_atr_period, s.m::BIGINT AS short_mult_e4, regime_id FROM l, s, r""")
def adaptive_settings(spark, d):
    """Long x short components x regimes of each series."""
    rows = lambda *v: spark.createDataFrame([("S", 60, *x) for x in v], "symbol string, tf int, atr_period int, mult_e4 long")
    made = grid.adaptive_product(rows((12, 22000), (7, 9000)), rows((20, 31000)), grid.regime_grid(spark, _PRESET.regimes))
    return made.select("symbol", "tf", "long_atr_period", "long_mult_e4", "short_atr_period", "short_mult_e4", "regime_id")


_LEADERS = ((1, 7, 10000, "BOTH"), (2, 14, 30000, "LONG"), (3, 21, 50000, "SHORT"), (4, 14, 30000, "BOTH"))
_AUDITED = f"""{O.ORDERS}, {O.TR}, {O.trend("SELECT DISTINCT p, m FROM (VALUES " + ", ".join(f"({p}, {m})" for _, p, m, _ in _LEADERS) + ") v(p, m)")}, {_SIG}, {O.runs('sig', 'atr_period, mult_e4', 't', 'i')},
set_runs AS (SELECT rank, first_idx, last_idx, side FROM runs JOIN (VALUES {", ".join(str(x) for x in _LEADERS)}) v(rank, p, m, mode) ON p = atr_period AND m = mult_e4 WHERE mode = 'BOTH' OR side = CASE mode WHEN 'LONG' THEN 1 ELSE -1 END), {O.PLAN}, {_PARTS}, segs AS (SELECT part AS segment_id, a AS start_idx, b AS end_idx, false AS raised FROM parts), {O.trades('rank', least=0)}"""


@register(query(_AUDITED, "SELECT rank, segment_id, side, entry_idx, exit_idx, entry_price, exit_price, gross, net FROM trades"))
def audit_leaders(spark, d):
    """The signals of chosen rows rebuilt, and their trades by part."""
    bars = daily(spark, d)
    rows = spark.createDataFrame([("BASE", "ORDERS", 1440, *x) for x in _LEADERS], "strategy_type string, symbol string, tf int, rank int, atr_period int, mult_e4 long, mode string")
    return audit.audit(bars, rows, walkforward.plan(bars), FEE, SLIP).select("rank", "segment_id", "side", "entry_idx", "exit_idx", "entry_price", "exit_price", "gross", "net")


@register(query(f"{O.ADAPTIVE}, {O.PLAN}, {_PARTS}, segs AS (SELECT part AS segment_id, a AS start_idx, b AS end_idx, false AS raised FROM parts), {O.trades('one', least=0)}", "SELECT 1 AS rank, segment_id, side, entry_idx, exit_idx, gross, net FROM trades"))
def audit_adaptive(spark, d):
    bars = daily(spark, d)
    row = {"strategy_type": "ADAPTIVE_V2", "symbol": "ORDERS", "tf": 1440, "rank": 1, "long_atr_period": O.LONG[0], "long_mult_e4": O.LONG[1], "short_atr_period": O.SHORT[0], "short_mult_e4": O.SHORT[1], **O.REGIME}
    kind = {"long_mult_e4": "long", "short_mult_e4": "long", "strategy_type": "string", "symbol": "string", "adx_threshold": "double", "separation_atr": "double"}
    rows = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} {kind.get(c, 'int')}" for c in row))
    return audit.audit(bars, rows, walkforward.plan(bars), FEE, SLIP).select("rank", "segment_id", "side", "entry_idx", "exit_idx", "gross", "net")
