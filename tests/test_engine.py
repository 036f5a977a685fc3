"""The engine against a plain replay, bar by bar, and against itself by other ways."""

import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import kernels as K
from tickloom.operators import backtest, evaluate, grid, indicators, select, walkforward
from tickloom.plans import catalog
from tickloom.sources import candles as C
from tickloom.sources import klines
from tickloom.sources.bundle import damaged, write_bundle
from tickloom.sources.store import Store, signature

KEYS = ["atr_period", "mult_e4", "mode"]
HOUR = 3_600_000


def walk(n=1500, seed=3, step_ms=HOUR):
    r = np.random.default_rng(seed)
    ret = np.concatenate([r.normal(d, v, n // 3 + 1) for d, v in ((2e-4, 0.004), (-2e-4, 0.005), (0, 0.003))])[:n]
    close = 60000 * np.exp(ret.cumsum())
    open_ = np.concatenate([[60000], close[:-1]]) * (1 + r.normal(0, 1e-4, n))
    high = np.maximum(open_, close) * (1 + np.abs(r.normal(0, 1e-3, n)))
    low = np.minimum(open_, close) * (1 - np.abs(r.normal(0, 1e-3, n)))
    return [("S", int(step_ms // 60000), i, 1_700_000_000_000 + i * step_ms, float(open_[i]), float(high[i]), float(low[i]), float(close[i]), 1.0, 1.0) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "symbol string, tf int, idx long, timestamp long, open double, high double, low double, close double, volume double, turnover double").cache()


@pytest.fixture(scope="module")
def bars(spark):
    return frame(spark, walk(24 * 300))


def columns(rows):
    return (np.array([r[k] for r in rows]) for k in (4, 5, 6, 7))


def replay(signal, rows, start, end, fee, slip):
    """A position machine that looks at one bar at a time."""
    o, _, _, c = (x.tolist() for x in columns(rows))
    end = min(end, len(rows) - 1)
    out, side, entry = [], 0, None
    if end - start < 3:
        return out
    price = lambda p, s, into: p * (1 + slip if (s == 1) == into else 1 - slip)
    for i in range(start, end):
        want = int(signal[i])
        if want != side:
            if side:
                x = price(o[i + 1], side, False)
                out.append((entry[0], side, max((x - entry[1]) / entry[1] * side - 2 * fee, -0.999999)))
            side, entry = want, (i + 1, price(o[i + 1], want, True)) if want else None
    if side:
        x = price(c[end], side, False)
        out.append((entry[0], side, max((x - entry[1]) / entry[1] * side - 2 * fee, -0.999999)))
    return out


@pytest.mark.parametrize("mode", ["BOTH", "LONG", "SHORT"])
def test_trades_equal_replay_in_every_segment(spark, bars, mode):
    rows = [tuple(r) for r in bars.orderBy("idx").collect()]
    _, h, low, c = columns(rows)
    signal = K.band_trend(h, low, c, K.wilder_atr(h, low, c, 14), np.array([2.5]))[:, 0]
    signal = np.where(signal == {"LONG": -1, "SHORT": 1, "BOTH": 9}[mode], 0, signal)
    g = spark.createDataFrame([("S", 60, 14, 25000, mode)], "symbol string, tf int, atr_period int, mult_e4 long, mode string")
    last = len(rows) - 1
    segs = [("a", 0, last), ("b", 100, 103), ("c", 100, 102), ("d", 700, 1400), ("e", last - 4, last + 50)]
    df = spark.createDataFrame([("S", 60, *s) for s in segs], "symbol string, tf int, segment_id string, start_idx long, end_idx long")
    made = backtest.trades(backtest.with_mode(indicators.trend_runs(bars, g), g), df, bars, KEYS, 0.00055, 0.0002).orderBy("entry_idx").collect()
    for name, a, b in segs:
        mine = [(r.entry_idx, r.side, r.net) for r in made if r.segment_id == name]
        theirs = replay(signal, rows, a, b, 0.00055, 0.0002)
        assert [m[:2] for m in mine] == [t[:2] for t in theirs]
        assert np.allclose([m[2] for m in mine], [t[2] for t in theirs], rtol=0, atol=1e-12)


def test_metrics_equal_plain_folds(spark, bars):
    g = spark.createDataFrame([("S", 60, 14, 25000, "BOTH")], "symbol string, tf int, atr_period int, mult_e4 long, mode string")
    made = backtest.trades(backtest.with_mode(indicators.trend_runs(bars, g), g), walkforward.whole_range(bars), bars, KEYS, 0.00055, 0.0002)
    m = backtest.metrics(made, KEYS).first()
    net = np.array([r.net for r in made.orderBy("entry_idx").collect()])
    eq = np.r_[1.0, np.cumprod(1 + net)]
    assert m.trades == len(net) and m.wins == (net > 0).sum() and m.wins + m.losses == m.trades
    assert m.total_return_pct == pytest.approx((eq[-1] - 1) * 100, abs=1e-9)
    assert m.max_drawdown_pct == pytest.approx(abs((eq / np.maximum.accumulate(eq) - 1).min()) * 100, abs=1e-9)
    assert m.median_trade_pct == pytest.approx(np.median(net) * 100, abs=1e-12)
    fused = backtest.metrics(made, KEYS, fused=True).first()
    assert (fused.trades, fused.median_trade_pct, fused.months) == (m.trades, 0.0, 0) and fused.profit_factor == pytest.approx(m.profit_factor)


def test_no_trades_make_defined_metrics(spark, bars):
    wanted = spark.createDataFrame([("S", 60, 5, 1, "BOTH", "x", 1)], "symbol string, tf int, atr_period int, mult_e4 long, mode string, segment_id string, min_trades int")
    empty = spark.createDataFrame([], "symbol string, tf int, atr_period int, mult_e4 long, mode string, segment_id string, side int, entry_idx long, net double, month int")
    m = backtest.metrics(empty, KEYS, wanted).first()
    assert (m.trades, m.total_return_pct, m.score) == (0, 0.0, -1e9)


def test_regimes_and_trends_do_not_see_the_future():
    rows = walk(900)
    o, h, low, c = columns(rows)
    cut = 600
    h2, l2, c2 = (np.concatenate([x[:cut], x[cut:] * 1.7]) for x in (h, low, c))
    params = dict(ema_fast=8, ema_slow=21, adx_period=14, adx_threshold=20.0, separation_atr=0.15, confirm_bars=3, min_hold_bars=6)
    assert (K.regime_v2(h, low, c, params)[:cut] == K.regime_v2(h2, l2, c2, params)[:cut]).all()
    t = [K.band_trend(a, b, x, K.wilder_atr(a, b, x, 14), np.array([2.5, 1.0]))[:cut] for a, b, x in ((h, low, c), (h2, l2, c2))]
    assert (t[0] == t[1]).all()


@pytest.mark.parametrize("n", [0, 1, 5, 14, 15])
def test_short_series_have_no_trend(n):
    rows = walk(max(n, 1))[:n]
    _, h, low, c = columns(rows)
    atr = K.wilder_atr(h, low, c, 14)
    assert np.isnan(atr).all() == (n <= 14)
    assert (K.band_trend(h, low, c, atr, np.array([2.0])) != 0).any() == (n > 14)


def test_constant_prices():
    flat = np.full(50, 10.0)
    assert (K.wilder_atr(flat, flat, flat, 14)[13:] == 0).all()
    assert (K.adx(flat, flat, flat, 14) == 0).all()


def test_adaptive_runs_equal_combined_signal(spark, bars):
    rows = [tuple(r) for r in bars.orderBy("idx").collect()]
    _, h, low, c = columns(rows)
    params = dict(ema_fast=8, ema_slow=21, adx_period=14, adx_threshold=20.0, separation_atr=0.15, confirm_bars=3, min_hold_bars=6)
    t = [K.band_trend(h, low, c, K.wilder_atr(h, low, c, p), np.array([m]))[:, 0] for p, m in ((12, 2.2), (20, 3.1))]
    g = K.regime_v2(h, low, c, params)
    want = np.where((g == 1) & (t[0] == 1), 1, np.where((g == -1) & (t[1] == -1), -1, 0)).astype(np.int8)
    make = lambda p, m: indicators.trend_runs(bars, spark.createDataFrame([("S", 60, p, m)], "symbol string, tf int, atr_period int, mult_e4 long")).drop("atr_period", "mult_e4")
    config = spark.createDataFrame([(0, *params.values())], "regime_id long, " + ", ".join(f"{k} {'double' if isinstance(v, float) else 'int'}" for k, v in params.items()))
    runs = indicators.combine_runs(make(12, 22000), make(20, 31000), indicators.regime_runs(bars, config).drop("regime_id"), [])
    got = sorted((r.first_idx, r.last_idx, r.side) for r in runs.collect())
    assert got == sorted(zip(*(x.tolist() for x in K.run_lengths(want))))


def test_plan_is_ordered_and_split(bars):
    p = walkforward.plan(bars).first()
    assert p.windows >= 4 and p.research_start < p.validation_start <= p.holdout_start < p.n
    phases = [r.phase for r in walkforward.windows(bars).orderBy("window_no").collect()]
    assert phases == sorted(phases) and phases.count("VALIDATION") >= 2


def test_short_history_has_no_plan(spark):
    assert walkforward.plan(frame(spark, walk(399))).count() == 0
    assert walkforward.segments(frame(spark, walk(399))).count() == 0


def test_empty_and_odd_candles_have_defined_results(spark, bars):
    """No candles: no runs, no plan, no rows; null ticks count for nothing; repeated ticks count twice; other columns are ignored."""
    none = bars.where("false")
    g = spark.createDataFrame([("S", 60, 14, 25000, "BOTH")], "symbol string, tf int, atr_period int, mult_e4 long, mode string")
    assert indicators.trend_runs(none, g).count() == 0 and indicators.trend_runs(bars, g.where("false")).count() == 0
    config = spark.createDataFrame([(0, 8, 21, 14, 20.0, 0.15, 3, 6)], "regime_id long, ema_fast int, ema_slow int, adx_period int, adx_threshold double, separation_atr double, confirm_bars int, min_hold_bars int")
    assert indicators.regime_runs(none, config).count() == 0 and indicators.regime_runs(bars, config.where("false")).count() == 0
    assert walkforward.plan(none).count() == 0 and walkforward.windows(none).count() == 0 and C.quality(none).count() == 0
    runs = backtest.with_mode(indicators.trend_runs(none, g), g)
    assert backtest.metrics(backtest.trades(runs, walkforward.whole_range(none), none, KEYS, 0.0, 0.0), KEYS).count() == 0
    assert evaluate.evaluate(runs, g.where("false"), KEYS, walkforward.segments(none), none, 0.0, 0.0, 1).count() == 0
    ticks = spark.createDataFrame([("S", 5, 1, 100), ("S", 5, 1, 100), ("S", None, 2, 100), ("S", 7, 3, None), ("T", 70_000, 4, -50)], "symbol string, ms long, seq long, step long").withColumn("cum", F.lit(9))
    got = sorted((r.symbol, r.idx, r.timestamp, r.high, r.close, r.volume) for r in C.walk_candles(ticks, 10.0, 60_000, 1).collect())
    assert got == [("S", 0, 0, 12.0, 12.0, 2.0), ("T", 0, 60_000, 9.5, 9.5, 1.0)]


def test_evaluation_has_a_row_a_setting(spark, bars):
    g = grid.product(spark, [14], [25000]).crossJoin(bars.select("symbol", "tf").distinct())
    df = evaluate.evaluate(backtest.with_mode(indicators.trend_runs(bars, g), g), g, KEYS, walkforward.segments(bars, 24), bars, 0.00055, 0.0002, 24, "atr_period")
    rows = df.collect()
    w = walkforward.windows(bars).count()
    assert sorted(r["mode"] for r in rows) == ["BOTH", "LONG", "SHORT"] and all(r.wf_windows == w for r in rows)
    assert all(np.isfinite(r.robust_score) and r.up_windows + r.down_windows + r.flat_windows == w for r in rows)


def test_cleaning(spark):
    rows = [("3", "1", "2", "1", "2", None), ("1", "1", "2", "1", "2", "5"), ("1", "9", "9", "9", "9", "9"), ("x", "1", "2", "1", "2", "5"), ("2", None, "2", "1", "2", "5")]
    raw = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, timestamp string, open string, high string, low string, close string, volume string")
    got = [(r.idx, r.timestamp, r.open, r.volume, r.turnover) for r in C.clean(raw, "n", "S", 60).orderBy("idx").collect()]
    assert got == [(0, 1, 1.0, 5.0, 0.0), (1, 3, 1.0, 0.0, 0.0)]
    assert [r.timestamp for r in C.clean(raw, "n", "S", 60, strict=True).collect()] == [1]
    assert C.clean(raw, "n", "S", 60, now_ms=1 + 3_600_000).count() == 1
    with pytest.raises(ValueError):
        C.require_enough(C.clean(raw, "n", "S", 60))


def test_csv_round_trip(spark, tmp_path, bars):
    C.write_csv(bars.limit(50), f"file://{tmp_path}/c")
    back = C.read_csv(spark, f"file://{tmp_path}/c/symbol=S/tf=60", "S", 60)
    assert back.count() == 50
    with pytest.raises(ValueError):
        bars.select("open").write.option("header", True).csv(f"file://{tmp_path}/bad")
        C.read_csv(spark, f"file://{tmp_path}/bad", "S", 60)


def test_cached_files_are_found_by_what_they_hold(spark, tmp_path, bars):
    C.write_csv(bars.where("idx < 400"), f"file://{tmp_path}/c")
    catalog = C.cached_files(spark, f"file://{tmp_path}/c")
    first, last = catalog.agg(F.min("first_ts"), F.max("last_ts")).first()
    assert catalog.agg(F.sum("rows")).first()[0] == 400 and {(r.symbol, r.tf) for r in catalog.collect()} == {("S", 60)}
    one = catalog.groupBy("symbol", "tf").agg(F.min("path").alias("path"), F.max("modified").alias("modified"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    assert C.find_reusable(one, "S", 60, first, last).count() == 1 and C.find_reusable(one, "S", 60, first, last + 400 * HOUR).count() == 0


def test_bundle_tells_damage(spark, tmp_path):
    views = {"a": spark.range(5), "b": spark.sql("SELECT 'x' AS c WHERE false")}
    folder = f"file://{tmp_path}/bundle"
    manifest = write_bundle(spark, views, folder).collect()
    assert {r.name for r in manifest} >= {"a"} and all(len(r.sha256) == 64 and r.length > 0 for r in manifest)
    assert damaged(spark, folder).count() == 0
    next((tmp_path / "bundle/a").glob("*.csv")).write_text("id\n7\n")
    for crc in (tmp_path / "bundle/a").glob(".*.crc"):
        crc.unlink()
    assert [r.name for r in damaged(spark, folder).collect()] == ["a"]


def test_plan_refuses_disordered_times(spark):
    rows = walk(500)
    rows[7] = (*rows[7][:3], rows[6][3], *rows[7][4:])
    with pytest.raises(Exception, match="rise strictly"):
        walkforward.plan(frame(spark, rows)).collect()


def test_quality_finds_faults(spark):
    rows = walk(20)
    rows[5] = (*rows[5][:3], rows[4][3], *rows[5][4:])
    rows[9] = (*rows[9][:5], 0.5, *rows[9][6:])
    rows = rows[:12] + rows[15:]
    q = C.quality(frame(spark, rows)).first()
    assert (q.duplicate_timestamps, q.non_monotonic_steps, q.gap_events, q.missing_candles, q.invalid_ohlc_rows) == (1, 1, 2, 4, 1)


SCORED = "symbol string, tf int, mode string, atr_period int, mult_e4 long, selection_score double, validation_score double, robust_score double"


def scored(spark, rows):
    return spark.createDataFrame([(s, 60, m, p, e, x, x, x) for s, m, p, e, x in rows], SCORED)


def test_seeds_keep_apart_and_fall_back(spark):
    df = scored(spark, [("S", "BOTH", p, m, s) for p, m, s in ((10, 20000, 3.0), (11, 22000, 2.0), (14, 20000, 1.0), (10, 26000, 0.5))])
    assert sorted((r.atr_period, r.mult_e4) for r in select.choose_seeds(df, 5).collect()) == [(10, 20000), (10, 26000), (14, 20000)]
    assert select.retain(df.unionByName(df), 100).count() == 4
    assert select.choose_seeds(df.where("false"), 5).count() == 0
    bad = df.withColumn("selection_score", F.lit(-1e9))
    assert select.choose_seeds(bad, 2).count() == 2  # nothing valid: the first rows


def test_limits_hold_in_each_series(spark):
    rows = [(s, "BOTH", 10 * k, 20000, 100.0 - k + (50 if s == "S" else 0)) for s in ("S", "T") for k in range(1, 20)]
    df = scored(spark, rows)
    for found, n in ((select.choose_seeds(df, 8), 8), (select.components(df.withColumns({"mode": F.lit("LONG"), "up_positive_ratio": F.lit(0.5), "up_avg_return_pct": F.lit(1.0)}), "LONG", 5), 5), (select.retain(df, 12), 12), (select.top_up(df, select.choose_seeds(df, 3), 6), 12)):
        assert {r.symbol: r["count"] for r in found.groupBy("symbol").count().collect()} == {"S": n, "T": n}


def test_retention_keeps_all_up_to_the_limit(spark):
    df = spark.range(3000).selectExpr("'S' AS symbol", "60 AS tf", "'BOTH' AS mode", "cast(id AS int) AS atr_period", "20000L AS mult_e4", "cast(id AS double) AS selection_score", "cast(-id AS double) AS validation_score", "0.0D AS robust_score")
    assert select.retain(df, 3500).count() == 3000
    few = {r.atr_period for r in select.retain(df, 400).collect()}
    assert len(few) <= 400 and {2999, 2800} <= few and {0, 99} <= few


def test_top_keeps_families_and_then_fills(spark):
    rows = [("S", "LONG", 10 + k, 20000, 90.0 - k) for k in range(9)] + [("S", "SHORT", 10, 20000, 1.0), ("T", "BOTH", 10, 20000, -1e9)]
    df = scored(spark, rows).withColumn("strategy_type", F.lit("BASE"))
    got = [(r["mode"], r.atr_period) for r in select.diversified_top(df, 5).collect()]
    assert got == [("LONG", 10), ("LONG", 12), ("LONG", 14), ("LONG", 16), ("SHORT", 10)]
    assert len(select.diversified_top(df, 10).collect()) == 10 and select.diversified_top(df.where("false"), 5).count() == 0


def test_regimes_of_long_series_are_quick():
    r = np.random.default_rng(5)
    raw = np.repeat(r.integers(-1, 2, 40_000).astype(np.int8), r.integers(1, 5, 40_000))[:100_000]
    began = time.perf_counter()
    out = K.confirmed_regime(raw, 2, 6)
    assert time.perf_counter() - began < 1 and len(out) == len(raw)
    now, held, pending = 0, 0, []
    for x, y in zip(raw[:3000].tolist(), out[:3000].tolist()):
        pending = [] if x == now else pending + [x] if pending and pending[-1] == x else [x]
        if len(pending) >= 2 and (now == 0 or held >= 6):
            now, held, pending = x, 0, []
        else:
            held += 1
        assert y == now


def test_runs_meet_segments_once(spark):
    r = np.random.default_rng(6)
    a = [("S", 60, int(x), int(x + n)) for x, n in zip(r.integers(0, 900, 60), r.integers(0, 300, 60))]
    b = [("S", 60, int(x), int(x + n)) for x, n in zip(r.integers(0, 900, 60), r.integers(0, 300, 60))]
    one, two = spark.createDataFrame(a, "symbol string, tf int, p long, q long"), spark.createDataFrame(b, "symbol string, tf int, x long, y long")
    got = sorted((i.p, i.q, i.x, i.y) for i in indicators.overlapping(one, two, ["symbol", "tf"], ("p", "q"), ("x", "y")).collect())
    assert got == sorted((p, q, x, y) for _, _, p, q in a for _, _, x, y in b if max(p, x) <= min(q, y))


def test_signature_ignores_workers_and_sees_data(spark, bars):
    a = signature({"fee": 1, "workers": 2}, bars)
    assert a == signature({"fee": 1, "workers": 9}, bars) and len(a) == 16
    assert a != signature({"fee": 2}, bars) and a != signature({"fee": 1}, bars.where("idx < 100"))


def test_signature_of_large_prices_is_that_of_the_sql(spark, tmp_path):
    con = duckdb.connect()
    # cents of walks whose closes round(x, 8) changes in the last bit
    changed = [con.execute(f"SELECT i FROM range({a}, {a} + 2000) r(i) WHERE round(250000000 + i::DOUBLE / 100, 8) <> 250000000 + i::DOUBLE / 100").fetchall() for a in (-743_305_752_000, 16_908_310_000)]
    assert all(changed)
    for k, (first, last) in enumerate([(changed[0][0][0], changed[1][0][0]), (changed[1][-1][0], changed[0][-1][0]), (7, changed[0][0][0])]):
        folder = tmp_path / str(k)
        folder.mkdir()
        rows = ", ".join(f"({i}, {int(x < 0)}, {abs(x)} / 100, TIMESTAMP '2001-01-01' + INTERVAL {i} DAY)" for i, x in enumerate([first, last - first]))
        con.execute(f"COPY (SELECT i::BIGINT AS o_orderkey, c::BIGINT AS o_custkey, p::DOUBLE AS o_totalprice, t AS o_orderdate FROM (VALUES {rows}) v(i, c, p, t)) TO '{folder}/orders.parquet'")
        con.execute(f"CREATE OR REPLACE VIEW orders AS FROM '{folder}/orders.parquet'")
        assert catalog.QUERIES["run_signature"](spark, str(folder)).first()[0] == con.execute(catalog.ORACLE_SQL["run_signature"]).fetchone()[0]


def test_store_resumes_and_purges(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    s = Store(spark, root, "abc", {"fee": 1})
    df = spark.range(10)
    s.queue(60, "coarse", "u1", df, 1_000_000)
    s.queue(60, "coarse", "u1", df, 1_000_000)
    df.write.parquet(f"{s.folder}/data/debris")
    s.save_seed(60, "coarse", df.limit(3), n=3)
    again = Store(spark, root, "abc")
    assert again.resumed and again.done(60, "coarse", "u1") and again.complete(60, "coarse") and not (tmp_path / "store/run-abc/data/debris").exists()
    assert again.results().count() == 10 and again.load_seed(60, "coarse").count() == 3 and again.summary()["checks"] == 1_000_000
    left = again.remaining(spark.createDataFrame([("u1",), ("u2",)], "unit_id string"), 60, "coarse")
    assert [r.unit_id for r in left.collect()] == ["u2"]
    (tmp_path / "store/run-abc/manifest.new").write_text("cut short")  # a crash between writing and renaming
    assert Store(spark, root, "abc").results().count() == 10
    again = Store(spark, root, "abc")
    again.finish()
    assert not Store(spark, root, "abc").resumed


def test_klines_page_backwards_and_fail_well():
    times = list(range(0, 5000))

    def fetch(url, q):
        rows = [t for t in times if q["start"] <= t <= q["end"]][-q["limit"] :]
        return {"retCode": 0, "result": {"list": [[str(t), "1", "1", "1", "1", "1", "1"] for t in reversed(rows)]}}

    got = list(klines.read_span(fetch, "u", "S", 1, 0, 4999, pace=0))
    assert sorted(int(r[0]) for r in got) == times
    with pytest.raises(ValueError):
        list(klines.read_span(lambda u, q: {"retCode": 1, "retMsg": "no"}, "u", "S", 1, 0, 10, pace=0))
    calls = []

    def flaky(u, q):
        calls.append(1)
        if len(calls) < 3:
            raise OSError("down")
        return {"retCode": 0, "result": {"list": []}}

    assert list(klines.read_span(flaky, "u", "S", 1, 0, 10, pause=0, pace=0)) == [] and len(calls) == 3
    assert [(p.start, p.end) for p in klines.KlineReader(dict(start_ms="0", end_ms="9", spans="3")).partitions()] == [(0, 3), (4, 7), (8, 9)]


def test_search_runs_and_resumes(spark, tmp_path):
    from tickloom.plans import search

    bars = frame(spark, walk(24 * 240, step_ms=HOUR))
    tiny = grid.Preset(range(8, 21, 6), [15000, 30000], [(range(30, 41, 10), [20000], ("BOTH",))], grid.Box(1, 1, 0.1, 0.1, 0.15, 16.0), grid.Box(1, 1, 0.1, 0.1, 0.12, 18.0), grid.Box(1, 0, 0.02, 0.01, 0.1, 20.0), 1, {"ema": [(8, 21)], "adx_period": [14], "adx_threshold": [18], "separation_atr": [0.1], "confirm_bars": [2], "min_hold_bars": [3]})
    config = search.Config(depth="standard", months=1)
    told = []
    with pytest.raises(search.Stopped):
        search.run(spark, bars, f"file://{tmp_path}/runs", config, tiny, stop=lambda: len(told) > 1, tell=told.append)
    assert [x["stage"] for x in told] == ["start", "coarse"] and told[1]["checks"] > 0
    found = search.run(spark, bars, f"file://{tmp_path}/runs", config, tiny)
    assert len(list((tmp_path / "runs").glob("run-*"))) == 1  # resumed
    assert found["base"].count() >= 18 and found["adaptive"].count() <= 1 and found["top"].count() >= 1
    stages = {r.stage for r in found["base"].select("stage").distinct().collect()}
    assert {"coarse", "breadth"} <= stages
    with pytest.raises(ValueError):
        search.Config(fee=0.5)
    assert search.percent("0,055") == pytest.approx(0.00055)


def test_streaming_bars_close_by_watermark(spark, tmp_path):
    from tickloom.streaming.candles import streaming_candles

    t = spark.sql("SELECT 'S' AS symbol, timestamp_millis(1700000000000 + id * 60000) AS ts, id AS seq, cast(id AS double) AS price, 1.0D AS size FROM range(180)")
    t.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(t.schema).parquet(f"file://{tmp_path}/in")
    q = streaming_candles(stream).writeStream.format("memory").queryName("bars").option("checkpointLocation", f"file://{tmp_path}/ck").start()
    try:
        q.processAllAvailable()
        rows = spark.sql("SELECT * FROM bars ORDER BY timestamp").collect()
    finally:
        q.stop()
    assert len(rows) >= 2 and all(r.open <= r.close and r.low == r.open for r in rows)
