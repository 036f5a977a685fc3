"""DuckDB SQL of the reference operators, built from common table expressions. Only text is made here."""

from __future__ import annotations

FEE, SLIP, MIN_TRADES = 0.00055, 0.0002, 24
PERIODS, MULTS, MODES = (7, 10, 14, 21), (10000, 20000, 30000, 50000), ("BOTH", "LONG", "SHORT")


def r(x: str, name: str | None = None) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6 AS {name or x.rpartition('.')[2]}"


def _bars(table: str, ms: str, seq: str, value: str, even: str, base: int, bar: int, symbol: str, tf: int) -> str:
    return f"""ticks AS (SELECT epoch_ms({ms}) AS ms, {seq} AS seq, CASE WHEN {even} % 2 = 0 THEN 1 ELSE -1 END * CAST(round({value} * 100) AS BIGINT) AS step FROM {table}),
walk AS (SELECT ms, seq, step, ms // {bar} * {bar} AS bar, sum(step) OVER (ORDER BY ms, seq)::BIGINT AS s, row_number() OVER (ORDER BY ms, seq) AS k FROM ticks),
bars AS MATERIALIZED (SELECT '{symbol}' AS symbol, {tf} AS tf, (row_number() OVER (ORDER BY bar) - 1)::BIGINT AS idx, bar AS timestamp, {base}::DOUBLE + arg_min(s, k)::DOUBLE / 100.0::DOUBLE AS open, {base}::DOUBLE + max(s)::DOUBLE / 100.0::DOUBLE AS high,
  {base}::DOUBLE + min(s)::DOUBLE / 100.0::DOUBLE AS low, {base}::DOUBLE + arg_max(s, k)::DOUBLE / 100.0::DOUBLE AS close, count(*)::DOUBLE AS volume, sum(abs(step))::DOUBLE AS turnover FROM walk GROUP BY bar)"""


ORDERS = _bars("orders", "o_orderdate", "o_orderkey", "o_totalprice", "o_custkey", 250_000_000, 86_400_000, "ORDERS", 1440)
EVENTS = _bars("events", "ts", "event_id", "value", "user_id", 100_000, 3_600_000, "EVENTS", 60)

TR = """tr AS MATERIALIZED (SELECT idx, high AS h, low AS l, close AS c, (high + low) / 2.0::DOUBLE AS mid, lag(high) OVER w AS ph, lag(low) OVER w AS pl, lag(close) OVER w AS pc,
  CASE WHEN lag(close) OVER w IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr FROM bars WINDOW w AS (ORDER BY idx)),
size AS (SELECT count(*) AS n FROM bars)"""


def trend(grid: str) -> str:
    """st(p, m, i, s, atr, u, lo, t, c): the band trend t of every (p, m) of grid."""
    return f"""g AS ({grid}),
st(p, m, i, s, atr, u, lo, t, c) AS (
  SELECT g.p, g.m, tr.idx, tr.tr, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, 0, tr.c FROM g, tr WHERE tr.idx = 0
  UNION ALL
  SELECT p, m, idx, n_s, n_atr, n_u, n_l, CASE WHEN n_atr IS NULL THEN 0 WHEN o_t = 0 THEN CASE WHEN c >= mid THEN 1 ELSE -1 END WHEN o_t < 0 THEN CASE WHEN c > n_u THEN 1 ELSE -1 END ELSE CASE WHEN c < n_l THEN -1 ELSE 1 END END, c
  FROM (SELECT *, CASE WHEN n_atr IS NULL THEN NULL WHEN o_t = 0 OR top < o_u OR o_c > o_u THEN top ELSE o_u END AS n_u, CASE WHEN n_atr IS NULL THEN NULL WHEN o_t = 0 OR bottom > o_l OR o_c < o_l THEN bottom ELSE o_l END AS n_l
    FROM (SELECT *, mid + (m / 10000.0::DOUBLE) * n_atr AS top, mid - (m / 10000.0::DOUBLE) * n_atr AS bottom
      FROM (SELECT st.p, st.m, k.idx, k.c, k.mid, st.s + k.tr AS n_s, CASE WHEN size.n <= st.p THEN NULL WHEN k.idx = st.p - 1 THEN (st.s + k.tr) / st.p WHEN k.idx >= st.p THEN ((st.p - 1) * st.atr + k.tr) / st.p END AS n_atr, st.u AS o_u, st.lo AS o_l, st.t AS o_t, st.c AS o_c
        FROM st JOIN tr k ON k.idx = st.i + 1 CROSS JOIN size))))"""


ONE = "SELECT 14 AS p, 25000 AS m"
SWEEP = f"SELECT p, m FROM (VALUES {', '.join(f'({p})' for p in PERIODS)}) a(p), (VALUES {', '.join(f'({m})' for m in MULTS)}) b(m)"


def runs(source: str, keys: str, side: str, idx: str, name: str = "runs") -> str:
    return f"""{name}_0 AS (SELECT {keys}, {idx} AS i, {side} AS t, CASE WHEN lag({side}) OVER (PARTITION BY {keys} ORDER BY {idx}) = {side} THEN 0 ELSE 1 END AS ch FROM {source}),
{name}_1 AS (SELECT *, sum(ch) OVER (PARTITION BY {keys} ORDER BY i) AS rid FROM {name}_0),
{name} AS (SELECT {keys}, min(i) AS first_idx, max(i) AS last_idx, any_value(t) AS side FROM {name}_1 GROUP BY {keys}, rid HAVING any_value(t) <> 0)"""


def moded(modes=MODES) -> str:
    listed = ", ".join(f"('{m}')" for m in modes)
    return f"set_runs AS (SELECT runs.*, mode FROM runs, (VALUES {listed}) v(mode) WHERE mode = 'BOTH' OR (mode = 'LONG' AND side = 1) OR (mode = 'SHORT' AND side = -1))"


FULL = "segs AS (SELECT 'FULL' AS segment_id, 0 AS start_idx, max(idx) AS end_idx, false AS raised, 1 AS min_trades, '' AS phase, NULL AS regime FROM bars)"


def trades(keys: str, period: str = "0", least: int = 3) -> str:
    """trades from set_runs (keys, first_idx, last_idx, side) and segs; a segment without a bar before its end has none."""
    return f"""cut_0 AS (SELECT set_runs.*, segment_id, CASE WHEN raised THEN greatest(start_idx, {period}) ELSE start_idx END AS a, least(end_idx, (SELECT max(idx) FROM bars)) AS e FROM set_runs, segs),
cut AS (SELECT *, greatest(first_idx, a) AS f, least(last_idx, e - 1) AS z FROM cut_0 WHERE e - a >= {max(least, 1)} AND first_idx <= e - 1 AND last_idx >= a),
deal AS (SELECT cut.*, f + 1 AS entry_idx, CASE WHEN z < e - 1 THEN z + 2 ELSE e END AS exit_idx FROM cut),
fill AS (SELECT d.*, b.timestamp AS entry_ts, x.timestamp AS exit_ts, b.open * CASE WHEN side = 1 THEN 1.0::DOUBLE + {SLIP}::DOUBLE ELSE 1.0::DOUBLE - {SLIP}::DOUBLE END AS entry_price,
  CASE WHEN z < e - 1 THEN x.open ELSE x.close END * CASE WHEN side = 1 THEN 1.0::DOUBLE - {SLIP}::DOUBLE ELSE 1.0::DOUBLE + {SLIP}::DOUBLE END AS exit_price FROM deal d JOIN bars b ON b.idx = d.entry_idx JOIN bars x ON x.idx = d.exit_idx),
gain AS (SELECT *, CASE WHEN side = 1 THEN exit_price - entry_price ELSE entry_price - exit_price END / entry_price AS gross FROM fill),
trades AS (SELECT {keys}, segment_id, side, entry_idx, exit_idx, entry_ts, exit_ts, entry_price, exit_price, gross, greatest(gross - 2.0::DOUBLE * {FEE}::DOUBLE, -0.999999::DOUBLE) AS net, (year(make_timestamp(exit_ts * 1000)) * 100 + month(make_timestamp(exit_ts * 1000)))::INTEGER AS month FROM gain)"""


def equity(keys: str) -> str:
    return f"""eq_0 AS (SELECT *, row_number() OVER w AS trade_no, product(1.0::DOUBLE + net) OVER (PARTITION BY {keys}, segment_id ORDER BY entry_idx ROWS UNBOUNDED PRECEDING) AS equity FROM trades WINDOW w AS (PARTITION BY {keys}, segment_id ORDER BY entry_idx)),
eq AS (SELECT *, greatest(1.0::DOUBLE, max(equity) OVER (PARTITION BY {keys}, segment_id ORDER BY entry_idx ROWS UNBOUNDED PRECEDING)) AS peak FROM eq_0)"""


METRICS = ("trades", "wins", "losses", "win_rate", "total_return_pct", "profit_factor", "max_drawdown_pct", "avg_trade_pct", "median_trade_pct", "best_trade_pct", "worst_trade_pct", "long_return_pct", "short_return_pct", "long_trades", "short_trades", "profitable_months", "months", "profitable_month_ratio", "score")
COUNTS = {"trades", "wins", "losses", "long_trades", "short_trades", "profitable_months", "months"}


def metrics(keys: str, wanted: str, fused: bool = False) -> str:
    """met from trades and eq, for every row of wanted (keys, segment_id, min_trades)."""
    months = "0 AS months, 0 AS profitable_months" if fused else "count(*) AS months, count(*) FILTER (m > 0) AS profitable_months"
    median = "0.0::DOUBLE" if fused else "median(net) * 100"
    stable = "" if fused else " * (0.45 + 0.55 * profitable_month_ratio)"
    zero = ", ".join(f"coalesce({c}, 0) AS {c}" for c in METRICS if c not in ("score", "win_rate", "profitable_month_ratio", "profit_factor"))
    same = " AND ".join(f"w.{k.strip()} = a.{k.strip()}" for k in f"{keys}, segment_id".split(","))
    return f"""{equity(keys)},
agg AS (SELECT {keys}, segment_id, count(*) AS trades, count(*) FILTER (net > 0) AS wins, count(*) FILTER (net <= 0) AS losses, (arg_max(equity, trade_no) - 1) * 100 AS total_return_pct, coalesce(sum(net) FILTER (net > 0), 0) AS gp, abs(coalesce(sum(net) FILTER (net <= 0), 0)) AS gl,
  abs(min(equity / peak - 1) * 100) AS max_drawdown_pct, avg(net) * 100 AS avg_trade_pct, {median} AS median_trade_pct, max(net) * 100 AS best_trade_pct, min(net) * 100 AS worst_trade_pct, (coalesce(product(1 + net) FILTER (side = 1), 1) - 1) * 100 AS long_return_pct, (coalesce(product(1 + net) FILTER (side = -1), 1) - 1) * 100 AS short_return_pct,
  count(*) FILTER (side = 1) AS long_trades, count(*) FILTER (side = -1) AS short_trades FROM eq GROUP BY {keys}, segment_id),
mon AS (SELECT {keys}, segment_id, {months} FROM (SELECT {keys}, segment_id, month, product(1 + net) - 1 AS m FROM trades GROUP BY {keys}, segment_id, month) GROUP BY {keys}, segment_id),
met_0 AS (SELECT w.*, {zero}, coalesce(gp, 0) AS gp, coalesce(gl, 0) AS gl FROM ({wanted}) w LEFT JOIN (SELECT * FROM agg JOIN mon USING ({keys}, segment_id)) a ON {same}),
met_1 AS (SELECT *, CASE WHEN trades > 0 THEN wins / trades * 100 ELSE 0 END AS win_rate, CASE WHEN gl > 1e-12 THEN gp / gl WHEN gp > 0 THEN 99 ELSE 0 END AS profit_factor, CASE WHEN months > 0 THEN profitable_months / months ELSE 0 END AS profitable_month_ratio FROM met_0),
met AS (SELECT *, CASE WHEN trades >= greatest(min_trades, 1) AND total_return_pct > -99.9 THEN total_return_pct / greatest(max_drawdown_pct, 1) * greatest(least(profit_factor, 3), 0) * sqrt(least(trades, 250) / 250.0::DOUBLE){stable} ELSE -1e9 END AS score FROM met_1)"""


PLAN = f"""b0 AS (SELECT min(timestamp) AS first_ts, max(timestamp) AS last_ts, count(*) AS n, greatest((max(timestamp) - min(timestamp)) / 86400000.0::DOUBLE, 1) AS total_days FROM bars HAVING count(*) >= 400),
b1 AS (SELECT *, greatest(least(round_even(total_days * 0.2::DOUBLE, 0), 90), 60)::BIGINT AS holdout_days, greatest(least(round_even(total_days * 0.3::DOUBLE, 0), 180), 90)::BIGINT AS warm FROM b0),
b2 AS (SELECT *, last_ts - holdout_days * 86400000 AS holdout_ms FROM b1),
b3 AS (SELECT *, CASE WHEN first_ts + warm * 86400000 >= holdout_ms - 21 * 86400000::BIGINT THEN greatest(45, trunc(total_days * 0.2::DOUBLE)::BIGINT) ELSE warm END AS warmup_days FROM b2),
b4 AS (SELECT *, first_ts + warmup_days * 86400000 AS first_test FROM b3),
w0 AS (SELECT first_test + no * 21 * 86400000::BIGINT AS lo, first_test + (no + 1) * 21 * 86400000::BIGINT AS hi FROM b4, range(0, 10000) x(no) WHERE first_test + (no + 1) * 21 * 86400000::BIGINT <= holdout_ms),
w1 AS (SELECT lo, (SELECT count(*) FROM bars WHERE timestamp < lo) AS a, (SELECT count(*) FROM bars WHERE timestamp < hi) - 1 AS b FROM w0),
w2 AS (SELECT w1.*, CASE WHEN x.open > 0 THEN (y.close / x.open - 1) * 100 ELSE 0 END AS bench_pct FROM w1 JOIN bars x ON x.idx = a JOIN bars y ON y.idx = b WHERE b - a >= 20),
w3 AS (SELECT *, row_number() OVER (ORDER BY lo) - 1 AS window_no, count(*) OVER () AS w, CASE WHEN bench_pct >= 3 THEN 'UP' WHEN bench_pct <= -3 THEN 'DOWN' ELSE 'FLAT' END AS regime FROM w2),
wins AS (SELECT *, CASE WHEN window_no < CASE WHEN w >= 6 THEN greatest(4, least(w - 2, floor(w * 0.65::DOUBLE))) WHEN w >= 4 THEN greatest(2, w - 2) ELSE w END THEN 'SELECTION' ELSE 'VALIDATION' END AS phase FROM w3),
p0 AS (SELECT b4.*, (SELECT count(*) FROM wins) AS windows, greatest(1, least(n - 2, (SELECT count(*) FROM bars WHERE timestamp < holdout_ms))) AS holdout_start, coalesce((SELECT min(a) FROM wins), greatest(1, trunc(n * 0.35::DOUBLE)::BIGINT)) AS research_start FROM b4),
p1 AS (SELECT *, coalesce((SELECT min(a) FROM wins WHERE phase = 'VALIDATION'), holdout_start) AS validation_start FROM p0),
plan AS (SELECT *, greatest(research_start + 2, validation_start - 1) AS selection_end FROM p1)"""
SEGS = f"""segs AS (SELECT 'RESEARCH' AS segment_id, 'RESEARCH' AS phase, research_start AS start_idx, holdout_start - 1 AS end_idx, true AS raised, {MIN_TRADES} AS min_trades, NULL::VARCHAR AS regime, NULL::DOUBLE AS bench_pct FROM plan
  UNION ALL SELECT 'SELECTION', 'SELECTION', research_start, selection_end, true, {max(6, MIN_TRADES // 2)}, NULL, NULL FROM plan
  UNION ALL SELECT 'VALIDATION', 'VALIDATION', validation_start, holdout_start - 1, true, 1, NULL, NULL FROM plan WHERE validation_start < holdout_start - 2
  UNION ALL SELECT 'HOLDOUT', 'HOLDOUT', holdout_start, n - 1, false, 1, NULL, NULL FROM plan
  UNION ALL SELECT 'W' || lpad(window_no::VARCHAR, 4, '0'), phase || '_WINDOW', a, b, true, 1, regime, bench_pct FROM wins)"""


def results(keys: str, settings: str, fused: bool = False) -> str:
    """res: scores, window statistics and the metrics of research (train_) and hold-out (test_) by setting, from trades."""
    phases = ("RESEARCH", "SELECTION", "VALIDATION", "HOLDOUT")
    wanted = f"SELECT {keys}, segment_id, min_trades, phase, regime FROM ({settings}) s, segs"

    def stats(prefix, test):
        return f"count(*) FILTER ({test}) AS {prefix}windows, coalesce(avg(CASE WHEN total_return_pct > 0 THEN 1.0::DOUBLE ELSE 0 END) FILTER ({test}), 0) AS {prefix}positive_ratio, coalesce(median(total_return_pct) FILTER ({test}), 0) AS {prefix}median_return_pct, coalesce(min(total_return_pct) FILTER ({test}), 0) AS {prefix}worst_return_pct, coalesce(max(total_return_pct) FILTER ({test}), 0) AS {prefix}best_return_pct, coalesce(avg(total_return_pct) FILTER ({test}), 0) AS {prefix}avg_return_pct"

    window = "phase IN ('SELECTION_WINDOW', 'VALIDATION_WINDOW')"
    parts = ", ".join([stats("wf_", window), f"count(*) FILTER ({window} AND total_return_pct > 0) AS wf_positive_windows", stats("selection_", "phase = 'SELECTION_WINDOW'"), stats("validation_", "phase = 'VALIDATION_WINDOW'"), *(stats(f"{x.lower()}_", f"regime = '{x}'") for x in ("UP", "DOWN", "FLAT"))])
    wide = ", ".join(f"coalesce(max({c}) FILTER (segment_id = '{s}'), {-1e9 if c == 'score' else 0}) AS {s.lower()}__{c}" for s in phases for c in METRICS)

    def phase(s, prefix, least):
        f = f"{s.lower()}__"
        return f"CASE WHEN {f}trades < {least} OR {prefix}windows < 2 THEN -1e9 ELSE {f}total_return_pct / greatest({f}max_drawdown_pct, 2) * greatest(least({f}profit_factor, 3), 0) * sqrt(least({f}trades, 300) / 300.0::DOUBLE) * (0.20 + 0.80 * {prefix}positive_ratio) * (1 / (1 + greatest(-{prefix}worst_return_pct, 0) / 10)) * greatest(least(1 + {prefix}median_return_pct / 10, 1.8), 0.25) END"

    either = lambda c: f"CASE WHEN validation_windows > 0 THEN validation_{c} ELSE selection_{c} END"
    train = ", ".join(f"{s}__{c} AS {p}_{c}" for s, p in (("research", "train"), ("holdout", "test")) for c in METRICS)
    return f"""{metrics(keys, wanted, fused)},
res_0 AS (SELECT {keys}, {parts}, {wide} FROM met GROUP BY {keys}),
res_1 AS (SELECT *, {phase('SELECTION', 'selection_', max(6, MIN_TRADES // 2))} AS selection_score, {phase('VALIDATION', 'validation_', 1)} AS vs FROM res_0),
res_2 AS (SELECT *, CASE WHEN validation_windows >= 2 THEN vs ELSE selection_score END AS validation_score, {either('positive_ratio')} AS vpos, {either('median_return_pct')} AS vmed FROM res_1),
res AS (SELECT *, {train}, CASE WHEN least(selection_score, validation_score) <= -1e8 THEN -1e9 WHEN least(selection_score, validation_score) <= 0 THEN least(selection_score, validation_score) - 0.25 * abs(selection_score - validation_score)
  ELSE sqrt(selection_score * validation_score) * (1 / (1 + abs(selection_median_return_pct - vmed) / 8)) * (0.30 + 0.70 * least(selection_positive_ratio, vpos)) * (0.35 + 0.65 * sqrt(greatest(least(selection_score, validation_score) / greatest(selection_score, validation_score), 0))) END AS robust_score FROM res_2)"""


BASE_KEYS = "atr_period, mult_e4, mode"
SETTINGS = f"SELECT p AS atr_period, m AS mult_e4, mode FROM ({SWEEP}), (VALUES {', '.join(f'({m!r})' for m in MODES)}) v(mode)"
SWEPT = ",\n".join([ORDERS, TR, trend(SWEEP), "sig AS (SELECT p AS atr_period, m AS mult_e4, i, t FROM st)", runs("sig", "atr_period, mult_e4", "t", "i"), moded(), PLAN, SEGS, trades(BASE_KEYS, "atr_period"), results(BASE_KEYS, SETTINGS), "swept AS (SELECT 'BASE' AS strategy_type, 'ORDERS' AS symbol, 1440 AS tf, 'coarse' AS stage, * FROM res)"])

REGIME = dict(ema_fast=8, ema_slow=21, adx_period=14, adx_threshold=20.0, separation_atr=0.15, confirm_bars=3, min_hold_bars=6)


def ema(period: int, name: str) -> str:
    a = 2.0 / (period + 1.0)
    return f"{name}(i, v) AS (SELECT idx, c FROM tr WHERE idx = 0 UNION ALL SELECT k.idx, {a!r}::DOUBLE * k.c + (1.0::DOUBLE - {a!r}::DOUBLE) * {name}.v FROM {name} JOIN tr k ON k.idx = {name}.i + 1)"


def adx(p: int) -> str:
    last = 2 * p - 1
    return f"""dm AS MATERIALIZED (SELECT idx, CASE WHEN idx = 0 THEN 0 ELSE tr END AS tr, CASE WHEN h - ph > pl - l AND h - ph > 0 THEN h - ph ELSE 0 END AS up, CASE WHEN pl - l > h - ph AND pl - l > 0 THEN pl - l ELSE 0 END AS dn FROM tr),
ax(i, a, u, d, total, v) AS (SELECT 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE
  UNION ALL SELECT idx, na, nu, nd, CASE WHEN idx BETWEEN {p} AND {last} THEN total + dx ELSE total END, CASE WHEN idx < {last} THEN 0 WHEN idx = {last} THEN (total + dx) / {p} ELSE (v * {p - 1} + dx) / {p} END
  FROM (SELECT *, CASE WHEN na > 1e-12 AND 100.0::DOUBLE * nu / na + 100.0::DOUBLE * nd / na > 1e-12 THEN 100.0::DOUBLE * abs(100.0::DOUBLE * nu / na - 100.0::DOUBLE * nd / na) / (100.0::DOUBLE * nu / na + 100.0::DOUBLE * nd / na) ELSE 0 END AS dx
    FROM (SELECT k.idx, total, v, CASE WHEN k.idx <= {p} THEN a + k.tr ELSE a - a / {p} + k.tr END AS na, CASE WHEN k.idx <= {p} THEN u + k.up ELSE u - u / {p} + k.up END AS nu, CASE WHEN k.idx <= {p} THEN d + k.dn ELSE d - d / {p} + k.dn END AS nd FROM ax JOIN dm k ON k.idx = ax.i + 1)))"""


def regime_v2(q: dict = REGIME) -> str:
    p, k = q["adx_period"], max(2, q["confirm_bars"])
    return f"""{ema(q['ema_fast'], 'ef')}, {ema(q['ema_slow'], 'es')}, {adx(p)},
av(i, s, v) AS (SELECT 0::BIGINT, tr, NULL::DOUBLE FROM tr WHERE idx = 0 UNION ALL SELECT k.idx, av.s + k.tr, CASE WHEN k.idx = {p - 1} THEN (av.s + k.tr) / {p} WHEN k.idx >= {p} THEN ({p - 1} * av.v + k.tr) / {p} END FROM av JOIN tr k ON k.idx = av.i + 1),
rw AS MATERIALIZED (SELECT ef.i, CASE WHEN coalesce(av.v, 0) > 0 AND ax.v >= {q['adx_threshold']}::DOUBLE THEN CASE WHEN ef.v - es.v > {q['separation_atr']}::DOUBLE * av.v AND coalesce(es.v - es0.v, 0) >= 0 THEN 1 WHEN ef.v - es.v < -({q['separation_atr']}::DOUBLE * av.v) AND coalesce(es.v - es0.v, 0) <= 0 THEN -1 ELSE 0 END ELSE 0 END AS raw
  FROM ef JOIN es ON es.i = ef.i JOIN ax ON ax.i = ef.i JOIN av ON av.i = ef.i LEFT JOIN es es0 ON es0.i = ef.i - {k}),
rg(i, now, held, wait, seen) AS (SELECT -1::BIGINT, 0, 0, 0, 0 UNION ALL
  SELECT i, CASE WHEN raw <> now AND go THEN raw ELSE now END, CASE WHEN raw <> now AND go THEN 0 ELSE held + 1 END, CASE WHEN raw = now OR go THEN 0 ELSE raw END, CASE WHEN raw = now OR go THEN 0 ELSE n_seen END
  FROM (SELECT *, n_seen >= {q['confirm_bars']} AND (now = 0 OR held >= {q['min_hold_bars']}) AS go FROM (SELECT rw.i, rw.raw, rg.now, rg.held, CASE WHEN rw.raw = rg.wait THEN rg.seen + 1 ELSE 1 END AS n_seen FROM rg JOIN rw ON rw.i = rg.i + 1))),
regime AS MATERIALIZED (SELECT i AS idx, now AS regime FROM rg WHERE i >= 0)"""


LONG, SHORT = (12, 22000), (20, 31000)
ADAPTIVE = ",\n".join([ORDERS, TR, trend(f"SELECT * FROM (VALUES ({LONG[0]}, {LONG[1]}), ({SHORT[0]}, {SHORT[1]})) v(p, m)"), regime_v2(), f"""ad AS (SELECT 0 AS one, r.idx, CASE WHEN r.regime = 1 AND x.t = 1 THEN 1 WHEN r.regime = -1 AND y.t = -1 THEN -1 ELSE 0 END AS t FROM regime r JOIN st x ON x.i = r.idx AND x.p = {LONG[0]} AND x.m = {LONG[1]} JOIN st y ON y.i = r.idx AND y.p = {SHORT[0]} AND y.m = {SHORT[1]})""", runs("ad", "one", "t", "idx", "set_runs")])


def query(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{select}"
