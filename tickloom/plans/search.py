"""The coarse-to-fine search: stages on the driver, each one Spark job over all its candidates.

Coarse grid, breadth probes, then boxes around seeds (fine, cluster_wide, cluster_deep) that see selection scores only,
then adaptive settings (long component x short component x regime). Each stage leaves out what earlier ones tried, is
written to the store as one unit, and is skipped on resume.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import backtest, evaluate, grid, indicators, select, walkforward
from tickloom.sources.store import Store, signature
from tickloom.sources.written import stash

KEYS = ["atr_period", "mult_e4", "mode"]
ADAPTIVE_KEYS = ["long_atr_period", "long_mult_e4", "short_atr_period", "short_mult_e4", "regime_id"]
RETAIN = 3500
MIN_WINDOWS = 4


@dataclass(frozen=True)
class Config:
    """What a run depends on. fee and slippage are shares of the price, each side; percent text is parsed by ``percent``."""

    depth: str = "deep"
    months: int = 18
    fee: float = 0.00055
    slippage: float = 0.0002
    retain: int = RETAIN

    def __post_init__(self):
        if self.depth not in grid.PRESETS:
            raise ValueError(f"depth is one of {sorted(grid.PRESETS)}")
        if not (0 <= self.fee <= 0.02 and 0 <= self.slippage <= 0.02):
            raise ValueError("fee and slippage are between 0 and 0.02")
        if self.months < 1:
            raise ValueError("months is at least 1")

    @property
    def min_trades(self) -> int:
        return max(24, int(self.months * 2.2))


def percent(text: str) -> float:
    """A percentage as typed, with point or comma, as a share."""
    return float(text.strip().replace(",", ".")) / 100.0


def _stage(store: Store, name: str, candidates: DataFrame, candles: DataFrame, segments: DataFrame, config: Config) -> DataFrame:
    """Evaluate a stage's candidates (or read them, if the store has them) and return its retained rows."""
    if not store.complete("all", name):
        candidates = stash(candidates, "candidates")
        runs = backtest.with_mode(stash(indicators.trend_runs(candles, candidates), "runs"), candidates)
        rows = evaluate.evaluate(runs, candidates, KEYS, segments, candles, config.fee, config.slippage, config.min_trades, "atr_period")
        rows = rows.withColumns({"strategy_type": F.lit("BASE"), "stage": F.lit(name)})
        per = segments.groupBy("symbol", "tf").agg(F.count("*").alias("_s"))
        checks = candidates.join(per, ["symbol", "tf"]).agg(F.coalesce(F.sum("_s"), F.lit(0))).first()[0]  # a setting and a segment of its series
        store.queue("all", name, "grid", rows, checks)
        written = store.spark.read.parquet(f"{store.folder}/data/{store.manifest['units'][f'all|{name}|grid']['folder']}")
        store.save_seed("all", name, select.retain(written, config.retain), checks=checks)
    return store.load_seed("all", name)


def adaptive(candles: DataFrame, longs: DataFrame, shorts: DataFrame, regimes: DataFrame, segments: DataFrame, config: Config) -> DataFrame:
    """All long x short x regime settings. Trends are made once a component and regimes once a configuration; each component
    meets each regime once; a setting then is two tables of runs, by equality."""
    settings = grid.adaptive_product(longs, shorts, regimes)
    keys = stash(settings.select("symbol", "tf", *ADAPTIVE_KEYS), "adaptive-settings")
    regime = stash(indicators.regime_runs(candles, regimes), "regime-runs")

    def parts(components: DataFrame, name: str, side: int) -> DataFrame:
        own = [f"{name}_atr_period", f"{name}_mult_e4"]
        trend = indicators.trend_runs(candles, components.withColumn("mode", F.lit("BOTH"))).withColumnsRenamed({"atr_period": own[0], "mult_e4": own[1]})
        met = stash(indicators.meet_runs(trend, regime, side, []), f"{name}-parts")
        return met.join(keys, ["symbol", "tf", "regime_id", *own]).select("symbol", "tf", *ADAPTIVE_KEYS, "first_idx", "last_idx", "side")

    runs = parts(longs, "long", 1).unionByName(parts(shorts, "short", -1))
    rows = evaluate.evaluate(runs, keys, ADAPTIVE_KEYS, segments, candles, config.fee, config.slippage, config.min_trades, fused=True)
    return rows.join(settings.drop("id"), ["symbol", "tf", *ADAPTIVE_KEYS]).withColumns({"strategy_type": F.lit("ADAPTIVE_V2"), "stage": F.lit("adaptive_v2"), "mode": F.lit("ADAPTIVE"), "atr_period": F.lit(0), "mult_e4": F.lit(0).cast("long")})


class Stopped(Exception):
    """The caller asked for the search to stop; the store is left to be resumed."""


class Progress:
    """Told after every stage: the stage, how many checks the store has and how many a second were made since the start."""

    def __init__(self, stop=None, tell=None):
        self.stop, self.tell, self.began, self.before = stop, tell, time.monotonic(), None

    def stage(self, name: str, store: Store) -> None:
        done = store.summary()["checks"]
        self.before = done if self.before is None else self.before
        if self.tell:
            self.tell({"stage": name, "checks": done, "rate": (done - self.before) / max(1e-9, time.monotonic() - self.began)})
        if self.stop and self.stop():
            raise Stopped(name)


def run(spark: SparkSession, candles: DataFrame, root: str, config: Config = Config(), preset: grid.Preset | None = None, stop=None, tell=None) -> dict[str, DataFrame]:
    """The whole search. stop, asked between stages, ends it where it can be resumed; tell gets a dict after every stage. Returns ``base`` (retained base rows), ``adaptive`` (retained adaptive rows) and ``top``; the store at
    root keeps every result and lets an interrupted run go on where it stopped."""
    preset = preset or grid.PRESETS[config.depth]
    plan = walkforward.plan(candles).where(F.col("windows") >= MIN_WINDOWS)
    fit = stash(plan.select("symbol", "tf", "holdout_start"), "series")
    if not fit.limit(1).count():
        raise ValueError(f"no series has {MIN_WINDOWS} walk-forward windows")
    candles = stash(candles.join(F.broadcast(fit.select("symbol", "tf")), ["symbol", "tf"]), "candles")
    segments = stash(walkforward.segments(candles, config.min_trades), "segments")
    store = Store(spark, root, signature(config.__dict__ | {"preset": str(preset)}, candles), config.__dict__)
    each = lambda g: g.crossJoin(F.broadcast(fit)).where("atr_period < holdout_start").drop("holdout_start")
    progress = Progress(stop, tell)
    try:
        progress.stage("start", store)
        tried = [each(grid.coarse(spark, preset))]
        rows = _stage(store, "coarse", tried[0], candles, segments, config)
        progress.stage("coarse", store)
        tried.append(each(grid.breadth(spark, preset)))
        rows = rows.unionByName(_stage(store, "breadth", tried[1], candles, segments, config))
        progress.stage("breadth", store)
        for name, box in (("fine", preset.fine), ("cluster_wide", preset.wide), ("cluster_deep", preset.deep)):
            seeds = stash(select.choose_seeds(rows, box.seeds), "seeds")
            if name == "cluster_wide":
                seeds = select.top_up(rows, seeds, box.seeds)
            candidates = grid.untried(grid.around(seeds, box), *tried)
            tried.append(candidates)
            rows = rows.unionByName(_stage(store, name, candidates, candles, segments, config))
            progress.stage(name, store)
        base = select.retain(rows, config.retain * 2)
        if not store.complete("all", "adaptive_v2"):
            longs, shorts = (select.components(base, m, preset.components) for m in ("LONG", "SHORT"))
            made = adaptive(candles, longs, shorts, grid.regime_grid(spark, preset.regimes), segments, config)
            store.queue("all", "adaptive_v2", "grid", made, 0)
            written = store.results().where("strategy_type = 'ADAPTIVE_V2'")
            store.save_seed("all", "adaptive_v2", select.retain(written, config.retain, ("strategy_type",), ("symbol", "tf", *ADAPTIVE_KEYS)))
        found = store.load_seed("all", "adaptive_v2")
        every = base.unionByName(found, allowMissingColumns=True)
        top = select.diversified_top(every, 100, ("strategy_type", *select.BASE_KEY, *ADAPTIVE_KEYS))
        store.save_seed("all", "top", top)
        store.finish()
        return {"base": base, "adaptive": found, "top": store.load_seed("all", "top")}
    except BaseException:
        store.finish("stopped")
        raise
