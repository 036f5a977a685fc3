"""Parameter grids: coarse grids, breadth probes, boxes around seeds, regime grids, adaptive products, and what was tried.

Multipliers are integers in units of 1/10000 (mult_e4), so grids meet by equality. Values come from rules, on the driver;
products and differences are joins.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODES = ("BOTH", "LONG", "SHORT")


def steps(low: float, high: float, step: float) -> list[int]:
    """low, low + step, ... up to high, in units of 1/10000."""
    return sorted({int(round(float(x) * 10000)) for x in np.arange(low, high + 1e-4, step)})


@dataclass(frozen=True)
class Box:
    """A refinement stage: how many seeds, and how far and finely around each."""

    seeds: int
    periods: int
    reach: float
    step: float
    low: float
    high: float


@dataclass(frozen=True)
class Preset:
    """A search depth."""

    periods: range
    mults: list[int]
    probes: list[tuple[range, list[int], tuple[str, ...]]]
    fine: Box
    wide: Box
    deep: Box
    components: int
    regimes: dict = field(default_factory=dict)


# The three depths.
PRESETS = {
    "standard": Preset(
        range(2, 181, 4), steps(0.4, 9.0, 0.20),
        [(range(30, 141, 5), steps(1.5, 4.0, 0.10), ("BOTH",)), (range(2, 13), steps(6.0, 10.0, 0.10), ("BOTH",)), (range(150, 241, 10), steps(0.5, 10.0, 0.50), MODES)],
        Box(28, 4, 0.40, 0.05, 0.15, 16.0), Box(12, 10, 0.70, 0.05, 0.12, 18.0), Box(8, 3, 0.12, 0.01, 0.10, 20.0), 5,
        {"ema": [(8, 21), (12, 26), (20, 50)], "adx_period": [14], "adx_threshold": [18, 25], "separation_atr": [0.10, 0.25], "confirm_bars": [2], "min_hold_bars": [3, 6]},
    ),
    "deep": Preset(
        range(2, 242, 6), steps(0.30, 12.0, 0.10),
        [(range(30, 181, 2), steps(1.2, 4.5, 0.05), ("BOTH",)), (range(2, 19), steps(5.5, 11.0, 0.05), ("BOTH",)), (range(180, 301, 5), steps(0.5, 12.0, 0.25), MODES)],
        Box(30, 3, 0.30, 0.025, 0.15, 16.0), Box(12, 6, 0.45, 0.025, 0.12, 18.0), Box(8, 2, 0.08, 0.005, 0.10, 20.0), 4,
        {"ema": [(6, 18), (8, 21), (12, 26), (20, 50)], "adx_period": [10, 14], "adx_threshold": [15, 20, 25], "separation_atr": [0.10, 0.25], "confirm_bars": [2, 3], "min_hold_bars": [4, 8]},
    ),
    "maximum": Preset(
        range(2, 321, 2), steps(0.25, 14.0, 0.05),
        [(range(20, 241), steps(1.0, 5.0, 0.015), ("BOTH",)), (range(2, 21), steps(5.0, 12.5, 0.015), ("BOTH",)), (range(220, 401, 3), steps(0.3, 14.0, 0.10), MODES)],
        Box(180, 8, 0.70, 0.015, 0.15, 16.0), Box(70, 24, 1.30, 0.015, 0.12, 18.0), Box(45, 7, 0.28, 0.0025, 0.10, 20.0), 12,
        {"ema": [(5, 13), (6, 18), (8, 21), (12, 26), (20, 50), (30, 80)], "adx_period": [8, 10, 14, 20], "adx_threshold": [12, 15, 18, 20, 25, 30], "separation_atr": [0.0, 0.08, 0.15, 0.25, 0.40], "confirm_bars": [2, 3, 4], "min_hold_bars": [3, 6, 12]},
    ),
}


def _column(spark: SparkSession, name: str, values, kind: str) -> DataFrame:
    made = F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")
    return spark.range(1).select(F.explode(made).alias(name))


def product(spark: SparkSession, periods, mults, modes=MODES) -> DataFrame:
    """atr_period x mult_e4 x mode: values of bounded number, so the cross join is the grid itself."""
    return _column(spark, "atr_period", periods, "int").crossJoin(_column(spark, "mult_e4", mults, "bigint")).crossJoin(_column(spark, "mode", modes, "string"))


def coarse(spark: SparkSession, preset: Preset, below: int | None = None) -> DataFrame:
    return product(spark, [p for p in preset.periods if below is None or p < below], preset.mults)


def breadth(spark: SparkSession, preset: Preset, below: int | None = None) -> DataFrame:
    """The probes (distinct), less the coarse grid."""
    parts = [product(spark, [p for p in periods if below is None or p < below], mults, modes) for periods, mults, modes in preset.probes]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return untried(union.distinct(), coarse(spark, preset, below))


def untried(candidates: DataFrame, *tried: DataFrame) -> DataFrame:
    """Candidates of no earlier stage (anti-joins on the whole key)."""
    keys = [c for c in ("symbol", "tf", "atr_period", "mult_e4", "mode") if c in candidates.columns]
    for t in tried:
        candidates = candidates.join(t.select(*keys), keys, "left_anti")
    return candidates


def around(seeds: DataFrame, box: Box) -> DataFrame:
    """Every period and multiplier of the box around each seed, with the seed's mode; distinct. A box starts at its lower
    end, clamped, and goes up by steps."""
    e4 = lambda x: int(round(x * 10000))
    low = F.greatest(F.lit(e4(box.low)), F.col("mult_e4") - e4(box.reach)).cast("long")
    high = F.least(F.lit(e4(box.high)), F.col("mult_e4") + e4(box.reach)).cast("long")
    df = seeds.withColumn("atr_period", F.explode(F.sequence(F.greatest(F.lit(2), F.col("atr_period") - box.periods), F.col("atr_period") + box.periods)))
    df = df.withColumn("mult_e4", F.explode(F.sequence(low, high, F.lit(e4(box.step)).cast("long"))))
    return df.select(*(c for c in ("symbol", "tf", "atr_period", "mult_e4", "mode") if c in df.columns)).distinct()


def regime_grid(spark: SparkSession, regimes: dict) -> DataFrame:
    """All regime settings with ema_fast < ema_slow, numbered by regime_id in the order of their values."""
    pairs = F.array(*[F.struct(F.lit(a).alias("ema_fast"), F.lit(b).alias("ema_slow")) for a, b in regimes["ema"]])
    df = spark.range(1).select(F.explode(pairs).alias("p")).select("p.*").where("ema_fast < ema_slow")
    for name, kind in (("adx_period", "int"), ("adx_threshold", "double"), ("separation_atr", "double"), ("confirm_bars", "int"), ("min_hold_bars", "int")):
        df = df.crossJoin(_column(spark, name, regimes[name], kind))
    from pyspark.sql import Window

    return df.withColumn("regime_id", (F.row_number().over(Window.orderBy(*df.columns)) - 1).cast("long"))


def adaptive_product(longs: DataFrame, shorts: DataFrame, regimes: DataFrame) -> DataFrame:
    """Long components x short components x regimes of each series; components are at most a preset's number."""
    side = lambda df, s: df.select("symbol", "tf", F.col("atr_period").alias(f"{s}_atr_period"), F.col("mult_e4").alias(f"{s}_mult_e4"))
    return side(longs, "long").join(side(shorts, "short"), ["symbol", "tf"]).crossJoin(regimes)
