"""The walk-forward plan: 21-day windows, their benchmark regime, and the selection, validation and hold-out bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.sources.candles import DAY_MS

from .indicators import SERIES

TEST_DAYS = 21
MIN_CANDLES = 400


def _bounds(candles: DataFrame) -> DataFrame:
    rising = F.col("timestamp") > F.coalesce(F.lag("timestamp").over(Window.partitionBy(*SERIES).orderBy("idx")), F.col("timestamp") - 1)
    df = candles.withColumn("_rising", F.coalesce(rising, F.lit(False))).groupBy(*SERIES).agg(F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"), F.count("*").alias("n"), F.bool_and("_rising").alias("_ok"))
    # a series with duplicate, missing or disordered times has no plan: it is an error, not a guess
    df = df.withColumn("n", F.when(F.col("_ok"), F.col("n")).otherwise(F.raise_error(F.concat(F.lit("timestamps do not rise strictly: "), F.col("symbol"))).cast("long"))).drop("_ok")
    df = df.where(F.col("n") >= MIN_CANDLES)
    days = F.greatest((F.col("last_ts") - F.col("first_ts")) / float(DAY_MS), F.lit(1.0))
    df = df.withColumn("total_days", days)
    df = df.withColumn("holdout_days", F.greatest(F.least(F.rint(F.col("total_days") * 0.2), F.lit(90.0)), F.lit(60.0)).cast("long"))
    df = df.withColumn("warmup_days", F.greatest(F.least(F.rint(F.col("total_days") * 0.3), F.lit(180.0)), F.lit(90.0)).cast("long"))
    df = df.withColumn("holdout_ms", F.col("last_ts") - F.col("holdout_days") * DAY_MS)
    late = F.col("first_ts") + F.col("warmup_days") * DAY_MS >= F.col("holdout_ms") - TEST_DAYS * DAY_MS
    df = df.withColumn("warmup_days", F.when(late, F.greatest((F.col("total_days") * 0.2).cast("long"), F.lit(45))).otherwise(F.col("warmup_days")))
    return df.withColumn("first_test", F.col("first_ts") + F.col("warmup_days") * DAY_MS)


def windows(candles: DataFrame) -> DataFrame:
    """Per series and kept window: window_no (kept ones, from 0), a, b, bench_pct, regime, phase. Candles meet their window by
    its number, an equality, not by a range."""
    b = _bounds(candles)
    span = TEST_DAYS * DAY_MS
    df = candles.select(*SERIES, "idx", "timestamp", "open", "close").join(b.select(*SERIES, "first_test", "holdout_ms"), list(SERIES))
    df = df.where(F.col("timestamp") >= F.col("first_test")).withColumn("no", F.floor((F.col("timestamp") - F.col("first_test")) / span))
    df = df.where(F.col("first_test") + (F.col("no") + 1) * span <= F.col("holdout_ms"))
    df = df.groupBy(*SERIES, "no").agg(F.min("idx").alias("a"), F.max("idx").alias("b"), F.min_by("open", "idx").alias("o"), F.max_by("close", "idx").alias("c")).where("b - a >= 20")
    df = df.withColumn("bench_pct", F.when(F.col("o") > 0, (F.col("c") / F.col("o") - 1.0) * 100.0).otherwise(0.0))
    df = df.withColumn("regime", F.when(F.col("bench_pct") >= 3.0, "UP").when(F.col("bench_pct") <= -3.0, "DOWN").otherwise("FLAT"))
    order = Window.partitionBy(*SERIES).orderBy("no")
    df = df.withColumns({"window_no": F.row_number().over(order) - 1, "w": F.count("*").over(Window.partitionBy(*SERIES))})
    chosen = F.when(F.col("w") >= 6, F.greatest(F.least(F.col("w") - 2, F.floor(F.col("w") * 0.65)), F.lit(4))).when(F.col("w") >= 4, F.greatest(F.col("w") - 2, F.lit(2))).otherwise(F.col("w"))
    return df.select(*SERIES, "window_no", "a", "b", "bench_pct", "regime", F.when(F.col("window_no") < chosen, "SELECTION").otherwise("VALIDATION").alias("phase"))


def plan(candles: DataFrame) -> DataFrame:
    """One row a series: the plan's bounds and day counts."""
    b = _bounds(candles)
    w = windows(candles).groupBy(*SERIES).agg(F.count("*").alias("windows"), F.min("a").alias("first_a"), F.min(F.when(F.col("phase") == "VALIDATION", F.col("a"))).alias("valid_a"))
    at = candles.join(b.select(*SERIES, "holdout_ms"), list(SERIES)).groupBy(*SERIES).agg(F.count(F.when(F.col("timestamp") < F.col("holdout_ms"), 1)).alias("h"))
    df = b.join(w, list(SERIES), "left").join(at, list(SERIES)).fillna(0, ["windows"])
    df = df.withColumn("holdout_start", F.greatest(F.least("h", F.col("n") - 2), F.lit(1)))
    df = df.withColumn("research_start", F.coalesce("first_a", F.greatest((F.col("n") * 0.35).cast("long"), F.lit(1))))
    df = df.withColumn("validation_start", F.coalesce("valid_a", "holdout_start"))
    df = df.withColumn("selection_end", F.greatest(F.col("research_start") + 2, F.col("validation_start") - 1))
    return df.select(*SERIES, "n", "total_days", "holdout_days", "warmup_days", "windows", "research_start", "selection_end", "validation_start", "holdout_start")


def segments(candles: DataFrame, min_trades: int = 24) -> DataFrame:
    """The plan as rows: segment_id, phase, start_idx, end_idx (exclusive for signals), raised (start at least the setting's
    period), min_trades, regime and bench_pct (windows only)."""
    p = plan(candles)
    n1 = F.col("n") - 1
    made = [("RESEARCH", "research_start", F.col("holdout_start") - 1, True, min_trades), ("SELECTION", "research_start", F.col("selection_end"), True, max(6, min_trades // 2)), ("VALIDATION", "validation_start", F.col("holdout_start") - 1, True, 1), ("HOLDOUT", "holdout_start", n1, False, 1)]
    rows = [F.struct(F.lit(name).alias("segment_id"), F.lit(name).alias("phase"), F.col(a).alias("start_idx"), e.cast("long").alias("end_idx"), F.lit(r).alias("raised"), F.lit(m).alias("min_trades")) for name, a, e, r, m in made]
    whole = p.select(*SERIES, "validation_start", "holdout_start", F.explode(F.array(*rows)).alias("s")).where("s.phase <> 'VALIDATION' or validation_start < holdout_start - 2")
    whole = whole.select(*SERIES, "s.*", F.lit(None).cast("string").alias("regime"), F.lit(None).cast("double").alias("bench_pct"))
    parts = windows(candles).select(*SERIES, F.format_string("W%04d", "window_no").alias("segment_id"), F.concat("phase", F.lit("_WINDOW")).alias("phase"), F.col("a").alias("start_idx"), F.col("b").alias("end_idx"), F.lit(True).alias("raised"), F.lit(1).alias("min_trades"), "regime", "bench_pct")
    return whole.unionByName(parts)


def whole_range(candles: DataFrame) -> DataFrame:
    """One segment FULL a series: from bar 0 to the last."""
    return candles.groupBy(*SERIES).agg(F.max("idx").alias("end_idx")).select(*SERIES, F.lit("FULL").alias("segment_id"), F.lit(0).cast("long").alias("start_idx"), "end_idx")
