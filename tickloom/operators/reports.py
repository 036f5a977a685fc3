"""Report views over flat results: summaries, coverage, clusters, neighbourhoods, flags, regime diagnostics, pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .indicators import SERIES
from .scoring import VALID


def _ratio(test: Column) -> Column:
    return F.coalesce(F.avg(F.when(test, 1.0).when(~test, 0.0)), F.lit(0.0))


def _median(value: Column) -> Column:
    return F.coalesce(F.median(value), F.lit(0.0))


def strict() -> Column:
    return (F.col("test_profit_factor") > 1) & (F.col("test_max_drawdown_pct") <= 20) & (F.col("test_trades") >= 5)


def survives() -> Column:
    return (F.col("train_total_return_pct") > 0) & (F.col("test_total_return_pct") > 0)


def strategy_summary(results: DataFrame) -> DataFrame:
    valid = F.col("robust_score") > VALID
    only = lambda c: F.when(valid, F.col(c))
    count = lambda c: F.count(F.when(c, 1))
    return results.groupBy("strategy_type", "tf").agg(
        F.count("*").alias("candidates"), count(valid).alias("valid_candidates"), _ratio(only("selection_score") > 0).alias("selection_positive_ratio"), _ratio(only("validation_score") > 0).alias("validation_positive_ratio"),
        _ratio(only("test_total_return_pct") > 0).alias("holdout_positive_ratio"), count(valid & survives()).alias("survivors"), count(valid & survives() & strict()).alias("strict_survivors"),
        _median(only("validation_median_return_pct")).alias("median_validation_window_pct"), _median(only("test_total_return_pct")).alias("median_holdout_pct"), F.coalesce(F.max(only("test_total_return_pct")), F.lit(0.0)).alias("best_holdout_pct"),
    )


def survivors(results: DataFrame) -> DataFrame:
    """Ordered by strict survival, validation score and hold-out return."""
    df = results.where((F.col("robust_score") > VALID) & survives()).withColumn("strict_survivor", strict())
    return df.orderBy(F.desc("strict_survivor"), F.desc("validation_score"), F.desc("test_total_return_pct"))


def parameter_coverage(results: DataFrame) -> DataFrame:
    """Of BASE rows, per type, timeframe and stage: ranges and numbers of distinct values, and the modes."""
    df = results.where("strategy_type = 'BASE'")
    return df.groupBy("strategy_type", "tf", "stage").agg(
        F.count("*").alias("candidates"), F.min("atr_period").alias("atr_min"), F.max("atr_period").alias("atr_max"), F.countDistinct("atr_period").alias("atr_unique"),
        F.min("mult_e4").alias("mult_min"), F.max("mult_e4").alias("mult_max"), F.countDistinct("mult_e4").alias("mult_unique"), F.array_join(F.sort_array(F.collect_set("mode")), ",").alias("modes"),
    )


def regime_coverage(results: DataFrame) -> DataFrame:
    """Of adaptive rows, per type, timeframe and stage: numbers of distinct EMA pairs, ADX settings and whole regime settings."""
    regime = ("ema_fast", "ema_slow", "adx_period", "adx_threshold", "separation_atr", "confirm_bars", "min_hold_bars")
    df = results.where("strategy_type <> 'BASE'")
    return df.groupBy("strategy_type", "tf", "stage").agg(F.count("*").alias("candidates"), F.countDistinct("ema_fast", "ema_slow").alias("ema_pairs"), F.countDistinct("adx_period", "adx_threshold").alias("adx_configs"), F.countDistinct(*regime).alias("regime_configs"))


def cluster_landscape(results: DataFrame, least: int = 3) -> DataFrame:
    """Buckets of 10 periods and 0.25 (multiplier, half to even) with at least ``least`` members; mult_bucket in units of 1/10000."""
    df = results.where((F.col("strategy_type") == "BASE") & (F.col("selection_score") > VALID))
    df = df.withColumns({"atr_bucket": (F.floor(F.col("atr_period") / 10) * 10).cast("long"), "mult_bucket": (F.rint(F.col("mult_e4") / 2500.0) * 2500).cast("long")})
    df = df.groupBy("tf", "mode", "atr_bucket", "mult_bucket").agg(
        F.count("*").alias("members"), _ratio(F.col("selection_score") > 0).alias("selection_positive_ratio"), _ratio(F.col("validation_score") > 0).alias("validation_positive_ratio"), _median(F.col("selection_score")).alias("median_selection_score"),
        _median(F.col("validation_score")).alias("median_validation_score"), _median(F.col("validation_median_return_pct")).alias("median_validation_window_pct"), _ratio(F.col("test_total_return_pct") > 0).alias("holdout_positive_ratio"), _median(F.col("test_total_return_pct")).alias("median_holdout_pct"),
    )
    return df.where(F.col("members") >= least).orderBy(F.desc("validation_positive_ratio"), F.desc("median_validation_score"), F.desc("members"))


def ranked_top(results: DataFrame, limit: int) -> DataFrame:
    """The first rows by (robust, validation, selection), numbered from 1; ties by period, multiplier and mode."""
    order = [F.desc("robust_score"), F.desc("validation_score"), F.desc("selection_score"), F.asc("atr_period"), F.asc("mult_e4"), F.asc("mode")]
    return results.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


#: How far neighbours of a top row may be, by type, unless the caller says otherwise.
REACH = {"BASE": {"atr_period": 3, "mult_e4": 2500}, "ADAPTIVE": {"long_atr_period": 2, "long_mult_e4": 1500, "short_atr_period": 2, "short_mult_e4": 1500}}


def neighbour_stability(results: DataFrame, top: DataFrame, reach: dict | None = None) -> DataFrame:
    """Of each top row, how its valid neighbours did: rows of its type, series and mode within reach in every parameter. Adaptive
    types share one rule and need its columns. top has at most 50 rows, so the join is by its small side."""
    reach = REACH | (reach or {})
    group = ["strategy_type", *SERIES, "mode"]
    valid = results.where(F.col("robust_score") > VALID)
    near = None
    for kind, columns in reach.items():
        if not set(columns) <= set(results.columns):
            continue
        own = F.col("strategy_type") == "BASE" if kind == "BASE" else F.col("strategy_type") != "BASE"
        a = top.where(own).select("rank", *group, *(F.col(c).alias(f"_{c}") for c in columns))
        met = valid.where(own).join(F.broadcast(a), group)
        for c, far in columns.items():
            met = met.where(F.abs(F.col(c) - F.col(f"_{c}")) <= far)
        met = met.select("rank", *(c for c in ("selection_score", "validation_score", "test_total_return_pct")))
        near = met if near is None else near.unionByName(met)
    found = near.groupBy("rank").agg(
        F.count("*").alias("neighbours"), _ratio(F.col("selection_score") > 0).alias("selection_positive_ratio"), _ratio(F.col("validation_score") > 0).alias("validation_positive_ratio"),
        _ratio(F.col("test_total_return_pct") > 0).alias("holdout_positive_ratio"), _median(F.col("validation_score")).alias("median_validation_score"), _median(F.col("test_total_return_pct")).alias("median_holdout_pct"),
    )
    params = [c for columns in reach.values() for c in columns if c in top.columns]
    return top.select("rank", *group, *dict.fromkeys(params)).join(found, "rank", "left").fillna(0, found.columns[1:])


def overfit_flags(results: DataFrame, limit: int = 2000) -> DataFrame:
    """The leaders by selection score that have a reason for doubt, reasons joined by a semicolon."""
    df = results.where(F.col("selection_score") > VALID).orderBy(F.desc("selection_score"), "atr_period", "mult_e4", "mode").limit(limit)
    flags = F.concat_ws(
        ";",
        F.when((F.col("selection_score") > 0) & (F.col("validation_score") <= 0), "selection_positive_validation_nonpositive"),
        F.when((F.col("selection_median_return_pct") > 0) & (F.col("validation_median_return_pct") < 0), "median_sign_flip"),
        F.when(F.col("validation_positive_ratio") < 0.5, "less_than_half_validation_windows_positive"),
        F.when(F.col("test_total_return_pct") < 0, "holdout_negative"),
    )
    return df.withColumn("flags", flags).where("flags <> ''").select("strategy_type", "tf", "mode", "stage", "atr_period", "mult_e4", "selection_score", "validation_score", "robust_score", "test_total_return_pct", "flags")


def heatmap(results: DataFrame, value: str = "robust_score", modes=("BOTH", "LONG", "SHORT")) -> DataFrame:
    """The best value by (tf, atr_period, mult_e4), a column a mode."""
    df = results.groupBy("tf", "atr_period", "mult_e4").pivot("mode", list(modes)).agg(F.max(value))
    return df.select("tf", "atr_period", "mult_e4", *(F.col(m).alias(m.lower()) for m in modes))


def regime_parts(plan: DataFrame) -> DataFrame:
    """The plan's three parts as inclusive index ranges."""
    last = lambda a, b: F.greatest(F.col(a), F.col(b) - 1)
    rows = [("SELECTION", F.col("research_start"), last("research_start", "validation_start")), ("VALIDATION", F.col("validation_start"), last("validation_start", "holdout_start")), ("HOLDOUT", F.col("holdout_start"), F.col("n") - 1)]
    made = F.array(*(F.struct(F.lit(p).alias("part"), a.cast("long").alias("a"), b.cast("long").alias("b")) for p, a, b in rows))
    return plan.select(*SERIES, F.explode(made).alias("x")).select(*SERIES, "x.*")


def regime_mix(regime: DataFrame, plan: DataFrame) -> DataFrame:
    """Of each part: shares of the three states and the number of switches inside it."""
    df = regime.join(regime_parts(plan), list(SERIES)).where("idx >= a and idx <= b")
    change = (F.col("regime") != F.lag("regime").over(Window.partitionBy(*SERIES, "part").orderBy("idx"))).cast("int")
    df = df.withColumn("_c", F.coalesce(change, F.lit(0)))
    share = lambda s: F.avg(F.when(F.col("regime") == s, 1.0).otherwise(0.0))
    return df.groupBy(*SERIES, "part").agg(share(1).alias("up_ratio"), share(-1).alias("down_ratio"), share(0).alias("flat_ratio"), F.sum("_c").alias("switches"))


def regime_samples(candles: DataFrame, regime: DataFrame, points: int = 400) -> DataFrame:
    """Every max(1, n // points)-th bar with its close and state."""
    n = candles.groupBy(*SERIES).agg(F.greatest(F.floor(F.count("*") / points), F.lit(1)).alias("_step"))
    df = candles.join(regime, [*SERIES, "idx"]).join(n, list(SERIES)).where(F.col("idx") % F.col("_step") == 0)
    return df.select(*SERIES, "idx", "timestamp", "close", F.when(F.col("regime") == 1, "UP").when(F.col("regime") == -1, "DOWN").otherwise("FLAT").alias("state"))


def audit_segments(plan: DataFrame) -> DataFrame:
    """The parts as segments for a trade audit."""
    return regime_parts(plan).select(*SERIES, F.col("part").alias("segment_id"), F.col("a").alias("start_idx"), F.col("b").alias("end_idx"))


def keyed_union(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both; of one key, the first table's row."""
    df = first.withColumn("_o", F.lit(0)).unionByName(second.withColumn("_o", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_o")
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_o", "_r")


def snapshot(top: DataFrame) -> DataFrame:
    """rank and a JSON document of each row."""
    return top.select("rank", F.to_json(F.struct(*[c for c in top.columns if c != "rank"])).alias("document"))


def summary(results: DataFrame) -> DataFrame:
    """One row of totals."""
    count = lambda c: F.count(F.when(c, 1))
    valid = F.col("robust_score") > VALID
    return results.agg(F.count("*").alias("candidates"), count(valid).alias("valid_candidates"), count(F.isnan("robust_score")).alias("nan_scores"), count(valid & survives()).alias("survivors"), count(valid & survives() & strict()).alias("strict_survivors"))
