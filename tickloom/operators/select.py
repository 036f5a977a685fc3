"""Ranking and selection: seeds, components, retention, the diversified top.

All rules hold inside a series (symbol, tf), but the diversified top's, which is over all. Retention is distinct-by-key,
top-k and ranks inside families: window ranks with a constant bound, which Spark cuts in every task before the shuffle.
The greedy rules ("skip what is near to a chosen one") depend on order: they run in Arrow groups, a group a series (or a
family of the top), over rows that retention has bounded. Nothing comes to the driver.

Defined cases: a null score counts as the lowest; ties go by key; an empty table gives an empty table; columns other than
those named pass through.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .indicators import SERIES
from .scoring import VALID

SCORES = ("selection_score", "validation_score", "robust_score")
BASE_KEY = ("symbol", "tf", "mode", "atr_period", "mult_e4")


def distinct_best(rows: DataFrame, keys=BASE_KEY) -> DataFrame:
    """Of rows with one key, that with the largest (selection, validation, robust); combined before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*SCORES)).alias("v")).select(*keys, "v.*").select(*rows.columns)


def retain(rows: DataFrame, limit: int, family=("mode",), keys=BASE_KEY) -> DataFrame:
    """Of each series with more than limit distinct rows, limit rows at most: leaders by each score and of each family, cut by
    the best of the three scores. Series with fewer keep all."""
    df = distinct_best(rows, keys)
    sizes = df.groupBy(*SERIES).agg(F.count("*").alias("_n"), F.countDistinct(*family).alias("_families"))
    df = df.join(sizes, list(SERIES))
    tie = [F.asc(k) for k in keys if k not in SERIES]
    many = df.where(F.col("_n") > limit)

    def leaders(by, group, most: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*SERIES, *group).orderBy(F.desc_nulls_last(by), *tie))
        return many.withColumn("_r", rank).where(F.col("_r") <= most)

    tops = [leaders(c, (), max(1, n)).drop("_r") for c, n in zip(SCORES, (limit // 2, limit // 4, limit // 4))]
    each = F.greatest(F.lit(25), F.floor(F.lit(limit) / F.greatest(F.lit(20), F.col("_families") * 8)))
    tops.append(leaders("selection_score", family, max(25, limit // 20)).where(F.col("_r") <= each).drop("_r"))
    union = tops[0]
    for t in tops[1:]:
        union = union.unionByName(t)
    best = Window.partitionBy(*SERIES).orderBy(F.desc_nulls_last("_best"), *tie)
    cut = union.dropDuplicates(list(keys)).withColumn("_best", F.greatest(*SCORES)).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= limit)
    return df.where(F.col("_n") <= limit).select(*rows.columns).unionByName(cut.select(*rows.columns))


def greedy(ranked: list[dict], near, limit: int, chosen: list[dict] | None = None) -> list[dict]:
    """The first rows, up to limit with those chosen before, that are near to none chosen."""
    chosen = list(chosen or [])
    for row in ranked:
        if len(chosen) >= limit:
            break
        if not any(near(row, c) for c in chosen):
            chosen.append(row)
    return chosen


def _ordered(pdf: pd.DataFrame, **by: bool) -> list[dict]:
    """Rows by columns, True: rising; nulls last."""
    return pdf.sort_values(list(by), ascending=list(by.values()), kind="stable").to_dict("records")


def _within(**reach):
    """Rows are near if each column is at most so far apart, and they have one mode."""
    return lambda a, b: a["mode"] == b["mode"] and all(abs(a[c] - b[c]) <= d for c, d in reach.items())


def _framed(rows: list[dict], like: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=like.columns)


def choose_seeds(rows: DataFrame, limit: int) -> DataFrame:
    """Of each series, seeds by selection score only: not within 2 periods and 0.5 of a chosen seed of their mode; if no row is
    valid, the first limit rows."""

    def rule(pdf: pd.DataFrame) -> pd.DataFrame:
        ranked = _ordered(pdf, selection_score=False, mode=False, atr_period=True, mult_e4=True)
        valid = [r for r in ranked if r["selection_score"] > VALID]
        return _framed(greedy(valid, _within(atr_period=2, mult_e4=5000), limit) or ranked[:limit], pdf)

    return rows.groupBy(*SERIES).applyInPandas(rule, rows.schema)


def top_up(rows: DataFrame, seeds: DataFrame, count: int) -> DataFrame:
    """Seeds, and more of mode BOTH by selection score until a series has count + max(6, count // 3): not within 6 periods and 0.35."""

    def rule(pdf: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        pool = pdf[(pdf["mode"] == "BOTH") & (pdf["selection_score"] > VALID)]
        more = _ordered(pool, selection_score=False, atr_period=True, mult_e4=True)
        return _framed(greedy(more, _within(atr_period=6, mult_e4=3500), max(len(chosen), count + max(6, count // 3)), chosen.to_dict("records")), pdf)

    return rows.groupBy(*SERIES).cogroup(seeds.toDF(*seeds.columns).groupBy(*SERIES)).applyInPandas(rule, rows.schema)


def components(rows: DataFrame, mode: str, limit: int) -> DataFrame:
    """Of each series, components of one mode by selection score plus how they did in rising (LONG) or falling (SHORT) windows:
    not within 2 periods and 0.18 of a chosen one."""
    side = "up" if mode == "LONG" else "down"

    def rule(pdf: pd.DataFrame) -> pd.DataFrame:
        pool = pdf[(pdf["mode"] == mode) & (pdf["selection_score"] > VALID)]
        key = pool["selection_score"] + 0.6 * pool[f"{side}_positive_ratio"] + pool[f"{side}_avg_return_pct"] / 35.0
        ranked = _ordered(pool.assign(_key=key), _key=False, atr_period=True, mult_e4=True)
        return _framed(greedy(ranked, _within(atr_period=2, mult_e4=1800), limit), pdf)

    return rows.groupBy(*SERIES).applyInPandas(rule, rows.schema)


#: How far apart rows of one family may be and still count as near, by type; and columns in which they must be equal.
_REACH = {"BASE": {"atr_period": 1, "mult_e4": 1200}}
_SIDES = {"long_atr_period": 1, "long_mult_e4": 1000, "short_atr_period": 1, "short_mult_e4": 1000}
_V2 = {"ema_fast": 0, "ema_slow": 0, "adx_threshold": 5, "separation_atr": 0.15}


def _near_top(a: dict, b: dict) -> bool:
    reach = _REACH.get(a["strategy_type"]) or (_SIDES | _V2 if a["strategy_type"] == "ADAPTIVE_V2" else _SIDES)
    return all(abs(a[c] - b[c]) <= d for c, d in reach.items())


def diversified_top(rows: DataFrame, limit: int = 100, keys=("strategy_type", *BASE_KEY)) -> DataFrame:
    """Two of each family (type, timeframe and symbol, mode), then the best of all that are near to none chosen, then any; by
    robust score.

    Rows are near to rows of their own family only, so each family's greedy order does not depend on the others: a group a
    family numbers it, and one top-k over (stage, order) makes the choice.
    """
    family = ("strategy_type", "tf", "symbol", "mode")
    order = {"robust_score": False, "validation_score": False, "selection_score": False} | {k: True for k in keys}
    once = Window.partitionBy(*keys).orderBy(*(F.desc_nulls_last(c) for c in SCORES[::-1]))
    valid = rows.where(F.col("robust_score") > VALID).withColumn("_r", F.row_number().over(once)).where("_r = 1").drop("_r")
    schema = valid.withColumn("_g", F.lit(None).cast("int")).schema

    def rule(pdf: pd.DataFrame) -> pd.DataFrame:
        ranked = [r | {"_i": i} for i, r in enumerate(_ordered(pdf, **order))]
        place = {r["_i"]: g for g, r in enumerate(greedy(ranked, _near_top, limit))}
        kept = [r | {"_g": place.get(r["_i"])} for r in ranked if r["_i"] in place or r["_i"] < limit]
        out = pd.DataFrame(kept, columns=[*pdf.columns, "_g"])
        return out.assign(_g=out["_g"].astype("Int32"))

    numbered = valid.groupBy(*family).applyInPandas(rule, schema)
    early, g = F.col("_g") < 2, F.col("_g")
    stage = F.when(early, 0).when(g.isNotNull(), 1).otherwise(2)
    first = [stage, *(F.when(early, F.col(c)) for c in family), F.when(early, g)]
    rank = [F.col(c).asc() if rising else F.col(c).desc_nulls_last() for c, rising in order.items()]
    return numbered.orderBy(*first, *rank).limit(limit).select(*rows.columns).orderBy(F.desc("robust_score"), *rank)
