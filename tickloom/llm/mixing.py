"""Mixing sources to target weights (operator 6), in DataFrame functions only.

Targets: sources in code-point order (null last) weigh 1, 2, 3, 1, 2, 3, ... and share the words of the whole corpus;
a target stops at MAX_EPOCHS times its source's words, and what exceeds that is shared again by weight. That is a
water level, found in closed form on the table of sources: sorted by cap / weight, the level after each prefix of
capped sources is one division.

Selection: every document first takes the complete epochs its source's target holds; the rest of the target is taken
by Efraimidis-Spirakis sampling without replacement. A document's key is -ln(u) / w, u an MD5 uniform of its doc_id
and w its quality weight; in rising key order, words are taken until the budget is used, the last document in part.
So a source takes its target to the word and no document more than MAX_EPOCHS times its size.

Prefix sums run in slices of a source (common.running_total), so a source that holds a third of all rows is spread
over many tasks. Keys depend on doc_id and text only, so reruns agree; rows equal in key, doc_id and size are
interchangeable. A null text has size 0 and takes 0; null sources form one source of their own; an empty table gives
an empty result. Other columns are ignored unless named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, running_total, stash, uniform

MAX_EPOCHS = 3
WEIGHT_CYCLE = 3
SEED = "mix"
#: Quality weights lie between these.
LEAST_WEIGHT, MOST_WEIGHT = 0.5, 1.0
#: A document whose text has this share of marks or more has the least weight.
WORST_MARK_SHARE = 0.1
MARKS = "#*$%&|<>!"


def quality_weight(text: Column) -> Column:
    """From MOST_WEIGHT for a text without marks down to LEAST_WEIGHT; integer arithmetic up to one division."""
    n = F.char_length(text)
    marks = n - F.char_length(F.translate(text, MARKS, ""))
    share = F.least(marks / F.greatest(n, F.lit(1)) / WORST_MARK_SHARE, F.lit(1.0))
    return F.lit(MOST_WEIGHT) - share * (MOST_WEIGHT - LEAST_WEIGHT)


def source_targets(sizes: DataFrame) -> DataFrame:
    """From one row a source (source, source_size): its target. The table of sources is small; windows run over it as a whole."""
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    df = sizes.withColumn("weight", ((F.row_number().over(ordered) - 1) % WEIGHT_CYCLE + 1).cast("long"))
    df = df.withColumn("cap", (F.col("source_size") * MAX_EPOCHS).cast("long")).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    capped = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumn("level", (F.sum("source_size").over(everything) - capped) / left)
    df = df.withColumn("level", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "source", "level"))).over(everything)["level"])
    return df.select("source", "source_size", F.when(F.col("ratio") <= F.col("level"), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def mix(docs: DataFrame) -> DataFrame:
    """The operator: doc_id, source, size, source_size, target, epochs (complete ones), taken (words, repeats counted) of every row."""
    text = F.coalesce("text", F.lit(""))
    sized = stash(docs.select("doc_id", "source", n_words(text).alias("size"), quality_weight(text).alias("w")), "mix-sizes")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    keyed = sized.withColumn("key", -F.log(uniform(F.col("doc_id"), SEED)) / F.col("w"))
    spread = F.least(F.lit(1.0) - F.exp(-F.col("key") * LEAST_WEIGHT), F.lit(0.9999999))
    summed = running_total(keyed, ["source"], spread, ["key", "doc_id", "size"], "size", "before")
    df = summed.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.doc_id", "d.source", "d.size", "d.before", "t.source_size", "t.target")
    df = df.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    budget = F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    part = F.greatest(F.least(budget - F.col("before"), F.col("size")), F.lit(0))
    return df.select("doc_id", "source", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


def op6_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


#: DuckDB SQL for op6_mix_sources.
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
z AS (SELECT doc_id, source, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS size, length(text) AS n, length(text) - length(translate(text, '{MARKS}', '')) AS marks,
  (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5::DOUBLE) / {float(1 << 48)}::DOUBLE AS u FROM d),
k AS (SELECT *, -ln(u) / ({MOST_WEIGHT}::DOUBLE - least(marks::DOUBLE / greatest(n, 1)::DOUBLE / {WORST_MARK_SHARE}::DOUBLE, 1.0::DOUBLE) * {MOST_WEIGHT - LEAST_WEIGHT}::DOUBLE) AS key FROM z),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % {WEIGHT_CYCLE} + 1 AS weight FROM k GROUP BY source),
r AS (SELECT *, source_size * {MAX_EPOCHS} AS cap, (source_size * {MAX_EPOCHS})::DOUBLE / weight::DOUBLE AS ratio, sum(source_size) OVER ()::BIGINT AS everything FROM s),
q AS (SELECT *, (everything - coalesce(sum(cap) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / (sum(weight) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lvl FROM r),
v AS (SELECT arg_min(lvl, ratio) AS lvl FROM q WHERE ratio >= lvl),
t AS (SELECT source, source_size, CASE WHEN ratio <= v.lvl THEN cap::DOUBLE ELSE v.lvl * weight::DOUBLE END AS target FROM q, v),
b AS (SELECT k.doc_id, k.size, t.source_size, t.target, coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size::DOUBLE)::BIGINT ELSE 0 END AS epochs FROM b)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(least(round(target - epochs * source_size)::BIGINT - before, size), 0))::BIGINT AS taken FROM e
"""
