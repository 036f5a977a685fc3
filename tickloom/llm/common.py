"""What the corpus operators share: written tables, texts and words, running totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.sources.written import discard, stash, work_dir  # noqa: F401

#: The six characters between words: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"

def batches(df: DataFrame, megabytes: int = 8) -> DataFrame:
    """df as it is; from now on the session's Arrow batches hold so many megabytes at most, so that long rows can't fill a worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))
    return df


def texts(df: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the columns named in more; every other column is left out, whatever its name."""
    return df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, as an array (empty for a text without words)."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN))


def n_words(text: Column) -> Column:
    """The number of words, without making them: blank characters whose successor is none, counted on a bare text."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) that depends only on key and seed: the first 48 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def running_total(df: DataFrame, group: list[str], spread: Column, order: list[str], value: str, out: str, rows: int = 4096) -> DataFrame:
    """Per row, the sum of value over all earlier rows of its group (by spread, then order), as column out.

    spread must rise with the order and be near uniform in [0, 1). A group is cut along it into slices of about
    ``rows`` rows, so that no task holds a whole group: slice totals are summed first (one row a slice), then a
    window runs inside each slice. df is read twice; write it before if it is dear. Groups may be null.
    """
    from pyspark.sql import Window

    sliced = df.withColumn("_spread", spread)
    counts = df.groupBy(*group).agg(F.ceil(F.count("*") / rows).alias("_slices"))
    same = lambda a, b: F.lit(True) if not group else _all([a[g].eqNullSafe(b[g]) for g in group])
    sliced = sliced.alias("a").join(counts.alias("b"), same(sliced, counts)).select("a.*", "b._slices") if group else sliced.crossJoin(counts)
    sliced = sliced.withColumn("_slice", F.floor(F.col("_spread") * F.col("_slices")))
    totals = sliced.groupBy(*group, "_slice").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*group, "_slice", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    on = sliced["_slice"] == totals["_slice"]
    on = on & same(sliced, totals) if group else on
    own = Window.partitionBy(*group, "_slice").orderBy("_spread", *order).rowsBetween(Window.unboundedPreceding, -1)
    joined = sliced.alias("a").join(totals.alias("b"), on).select("a.*", "b._before")
    return joined.withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(own), F.lit(0))).drop("_spread", "_slices", "_slice", "_before")


def _all(conditions: list[Column]) -> Column:
    found = conditions[0]
    for c in conditions[1:]:
        found = found & c
    return found
