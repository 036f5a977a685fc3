"""Candle tables: building bars from ticks, CSV scan and sink, cleaning, reuse of cached files.

A candle table has symbol, tf (minutes), idx (0 for a series' first bar), timestamp (epoch ms), open, high, low, close,
volume, turnover. Epoch milliseconds are the authoritative time; no result depends on the session's time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY_MS = 86_400_000
COLUMNS = ["symbol", "tf", "idx", "timestamp", "open", "high", "low", "close", "volume", "turnover"]
MIN_CANDLES = 300


def epoch_ms(ts: str) -> Column:
    """Milliseconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))")


def month_code(ms: Column) -> Column:
    """year * 100 + month of epoch milliseconds, in UTC."""
    day = F.date_from_unix_date(F.floor(ms / DAY_MS).cast("int"))
    return (F.year(day) * 100 + F.month(day)).cast("int")


def walk_candles(ticks: DataFrame, base: float, bar_ms: int, tf: int) -> DataFrame:
    """Bars of each symbol's walk base + (running sum of step) / 100 over ticks (symbol, ms, seq, step), ordered by (ms, seq).

    Sums run inside each bar in parallel; only a symbol's bar totals (one row a bar) meet in one ordered window. All sums
    are integers, so prices do not depend on the order of addition. A tick without time or step counts for nothing; ticks
    that tie in (ms, seq) may come in either order; no ticks make no bars.
    """
    inside = Window.partitionBy("symbol", "bar").orderBy("ms", "seq").rowsBetween(Window.unboundedPreceding, 0)
    df = ticks.select("symbol", "ms", "seq", "step").dropna(subset=["ms", "step"])
    df = df.withColumn("bar", (F.floor(F.col("ms") / bar_ms) * bar_ms).cast("long")).withColumn("cum", F.sum("step").over(inside))
    order = F.struct("ms", "seq")
    bars = df.groupBy("symbol", "bar").agg(F.min_by("cum", order).alias("o"), F.max("cum").alias("h"), F.min("cum").alias("l"), F.max_by("cum", order).alias("c"), F.count("*").alias("n"), F.sum(F.abs("step")).alias("t"))
    by_bar = Window.partitionBy("symbol").orderBy("bar")
    bars = bars.withColumn("b", F.coalesce(F.sum("c").over(by_bar.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    price = lambda c: F.lit(base) + (F.col("b") + F.col(c)) / F.lit(100.0)
    return bars.select(
        "symbol", F.lit(tf).alias("tf"), (F.row_number().over(by_bar) - 1).cast("long").alias("idx"), F.col("bar").alias("timestamp"),
        price("o").alias("open"), price("h").alias("high"), price("l").alias("low"), price("c").alias("close"), F.col("n").cast("double").alias("volume"), F.col("t").cast("double").alias("turnover"),
    )


def orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of a signed walk over orders."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    ticks = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.lit("ORDERS").alias("symbol"), epoch_ms("o_orderdate").alias("ms"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_custkey") % 2 == 0, cents).otherwise(-cents).alias("step"))
    return walk_candles(ticks, 250_000_000.0, DAY_MS, 1440)


def events_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of a signed walk over events."""
    cents = F.round(F.col("value") * 100).cast("long")
    ticks = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.lit("EVENTS").alias("symbol"), epoch_ms("ts").alias("ms"), F.col("event_id").alias("seq"), F.when(F.col("user_id") % 2 == 0, cents).otherwise(-cents).alias("step"))
    return walk_candles(ticks, 100_000.0, 3_600_000, 60)


_NUMBERS = ("timestamp", "open", "high", "low", "close", "volume", "turnover")


def clean(raw: DataFrame, arrival: str, symbol: str, tf: int, strict: bool = False, start_ms: int | None = None, end_ms: int | None = None, now_ms: int | None = None) -> DataFrame:
    """Candles from text columns: bad numbers become null; missing or null volume and turnover 0; rows without time or
    prices go (strict: rows with any null); of equal timestamps the first in order of ``arrival`` stays; bounds are
    inclusive; with now_ms, a bar that has not closed by then goes."""
    parsed = [(F.expr(f"try_cast(`{c}` AS {'bigint' if c == 'timestamp' else 'double'})") if c in raw.columns else F.lit(0.0)).alias(c) for c in _NUMBERS]
    df = raw.select(F.col(arrival).alias("_arrival"), *parsed)
    df = df.dropna(subset=list(_NUMBERS)) if strict else df.fillna(0.0, ["volume", "turnover"]).dropna(subset=["timestamp", "open", "high", "low", "close"])
    if start_ms is not None:
        df = df.where(F.col("timestamp") >= start_ms)
    if end_ms is not None:
        df = df.where(F.col("timestamp") <= end_ms)
    if now_ms is not None:
        df = df.where(F.col("timestamp") + tf * 60_000 <= now_ms)
    first = df.groupBy("timestamp").agg(F.min_by(F.struct(*_NUMBERS[1:]), "_arrival").alias("v")).select("timestamp", "v.*")
    order = Window.partitionBy("symbol", "tf").orderBy("timestamp")
    return first.withColumns({"symbol": F.lit(symbol), "tf": F.lit(tf)}).withColumn("idx", (F.row_number().over(order) - 1).cast("long")).select(*COLUMNS)


def read_csv(spark: SparkSession, path: str, symbol: str, tf: int) -> DataFrame:
    """The CSV scan: a header with at least timestamp, open, high, low and close."""
    raw = spark.read.option("header", True).csv(path)
    missing = {"timestamp", "open", "high", "low", "close"} - set(raw.columns)
    if missing:
        raise ValueError(f"{path}: columns are missing: {sorted(missing)}")
    return clean(raw.withColumn("_arrival", F.monotonically_increasing_id()), "_arrival", symbol, tf)


def write_csv(candles: DataFrame, folder: str) -> None:
    """The CSV sink: files under symbol= and tf= folders, committed by Spark's protocol (no half-written file is seen)."""
    candles.write.mode("overwrite").partitionBy("symbol", "tf").option("header", True).csv(folder)


def require_enough(candles: DataFrame, least: int = MIN_CANDLES) -> DataFrame:
    """candles, or an error if any series is shorter than least."""
    short = candles.groupBy("symbol", "tf").count().where(F.col("count") < least).limit(1).collect()
    if short or not candles.limit(1).count():
        raise ValueError(f"fewer than {least} candles: {short[0] if short else 'no series'}")
    return candles


def cached_files(spark: SparkSession, folder: str) -> DataFrame:
    """The catalog of candle files under a folder that write_csv made: path, modified, symbol, tf, first_ts, last_ts, rows.
    Files that are being written (names with . or _ in front) and rows without a time do not count."""
    df = spark.read.option("header", True).option("recursiveFileLookup", False).csv(folder)
    if not {"symbol", "tf", "timestamp"} <= set(df.columns):
        raise ValueError(f"{folder} has no candles by symbol and tf")
    df = df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("symbol").cast("string").alias("symbol"), F.col("tf").cast("int").alias("tf"), F.expr("try_cast(timestamp AS bigint)").alias("t"))
    return df.where("t is not null").groupBy("path", "modified", "symbol", "tf").agg(F.min("t").alias("first_ts"), F.max("t").alias("last_ts"), F.count("*").alias("rows"))


def find_reusable(catalog: DataFrame, symbol: str, tf: int, start_ms: int, end_ms: int) -> DataFrame:
    """Of cached tables (path, modified, symbol, tf, first_ts, last_ts, rows), the newest that covers a span: gaps at both ends
    of at most max(3 bars, 1 % of the span), and 99 % of it covered."""
    bar, span = tf * 60_000, max(1, end_ms - start_ms)
    slack = max(3 * bar, span * 0.01)
    covered = F.least("last_ts", F.lit(end_ms)) - F.greatest("first_ts", F.lit(start_ms))
    fit = catalog.where((F.col("symbol") == symbol) & (F.col("tf") == tf) & (F.col("first_ts") - start_ms <= slack) & (F.lit(end_ms) - F.col("last_ts") <= slack) & (covered / span >= 0.99))
    return fit.orderBy(F.desc("modified"), "path").limit(1)


def quality(candles: DataFrame) -> DataFrame:
    """Per series: rows, duplicate and non-monotonic timestamps (in idx order), gaps, missing bars, invalid and non-positive bars."""
    step = F.col("timestamp") - F.lag("timestamp").over(Window.partitionBy("symbol", "tf").orderBy("idx"))
    bar = F.col("tf").cast("long") * 60_000
    bad = (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high"))
    low = F.least("open", "high", "low", "close") <= 0
    count = lambda c: F.count(F.when(c, 1))
    return candles.withColumn("step", step).groupBy("symbol", "tf").agg(
        F.count("*").alias("n_rows"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"), (F.count("*") - F.countDistinct("timestamp")).alias("duplicate_timestamps"),
        count(F.col("step") <= 0).alias("non_monotonic_steps"), count(F.col("step") > bar).alias("gap_events"),
        F.coalesce(F.sum(F.when(F.col("step") > bar, F.greatest(F.floor(F.col("step") / bar) - 1, F.lit(0)))), F.lit(0)).cast("long").alias("missing_candles"), count(bad).alias("invalid_ohlc_rows"), count(low).alias("nonpositive_rows"),
    )


def gaps(candles: DataFrame) -> DataFrame:
    """One row a gap: the bar after it, its length in ms and the estimate of missing bars."""
    step = F.col("timestamp") - F.lag("timestamp").over(Window.partitionBy("symbol", "tf").orderBy("idx"))
    bar = F.col("tf").cast("long") * 60_000
    return candles.select("symbol", "tf", "idx", "timestamp", step.alias("gap_ms"), bar.alias("bar")).where("gap_ms > bar").select("symbol", "tf", "idx", "timestamp", "gap_ms", F.greatest(F.floor(F.col("gap_ms") / F.col("bar")) - 1, F.lit(0)).cast("long").alias("missing"))
