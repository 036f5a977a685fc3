"""Packing into optimal length buckets (operator 10).

1. Token counts (words, unless the caller brings a column) form one global histogram: one row a distinct length.
2. Dynamic programming over it chooses at most ``buckets`` upper bounds that minimise the padding of the whole corpus:
   best[k][j] = min over i < j of best[k-1][i] + bound[j] * (count in (i, j]); as bounds and counts rise, the minimum
   is the lower envelope of lines and each layer takes one sweep.
3. Within its bucket a document has a place (MD5 order of doc_id); max(1, budget // bound) documents form a batch.

The driver holds only the histogram, a row a distinct length, so as many as the longest text has words at most and far
fewer than documents; the sweeps cost a few microseconds a row. Every length is a bound that can be chosen: bounds are
optimal for the whole corpus. Places come from sliced running totals, so a bucket with most rows is spread over many tasks.

A null text has no tokens; such documents go to the shortest bucket. No row is dropped or cut: a document longer than
the budget is a batch of its own. Repeated rows take places of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_words, running_total, stash, uniform

BUCKETS = 8
BUDGET = 65536
SEED = "pack"


def optimal_bounds(lengths: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """The upper bounds, rising, of at most ``buckets`` buckets with the least total padding. lengths rise strictly."""
    n = len(lengths)
    if n <= buckets:
        return list(lengths)
    total = [0]
    for c in counts:
        total.append(total[-1] + c)
    best = [lengths[j] * total[j + 1] for j in range(n)]  # one bucket up to j
    came: list[list[int]] = []
    for _ in range(1, buckets):
        # Lines y(x) = best[i] - total[i+1] * x; slopes fall with i and queries x = lengths[j] rise.
        new, back, hull, at = [0] * n, [-1] * n, [], 0
        for j in range(n):
            if j:
                m, b, i = -total[j], best[j - 1], j - 1
                while len(hull) >= 2 and (b - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - m):
                    hull.pop()
                hull.append((m, b, i))
                at = min(at, len(hull) - 1)
                x = lengths[j]
                while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                    at += 1
                value = hull[at][0] * x + hull[at][1] + x * total[j + 1]
                new[j], back[j] = (value, hull[at][2]) if value < best[j] else (best[j], -2)
            else:
                new[j], back[j] = best[j], -2
        came.append(back)
        best = new
    bounds, j, layer = [], n - 1, len(came) - 1
    while j >= 0:
        while layer >= 0 and came[layer][j] == -2:
            layer -= 1
        bounds.append(lengths[j])
        if layer < 0:
            break
        j, layer = came[layer][j], layer - 1
    return bounds[::-1]


def pack(docs: DataFrame, tokens=None, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """The operator: doc_id, n_tokens, bucket, bucket_tokens (its bound), batch (number within the bucket), place (within the batch)."""
    tokens = n_words(F.coalesce("text", F.lit(""))) if tokens is None else tokens
    sized = stash(docs.select("doc_id", tokens.cast("long").alias("n_tokens")), "pack-sizes")
    histogram = sized.groupBy("n_tokens").agg(F.count("*").alias("n")).toArrow().sort_by("n_tokens")
    bounds = optimal_bounds(histogram.column("n_tokens").to_pylist(), histogram.column("n").to_pylist(), buckets)
    bucket = F.lit(len(bounds) - 1)
    limit = F.lit(bounds[-1] if bounds else 0).cast("long")
    for k in reversed(range(len(bounds) - 1)):
        bucket = F.when(F.col("n_tokens") <= bounds[k], k).otherwise(bucket)
        limit = F.when(F.col("n_tokens") <= bounds[k], F.lit(bounds[k]).cast("long")).otherwise(limit)
    df = sized.select("doc_id", "n_tokens", bucket.cast("int").alias("bucket"), limit.alias("bucket_tokens"), F.lit(1).cast("long").alias("_one"))
    df = running_total(df, ["bucket"], uniform(F.col("doc_id"), SEED), ["doc_id", "n_tokens"], "_one", "_rank")
    per = F.greatest(F.floor(F.lit(budget) / F.greatest("bucket_tokens", F.lit(1))), F.lit(1)).cast("long")
    return df.select("doc_id", "n_tokens", "bucket", "bucket_tokens", F.floor(F.col("_rank") / per).cast("long").alias("batch"), (F.col("_rank") % per).cast("long").alias("place"))


def op10_length_buckets(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
