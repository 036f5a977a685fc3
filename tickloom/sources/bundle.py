"""The report bundle: every view as CSV, with a manifest of the files' lengths and SHA-256 digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import file_sha256


def write_bundle(spark: SparkSession, views: dict[str, DataFrame], folder: str) -> DataFrame:
    """Writes folder/<name>/ for each view, one CSV file with a header each (views are bounded by their top-k), and then
    folder/manifest, a JSON row a file: name, path below folder, length, sha256. Returns the manifest.

    The manifest is written last: a bundle without one is not finished. An empty view is a file with a header."""
    for name, df in views.items():
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
    made = None
    for name in views:
        one = file_sha256(spark, f"{folder}/{name}/*.csv").select(F.lit(name).alias("name"), F.regexp_extract("path", f"({name}/[^/]*)$", 1).alias("path"), "length", "sha256")
        made = one if made is None else made.unionByName(one)
    made.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    return spark.read.schema(made.schema).json(f"{folder}/manifest")


def damaged(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a bundle that are missing or no longer have the manifest's digest."""
    said = spark.read.schema("name string, path string, length long, sha256 string").json(f"{folder}/manifest")
    there = file_sha256(spark, f"{folder}/*/*.csv").select(F.regexp_extract("path", "([^/]*/[^/]*)$", 1).alias("p"), F.col("sha256").alias("now"))
    return said.join(there, F.col("path") == F.col("p"), "left").where(~F.col("sha256").eqNullSafe(F.col("now"))).select("name", "path")
