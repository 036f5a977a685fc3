"""The durable research store: results by unit, a manifest that alone says what counts, resume after any interruption.

A run lives in root/run-<signature>. A unit's rows are one Parquet folder, written before the manifest names it; folders
that no manifest names are debris of an interrupted write and are removed on opening. All file access goes through
Hadoop's FileSystem, so root may be on any store that Spark reaches.
"""

from __future__ import annotations

import hashlib
import json
import re
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "1"


def _eight_places(price: Column) -> Column:
    """A price to eight places as SQL's round has it, in doubles: large prices, which decimals would leave alone, can change in their last bit."""
    scaled = price * F.lit(1e8)
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled, 0) / F.lit(1e8)).otherwise(price)


def signature(config: dict, candles: DataFrame) -> str:
    """16 hex digits that stand for a configuration (without ``workers``) and its candles: rows, ends and end prices of each
    series. Two aggregates and no order."""
    rows = candles.groupBy("symbol", "tf").agg(F.count("*").alias("rows"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"), _eight_places(F.min_by("close", "timestamp")).alias("first_close"), _eight_places(F.max_by("close", "timestamp")).alias("last_close")).orderBy("symbol", "tf").collect()
    material = {"version": VERSION, "config": {k: v for k, v in config.items() if k != "workers"}, "data": [r.asDict() for r in rows]}
    return hashlib.sha256(json.dumps(material, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def counts(results: DataFrame) -> DataFrame:
    """Rows by strategy type, timeframe and stage (rows, not distinct keys)."""
    return results.groupBy("strategy_type", "tf", "stage").agg(F.count("*").alias("n"))


def file_sha256(spark: SparkSession, path: str) -> DataFrame:
    """path, length and SHA-256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


class Store:
    """A run's folder. ``queue`` writes a unit; ``done`` and ``complete`` say what a resumed run can skip."""

    def __init__(self, spark: SparkSession, root: str, sign: str, config: dict | None = None):
        self.spark, jvm = spark, spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.folder, self.resumed = f"{root.rstrip('/')}/run-{sign}", False
        self.version, found = self._latest()
        if found and found["status"] == "complete":  # a finished run is never written again
            self.folder += time.strftime("-%Y%m%d%H%M%S")
            self.version, found = 0, None
        if found:
            self.manifest, self.resumed = found, True
            self._purge()
        else:
            self.manifest = {"signature": sign, "config": config or {}, "status": "running", "units": {}, "stages": {}, "seeds": {}, "rows": 0, "checks": 0}
            self._commit()

    def _versions(self) -> list[tuple[int, str]]:
        """The manifests that were committed, oldest first."""
        top = self._path(self.folder)
        names = [x.getPath().getName() for x in self.fs.listStatus(top)] if self.fs.exists(top) else []
        return sorted((int(m[1]), n) for n in names if (m := re.fullmatch(r"manifest-([0-9]+)\.json", n)))

    def _latest(self) -> tuple[int, dict | None]:
        for version, name in reversed(self._versions()):
            stream = self.fs.open(self._path(f"{self.folder}/{name}"))
            try:
                return version, json.loads(bytes(stream.readAllBytes()).decode())
            finally:
                stream.close()
        return 0, None

    def _commit(self) -> None:
        """The manifest in one step: a new version is written beside, then renamed to a name that nothing has. Nothing is ever
        overwritten, so whenever this is cut short the last version stands; older ones go after that."""
        self.version += 1
        new, place = self._path(f"{self.folder}/manifest.new"), self._path(f"{self.folder}/manifest-{self.version:09d}.json")
        stream = self.fs.create(new, True)
        stream.write(bytearray(json.dumps(self.manifest, sort_keys=True).encode()))
        stream.close()
        if not self.fs.rename(new, place):
            raise OSError(f"another writer has {place}")
        for version, name in self._versions():
            if version < self.version:
                self.fs.delete(self._path(f"{self.folder}/{name}"), False)

    def _purge(self) -> None:
        named = {u["folder"] for u in self.manifest["units"].values()} | set(self.manifest["seeds"].values())
        top = self._path(f"{self.folder}/data")
        for status in self.fs.listStatus(top) if self.fs.exists(top) else []:
            if status.getPath().getName() not in named:
                self.fs.delete(status.getPath(), True)

    def _write(self, rows: DataFrame, name: str) -> str:
        folder = f"{re.sub('[^A-Za-z0-9_.-]', '_', name)}-{time.time_ns():x}"
        rows.write.parquet(f"{self.folder}/data/{folder}")
        return folder

    def done(self, tf, stage: str, unit: str) -> bool:
        return f"{tf}|{stage}|{unit}" in self.manifest["units"]

    def complete(self, tf, stage: str) -> bool:
        return f"{tf}|{stage}" in self.manifest["stages"]

    def queue(self, tf, stage: str, unit: str, rows: DataFrame, checks: int) -> None:
        """Write a unit's rows, then name them. A unit that is done is left alone, so a repeated call changes nothing."""
        if self.done(tf, stage, unit):
            return
        folder = self._write(rows, f"{tf}-{stage}-{unit}")
        n = self.spark.read.parquet(f"{self.folder}/data/{folder}").count()
        self.manifest["units"][f"{tf}|{stage}|{unit}"] = {"folder": folder, "rows": n, "checks": checks}
        self.manifest["rows"] += n
        self.manifest["checks"] += checks
        self._commit()

    def save_seed(self, tf, stage: str, rows: DataFrame, **meta) -> None:
        """A stage's retained rows; the stage is complete with them."""
        self.manifest["seeds"][f"{tf}|{stage}"] = self._write(rows, f"seed-{tf}-{stage}")
        self.manifest["stages"][f"{tf}|{stage}"] = meta
        self._commit()

    def load_seed(self, tf, stage: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/data/{self.manifest['seeds'][f'{tf}|{stage}']}")

    def results(self) -> DataFrame | None:
        """All rows of named units."""
        paths = [f"{self.folder}/data/{u['folder']}" for u in self.manifest["units"].values()]
        return self.spark.read.option("mergeSchema", True).parquet(*paths) if paths else None

    def remaining(self, units: DataFrame, tf, stage: str) -> DataFrame:
        """Units (unit_id) that are not done: an anti-join with the manifest."""
        prefix = f"{tf}|{stage}|"
        done = [(k[len(prefix) :],) for k in self.manifest["units"] if k.startswith(prefix)]
        return units.join(self.spark.createDataFrame(done, "unit_id string"), "unit_id", "left_anti")

    def finish(self, status: str = "complete") -> dict:
        """Close the run (``complete``), or leave it to be resumed (``stopped``)."""
        self.manifest["status"] = status
        self._commit()
        return self.summary()

    def summary(self) -> dict:
        m = self.manifest
        return {"folder": self.folder, "status": m["status"], "rows": m["rows"], "checks": m["checks"], "units": len(m["units"]), "stages": sorted(m["stages"])}


def write_leaders(results: DataFrame, top: DataFrame, folder: str) -> None:
    """The CSV sinks: retained rows and the top, one file each (both are bounded by retention)."""
    for name, df in (("retained", results), ("top", top)):
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
