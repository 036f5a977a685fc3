"""The corpus pipeline: quality rules, near-duplicate removal, redaction, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a table. All but the last return the columns of ``documents``, with
text as the stage leaves it and n_chars as its length. Every stage works on all rows it is given.

Defined cases: a null text is empty (quality rules reject it); rows that share a doc_id are one document from the
near-duplicate stage on (of different texts, the least stays), rows without doc_id stay apart; other columns are
left out; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import minhash, mixing, packing, pii, quality
from tickloom.llm.common import n_words, stash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Redaction and signatures are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: rejected documents go, failed lines of the others too."""
    # The row number keeps the filter above the rules: pushed below them it would hold each rule's expression many times over.
    kept = quality.clean_lines(docs, "lang", "source").withColumn("_row", F.monotonically_increasing_id()).where("kept and _row >= 0")
    return _documents(kept.withColumnRenamed("clean_text", "text"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4 on five-word shingles: the document with the smallest doc_id of each group stays."""
    found = minhash.near_duplicates(docs, words=5, name="pipeline")
    stay = found.where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.select(*COLUMNS).join(stay, "doc_id").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("d")).select("doc_id", "d.*")
    return named.unionByName(docs.select(*COLUMNS).where("doc_id is null"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: every span of personal data becomes its kind in brackets."""
    return _documents(pii.redact(docs, "lang", "source"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6, in whole documents: a row a copy; the last, fractional copy of a document stands if half of it or more is taken."""
    taken = mixing.mix(docs).where("size > 0").select("doc_id", "source", "size", F.floor((F.col("taken") * 2 + F.col("size")) / (F.col("size") * 2)).cast("int").alias("copies"))
    copies = taken.groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies")).where("copies > 0")
    rows = docs.select(*COLUMNS, n_words(F.coalesce("text", F.lit(""))).alias("size"))
    same = rows["doc_id"].eqNullSafe(copies["doc_id"]) & rows["source"].eqNullSafe(copies["source"]) & (rows["size"] == copies["size"])
    joined = rows.join(copies, same).select(*(rows[c] for c in COLUMNS), "copies")
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: each copy's bucket, batch and place."""
    return packing.pack(docs)


STAGES = [("quality rules", clean), ("near-dedup", deduplicate), ("personal data", redact), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one leaves is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs, f"stage-{k}")
    return docs
