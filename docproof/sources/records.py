"""Scans of record files: benchmark lines, registers, ledgers; and batched lookups against an archive table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXCERPTS = "text string, filename string, citations_in_segment array<string>, list_hallucinations map<string,string>, list_hallucination_types map<string,array<string>>"


def excerpts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Scored excerpts, and those left out because they hold no citation."""
    rows = spark.read.schema(EXCERPTS).json(path)
    scored = F.coalesce(F.size("citations_in_segment"), F.lit(0)) > 0
    return rows.where(scored), rows.where(~scored)


def gold_spans(rows: DataFrame) -> DataFrame:
    """One row for each labelled span that stands in its text: start, end, types."""
    x = rows.select("filename", "text", F.explode(F.map_entries("list_hallucinations")).alias("e"), "list_hallucination_types")
    at = F.expr("locate(e.key, text)")
    return x.withColumn("at", at).where("at > 0").select("filename", (F.col("at") - 1).alias("start"), (F.col("at") - 1 + F.length("e.key")).alias("end"), F.try_element_at("list_hallucination_types", F.col("e.key")).alias("types"))


def register(spark: SparkSession, path: str) -> DataFrame:
    """A CSV register with a header; quoted fields may span lines."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def items(rows: DataFrame, column: str) -> DataFrame:
    """'Type: Category | narrative' items joined by '||', one row each."""
    x = rows.withColumn("item", F.explode(F.split(column, r"\|\|"))).withColumn("item", F.trim("item")).where("item <> ''")
    return x.withColumn("type", F.trim(F.regexp_extract("item", r"^([^:|]*)", 1))).withColumn("category", F.trim(F.regexp_extract("item", r"^[^:|]*:([^|]*)", 1))).withColumn("narrative", F.trim(F.regexp_extract("item", r"\|(.*)$", 1)))


def identity(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def lookup(wanted: DataFrame, archive: DataFrame, key: str = "citation") -> DataFrame:
    """Every distinct key is asked once; what the archive does not echo has status -1."""
    asked = wanted.select(key).distinct().join(archive, key, "left")
    return asked.withColumn("status", F.coalesce("status", F.lit(-1)))


def batches(keys: DataFrame, key: str, most_items: int = 250, most_chars: int = 64_000, shards: int = 64) -> DataFrame:
    """Numbers request batches of at most so many items and characters, within hash shards that fill independently."""
    from pyspark.sql import Window as W

    shard = F.pmod(F.xxhash64(key), F.lit(shards))
    upto = W.partitionBy("shard").orderBy(key).rowsBetween(W.unboundedPreceding, 0)
    out = keys.select(key).distinct().withColumn("shard", shard).withColumn("n", F.count("*").over(upto)).withColumn("c", F.sum(F.length(key) + 1).over(upto))
    half = most_chars // 2  # a batch cut by characters holds less than this and one item
    return out.select(key, "shard", F.floor((F.col("n") - 1) / most_items).alias("by_items"), F.floor((F.col("c") - 1) / half).alias("by_chars"))
