"""The corpus pipeline: five stages, each one of the training-data operators.

toxicity rejects documents, the n-gram Jaccard join keeps one document of each group, substring
deduplication cuts repeated passages out of the texts, mixing takes words of each source to its
target, and packing lays the remaining documents into token sequences. Every stage works on all that
its predecessor kept; all but the last return the columns of documents.

Defined cases are those of the operators. Besides: a document whose text is cut has the number of
its remaining characters in n_chars and its words joined by one space; a document left without words
goes, one that never had words stays; the mix keeps a document once for each copy it takes words of,
with the taken words; one that it takes nothing of goes.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docproof.llm import mixing, packing, shingles, substrings, toxicity
from docproof.llm._common import WORD, order_key, released, row_key, shared_dir, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The stages go through word runs, Jaccard chains and token streams: no SQL states them.
ORACLE_SQL = None
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def with_text(docs: DataFrame, text: Column, changed: Column) -> DataFrame:
    """docs with a new text where it changed."""
    text = F.when(changed, text).otherwise(F.col("text"))
    return docs.withColumn("__text", text).withColumn("n_chars", F.when(changed, F.length("__text").cast("long")).otherwise(F.col("n_chars"))).withColumn("text", F.col("__text")).select(*COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.attach(docs, model).where(F.col("__score") < toxicity.THRESHOLD).select(*COLUMNS)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component one row of the smallest doc_id (a null id stands last); empty documents are all kept."""
    docs = docs.select(*COLUMNS)
    found = shingles.similar(docs)
    # by label, not component_id: unrelated texts may share an id or have none
    at = F.struct(order_key().alias("doc"), "row")
    first = found.where("n_shingles > 0").groupBy("label").agg(F.min(at).alias("at")).select("at.*")
    empty = found.where("n_shingles = 0").select(at.alias("at")).distinct().select("at.*")
    has_words = F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    rows = docs.withColumn("doc", order_key()).withColumn("row", row_key()).join(first.union(empty), ["doc", "row"], "left_semi")
    return rows.withColumn("n", F.when(has_words, 0).otherwise(F.monotonically_increasing_id())).dropDuplicates(["doc", "row", "n"]).select(*COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = substrings.dedup(docs.select(*COLUMNS), keep=("lang", "source", "n_chars"))
    out = out.where((F.size("spans") == 0) | (F.length("kept_text") > 0))
    return with_text(out, F.col("kept_text"), F.size("spans") > 0)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    mixed = mixing.mix(docs)
    # equal rows share a key; their taken runs are gathered on one of them
    taken = mixed.where(F.size("segments") > 0).groupBy("row_key").agg(F.flatten(F.collect_list("segments")).alias("segments"))
    rows = docs.withColumn("row_key", row_key()).dropDuplicates(["row_key"]).join(taken, "row_key")
    rows = rows.select(*COLUMNS, F.explode("segments").alias("s"), F.regexp_count(F.col("text"), F.lit(WORD)).alias("words"))
    some = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), (F.col("s.start") + 1).cast("int"), F.col("s.length").cast("int"))
    return with_text(rows, F.array_join(some, " "), F.col("s.length") < F.col("words"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def after_release(stage: Stage) -> Stage:
    """The stage, begun without what earlier ones left in the driver's memory."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        released(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("toxicity", after_release(toxicity_stage)),
    ("jaccard", after_release(jaccard_stage)),
    ("substrings", after_release(substring_stage)),
    ("mixing", after_release(mixing_stage)),
    ("packing", after_release(packing_stage)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
