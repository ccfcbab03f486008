"""Aggregates: calibration, evaluation metrics, sweeps, completeness, batch totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def calibration(rows: DataFrame, doc: str, ratio: str, least: int = 6, floor: float = 0.99, margin: float = 0.02) -> DataFrame:
    """Adds baseline (the document's median), n_ratios and outlier: below the median by the margin, in documents
    with enough ratios and a median at or above the floor."""
    w = W.partitionBy(doc)
    out = rows.withColumn("baseline", F.round(F.median(ratio).over(w), 6)).withColumn("n_ratios", F.count(ratio).over(w))
    return out.withColumn("outlier", (F.col("n_ratios") >= least) & (F.col("baseline") >= floor) & (F.col(ratio) < F.col("baseline") - margin))


def ratios(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall, f1; 0 where a denominator is."""
    p, r = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)), F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    return [F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1")]


def precision_recall(rows: DataFrame, gold: Column, found: Column, group: str) -> DataFrame:
    """Per group and overall (a null group) in one pass."""
    sets = rows.select(group, gold.alias("g"), found.alias("f")).rollup(group).agg(F.count_if(F.col("g") & F.col("f")).alias("tp"), F.count_if(~F.col("g") & F.col("f")).alias("fp"), F.count_if(F.col("g") & ~F.col("f")).alias("fn"), F.grouping(group).alias("is_total"))
    return sets.select(group, F.col("is_total").cast("int").alias("is_total"), "tp", "fp", "fn", *ratios(F.col("tp"), F.col("fp"), F.col("fn")))


def sweep(rows: DataFrame, score: str, gold: Column, thresholds: Sequence[float]) -> DataFrame:
    """Per threshold: positives flagged at or above it, recall, false positive rate, precision.

    The thresholds are a fixed list, so one aggregation with a column for each replaces a join."""
    g = gold
    aggs = [F.count_if(g).alias("gold"), F.count_if(~g).alias("clean")]
    for k, t in enumerate(thresholds):
        aggs += [F.count_if(g & (F.col(score) >= t)).alias(f"tp{k}"), F.count_if(~g & (F.col(score) >= t)).alias(f"fp{k}")]
    table = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{k}").alias("tp"), F.col(f"fp{k}").alias("fp")) for k, t in enumerate(thresholds)])
    out = rows.agg(*aggs).select("gold", "clean", F.explode(table).alias("x")).select("x.*", "gold", "clean")
    return out.select("threshold", "tp", "fp", F.round(F.try_divide("tp", "gold"), 6).alias("recall"), F.round(F.try_divide("fp", "clean"), 6).alias("fpr"), F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 6).alias("precision"))


def outlier_grid(rows: DataFrame, doc: str, ratio: str, gold: Column, margins: Sequence[float]) -> DataFrame:
    """Flags and hits by margin below the document's median, all margins in one pass."""
    based = rows.withColumn("g", gold).withColumn("base", F.median(ratio).over(W.partitionBy(doc)))
    low = [F.col(ratio) < F.col("base") - m for m in margins]
    aggs = [a for k, x in enumerate(low) for a in (F.count_if(x).alias(f"f{k}"), F.count_if(x & F.col("g")).alias(f"h{k}"))]
    table = F.array(*[F.struct(F.lit(float(m)).alias("margin"), F.col(f"f{k}").alias("flagged"), F.col(f"h{k}").alias("hits")) for k, m in enumerate(margins)])
    return based.agg(*aggs).select(F.explode(table).alias("x")).select("x.*")


def batch_summary(entries: DataFrame, doc: str) -> DataFrame:
    """Per document: counts by overall verdict, most flagged first."""
    out = entries.groupBy(doc).agg(F.count("*").alias("citations"), F.count_if(F.col("overall") == "FLAGGED").alias("flagged"), F.count_if(F.col("overall") == "UNVERIFIED").alias("unverified"), F.count_if(F.col("overall") == "REVIEW").alias("review"), F.count_if(F.col("overall") == "VERIFIED").alias("verified"))
    return out.orderBy(F.desc("flagged"), F.desc("unverified"), doc)


def reader_stats(readings: DataFrame, keys: list[str]) -> DataFrame:
    return readings.groupBy(*keys).agg(F.count("*").alias("calls"), F.count_if(F.col("failed")).alias("failures"), F.sum("chars").alias("chars"), F.round(F.sum("seconds"), 6).alias("seconds"), F.round(F.avg("seconds"), 6).alias("mean_seconds"), F.max("seconds").alias("max_seconds"))
