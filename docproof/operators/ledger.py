"""Ledgers: who cites what, what was not examined, run totals, caps, reports and records; and scores over whole evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docproof.functions.text import flatten_for_output
from docproof.operators.verdicts import DIMENSIONS, PLAIN_ORDER, ordinal

NOT_PROBLEMS = ("PASS", "N/A", "PENDING")


def authorities(entries: DataFrame, doc: str) -> DataFrame:
    """Each distinct authority of a document with its entries; entries without a key are left out."""
    return entries.where("authority_key is not null").groupBy(doc, "authority_key").agg(F.count("*").alias("n"), F.min("citation_id").alias("first_id"))


def run_totals(entries: DataFrame, doc: str) -> DataFrame:
    return entries.groupBy(doc).agg(F.count("*").alias("citations"), F.count_distinct("authority_key").alias("authorities"), F.count_if(F.col("kind") == "unrecognized").alias("unparsed"))


def by_overall(entries: DataFrame, overall: str) -> DataFrame:
    return entries.where(F.col("overall") == overall)


def unexamined(entries: DataFrame) -> DataFrame:
    """What no source held: not examined, which is no finding."""
    return by_overall(entries, "UNVERIFIED")


def pending(checks: DataFrame, keys: list[str]) -> DataFrame:
    """Entries with an undecided check, and which come first."""
    return checks.where("verdict = 'PENDING'").groupBy(*keys).agg(F.min_by("dimension", ordinal(F.col("dimension"), DIMENSIONS)).alias("dimension"), F.count("*").alias("n"))


def quote_accounting(found: DataFrame, attributed: DataFrame, checked: DataFrame, doc: str) -> DataFrame:
    """Per document: quotations found, attributed to a citation, not attributed, checked."""
    n = lambda rows, name: rows.groupBy(doc).agg(F.count("*").alias(name))
    out = n(found, "found").join(n(attributed, "attributed"), doc, "left").join(n(checked, "checked"), doc, "left").na.fill(0, ["attributed", "checked"])
    return out.withColumn("unattributed", F.greatest(F.lit(0), F.col("found") - F.col("attributed")))


def sources_union(checks: DataFrame, keys: list[str]) -> DataFrame:
    """Each entry's sources, once each, in the order of the checks that consulted them. checks: keys, seq, sources."""
    x = F.array_sort(F.collect_list(F.struct("seq", "sources")))
    return checks.groupBy(*keys).agg(F.array_distinct(F.flatten(F.transform(x, lambda c: c["sources"]))).alias("sources"))


def capped(rows: DataFrame, doc: str, order: list[Column | str], most: int) -> DataFrame:
    """Adds `deferred`: rows past the first `most` of a document are kept for a later run, not dropped."""
    return rows.withColumn("deferred", F.row_number().over(W.partitionBy(doc).orderBy(*order)) > most)


def listed_head(values: Column, most: int) -> Column:
    """The first values as one text, and how many more there are."""
    more = F.size(values) - most
    return F.concat(F.array_join(F.slice(values, 1, most), "; "), F.when(more > 0, F.concat(F.lit("; and "), more.cast("string"), F.lit(" more"))).otherwise(F.lit("")))


def plain_lines(entries: DataFrame, checks: DataFrame, keys: list[str]) -> DataFrame:
    """One plain line for each entry, explained by its first failing check; place gives the plain report's own order."""
    bad = checks.where(~F.col("verdict").isin(*NOT_PROBLEMS))
    first = bad.groupBy(*keys).agg(F.min_by(F.struct("dimension", "verdict"), F.struct(F.when(F.col("verdict") == "FAIL", 0).otherwise(1), ordinal(F.col("dimension"), DIMENSIONS))).alias("f"))
    why = F.when(F.col("f").isNull(), F.lit("nothing was found against it")).otherwise(F.concat(F.replace("f.dimension", F.lit("_"), F.lit(" ")), F.lit(": "), F.lower(F.replace("f.verdict", F.lit("_"), F.lit(" ")))))
    return entries.join(first, keys, "left").select(*keys, "overall", ordinal(F.col("overall"), PLAIN_ORDER).alias("place"), flatten_for_output(why, 80).alias("line"))


def scope(coverage: DataFrame, doc: str) -> DataFrame:
    """The limits of a run, stated before its results. coverage as verdicts.coverage gives it."""
    part = lambda n, text: F.concat(F.col(n).cast("string"), F.lit(f" {text}"))
    line = F.concat_ws("; ", part("reachable", "reachable"), part("absent", "in no source"), part("indeterminate", "ambiguous"), part("not_consulted", "not consulted"), part("statutory", "statutory"))
    return coverage.select(doc, F.concat(part("citations", "citations: "), line, F.when(F.col("headline"), F.lit(". Many were in no source.")).otherwise(F.lit("."))).alias("scope"))


def provenance(readings: DataFrame, doc: str) -> DataFrame:
    """Who read what: readings by backend, how many failed or were deferred."""
    return readings.groupBy(doc, "backend").agg(F.count("*").alias("readings"), F.count_if("failed").alias("failed"), F.count_if("deferred").alias("deferred"))


def console(entries: DataFrame, doc: str) -> DataFrame:
    """One line for each entry that is not verified."""
    return entries.where("overall <> 'VERIFIED'").select(doc, F.concat(F.rpad("overall", 11, " "), F.lit(" "), flatten_for_output(F.col("citation_id").cast("string"), 60)).alias("line"))


def record(entries: DataFrame, cells: DataFrame, keys: list[str], content: DataFrame, doc: str) -> DataFrame:
    """The verification record: one row for each entry in document order, with its checks and the document's hash."""
    place = F.row_number().over(W.partitionBy(doc).orderBy("position"))
    return entries.withColumn("place", place).join(cells, keys).join(content.select(doc, F.sha2("text", 256).alias("sha256")), doc).select(*keys, "place", "overall", "checks", "sha256")


def checkpoint(entries: DataFrame, path: str) -> None:
    """Replaces the ledger at a path; a reader sees the old or the new one, as the committer renames it into place."""
    entries.write.mode("overwrite").json(path)


def reload(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A ledger to go on from; columns that it lacks are null."""
    return spark.read.schema(schema).json(path)


def remaining(entries: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed run still has to do."""
    return entries.join(done.select(*keys).distinct(), keys, "left_anti")


def result_rows(metrics: DataFrame, names: dict[str, str]) -> DataFrame:
    """A table's rows: a label and a figure in per cent, one for each named metric."""
    cells = F.array(*[F.struct(F.lit(label).alias("label"), F.format_string("%.1f%%", F.col(c) * 100).alias("figure")) for c, label in names.items()])
    return metrics.select(F.inline(cells)).select(F.concat(F.lit("| "), "label", F.lit(" | "), "figure", F.lit(" |")).alias("row"))


def rate(part: Column, whole: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(part, whole), F.lit(0.0)), 6)


def corpus_scores(rows: DataFrame, group: str) -> DataFrame:
    """By group: citations, those of vendors alone, those parsed, those flagged, and the share flagged of what could be checked.
    rows: group, vendor, parsed, flagged."""
    able = ~F.col("vendor") & F.col("parsed")
    out = rows.groupBy(group).agg(F.count("*").alias("n"), F.count_if("vendor").alias("vendor_only"), F.count_if(~F.col("parsed") & ~F.col("vendor")).alias("unparsed"), F.count_if(able).alias("checkable"), F.count_if(able & F.col("flagged")).alias("flagged"))
    return out.withColumn("flagged_rate", rate(F.col("flagged"), F.col("checkable")))


def abstention_scores(rows: DataFrame) -> DataFrame:
    """Of sound citations: how many no source held, how many of these were accused all the same, and whether none was."""
    absent = F.col("existence") == "NOT_FOUND"
    out = rows.agg(F.count("*").alias("n"), F.count_if(absent).alias("absent"), F.count_if(absent & (F.col("overall") == "FLAGGED")).alias("accused"), F.every(~absent | (F.col("overall") != "FLAGGED")).alias("sound"))
    return out.withColumn("absent_share", rate(F.col("absent"), F.col("n"))).withColumn("accused_rate", rate(F.col("accused"), F.col("absent")))


def ratio_summary(rows: DataFrame, group: str, ratio: str) -> DataFrame:
    return rows.groupBy(group).agg(F.round(F.median(ratio), 6).alias("median"), F.round(F.min(ratio), 6).alias("least"), F.count_if(F.col(ratio) == 1).alias("perfect"))


def yields(rows: DataFrame, key: str) -> DataFrame:
    """What an extraction gave: rows, rows with a key, distinct keys, repeats."""
    out = rows.agg(F.count("*").alias("n_rows"), F.count(key).alias("segments"), F.count_distinct(key).alias("unique"))
    return out.withColumn("duplicates", F.col("segments") - F.col("unique"))


def false_positives(negatives: DataFrame, hits: DataFrame, key: str, bucket: int = 1000) -> DataFrame:
    """Negative spans (key, n_id, l_start, l_end) with the number of flagged and of absent entries (key, r_start, r_end, state) that overlap them."""
    def placed(rows: DataFrame, low: str, high: str) -> DataFrame:
        return rows.withColumn("b", F.explode(F.sequence(F.expr(f"{low} div {bucket}"), F.expr(f"greatest({low}, {high} - 1) div {bucket}"))))

    pairs = placed(negatives, "l_start", "l_end").join(placed(hits, "r_start", "r_end"), [key, "b"]).where("l_start < r_end and r_start < l_end")
    n = pairs.dropDuplicates([key, "n_id", "r_start", "r_end", "state"]).groupBy(key, "n_id").agg(F.count_if(F.col("state") == "flagged").alias("flagged"), F.count_if(F.col("state") == "absent").alias("absent"))
    return negatives.select(key, "n_id").join(n, [key, "n_id"], "left").na.fill(0, ["flagged", "absent"])


def progress(rows: DataFrame, key: str, order: list[str], value: Column, every: int = 25) -> DataFrame:
    """Every so many rows, the count and the sum so far."""
    so_far = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("done", F.count("*").over(so_far)).withColumn("total", F.sum(value).over(so_far)).where(F.col("done") % every == 0).select(key, "done", "total")


def reading_candidates(entries: DataFrame, least: int = 40) -> DataFrame:
    """Entries worth a reading: a case with a long enough proposition that was resolved and whose name is not in doubt."""
    return entries.where(F.col("kind").isin("full_case", "short_case", "id", "supra") & (F.length("sentence") >= least) & F.col("cluster_id").isNotNull() & ~F.coalesce("case_name", F.lit("")).isin("FAIL", "AMBIGUOUS"))


def reading_flag(verdict: Column, confidence: Column) -> Column:
    return (verdict == "CONTRADICTED") | ((verdict == "PARTIAL") & (confidence == "high"))


def browser_state(found: Column, similarity: Column, year_gap: Column) -> Column:
    """The simple three-way answer of the browser variants: found, mismatch, yearoff; what is missing is never a mismatch."""
    return F.when(~found, "absent").when(similarity < 0.34, "mismatch").when(F.abs(year_gap) > 1, "yearoff").otherwise("found")
