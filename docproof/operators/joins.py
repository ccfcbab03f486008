"""Joins that the audit of references is made of, without a nested loop over a whole side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docproof.sources.tables import sized_broadcast


def asof_backward(rows: DataFrame, key: str, order: Sequence[str], is_source: Column, value: Column, name: str) -> DataFrame:
    """Adds the value of the latest earlier source row of the same key (one shuffle, one sort)."""
    before = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(F.when(is_source, value), ignorenulls=True).over(before))


def adjacent_groups(rows: DataFrame, key: str, order: Sequence[str], follows: Column, name: str) -> DataFrame:
    """Numbers islands: a row for which `follows` (over columns prev_*) holds joins the group before it."""
    w = W.partitionBy(key).orderBy(*order)
    with_prev = rows.select("*", *[F.lag(c).over(w).alias(f"prev_{c}") for c in rows.columns if c != key])
    new = F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)
    out = with_prev.withColumn("__new", new).withColumn(name, F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return out.drop("__new", *[f"prev_{c}" for c in rows.columns if c != key])


def nearest_interval(left: DataFrame, right: DataFrame, key: str, most_gap: int, bucket: int = 1000) -> DataFrame:
    """The nearest right interval of each left interval within a gap on either side, ties to the smaller right start,
    and none if another right interval lies in between.

    left: key, l_id, l_start, l_end; right: key, r_id, r_start, r_end. Intervals meet by position bucket, so the
    equi-join stays local however many a document holds."""
    reach = left.withColumn("b", F.explode(F.sequence(F.expr(f"(l_start - {most_gap}) div {bucket} - 1"), F.expr(f"(l_end + {most_gap}) div {bucket} + 1"))))
    placed = right.withColumn("b", F.explode(F.sequence(F.expr(f"r_start div {bucket}"), F.expr(f"r_end div {bucket}"))))
    gap = F.when(F.col("r_start") >= F.col("l_end"), F.col("r_start") - F.col("l_end")).when(F.col("r_end") <= F.col("l_start"), F.col("l_start") - F.col("r_end")).otherwise(0)
    pairs = reach.join(placed, [key, "b"]).withColumn("gap", gap).where(F.col("gap") <= most_gap).drop("b").dropDuplicates([key, "l_id", "r_id"])
    # nothing of the right side lies between the nearest one and the left interval: anything there would be nearer
    rank = F.row_number().over(W.partitionBy(key, "l_id").orderBy("gap", "r_start", "r_id"))
    return pairs.withColumn("rank", rank).where("rank = 1").drop("rank")


def overlaps(a_start: str, a_end: str, b_start: str, b_end: str) -> Column:
    return (F.col(a_start) < F.col(b_end)) & (F.col(b_start) < F.col(a_end))


def anti_overlap(left: DataFrame, right: DataFrame, key: str, bucket: int = 1000) -> DataFrame:
    """Left intervals (key, l_id, l_start, l_end, ...) that no right one (key, r_start, r_end) overlaps."""
    spread = left.select(key, "l_id", "l_start", "l_end", F.explode(F.sequence(F.expr(f"l_start div {bucket}"), F.expr(f"greatest(l_start, l_end - 1) div {bucket}"))).alias("b"))
    placed = right.select(key, "r_start", "r_end", F.explode(F.sequence(F.expr(f"r_start div {bucket}"), F.expr(f"greatest(r_start, r_end - 1) div {bucket}"))).alias("b"))
    hit = spread.join(placed, [key, "b"]).where(overlaps("l_start", "l_end", "r_start", "r_end")).select(key, "l_id").distinct()
    return left.join(hit, [key, "l_id"], "left_anti")


def in_bands(rows: DataFrame, value: str, bands: DataFrame, low: str, high: str, width: int) -> DataFrame:
    """Rows with the bands that hold value in [low, high): by equi-join on value buckets of a width."""
    spread = bands.withColumn("__b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width))))
    return rows.withColumn("__b", F.floor(F.col(value) / width)).join(sized_broadcast(spread), "__b").where((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("__b")


def first_found(rows: DataFrame, lookups: Sequence[tuple[DataFrame, Column, str]], value: str) -> DataFrame:
    """Left joins in order of preference; the first hit gives the value and its source."""
    out, values, names = rows, [], []
    for k, (table, on, name) in enumerate(lookups):
        out = out.join(table.withColumnRenamed(value, f"__v{k}"), on, "left")
        values.append(F.col(f"__v{k}"))
        names.append(F.when(F.col(f"__v{k}").isNotNull(), F.lit(name)))
    return out.withColumn(value, F.coalesce(*values)).withColumn("found_in", F.coalesce(*names))


def walk(rows: DataFrame, node: str, parent: str, hops: int = 10) -> DataFrame:
    """node, root, hops: follows parents until there is none, exactly `hops` times at most. Jumps of 1, 2, 4, ... steps are built by
    doubling and composed for the bits of `hops`, so the number of joins grows with its logarithm. A node given twice has
    its smallest parent; in a cycle the bound ends the walk."""
    jump = rows.groupBy(F.col(node).alias("node")).agg(F.min(parent).alias("up"))
    jump = jump.select("node", F.coalesce("up", "node").alias("to"), F.when(F.col("up").isNull(), 0).otherwise(1).alias("n"))

    def followed(first: DataFrame, then: DataFrame) -> DataFrame:
        then = then.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("n").alias("n2"))
        return first.join(then, "to", "left").select("node", F.coalesce("to2", "to").alias("to"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"))

    out = None
    while True:
        if hops & 1:
            out = jump if out is None else followed(out, jump)
        hops >>= 1
        if not hops:
            break
        jump = followed(jump, jump)
    if out is None:
        out = jump.select("node", F.col("node").alias("to"), F.lit(0).alias("n"))
    return out.select("node", F.col("to").alias("root"), F.col("n").alias("hops"))


def word_grams(text: Column, n: int) -> Column:
    """All runs of n words (split at blanks), as strings. The words are bound to a lambda variable: an expression named
    inside a lambda would be evaluated again for each run."""

    def grams(w: Column) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, found).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(F.array(F.split(text, r"[\x20\x09-\x0D]+")), grams))


def gram_hashes(text: Column, n: int) -> Column:
    """The hashes of all runs of n words."""

    def grams(w: Column) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.xxhash64(F.slice(w, i, n)))
        return F.when(F.size(w) >= n, found).otherwise(F.array().cast("array<bigint>"))

    return F.flatten(F.transform(F.array(F.transform(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: F.xxhash64(x))), grams))


def passages_in(docs: DataFrame, passages: DataFrame, anchor_words: int = 4) -> DataFrame:
    """doc_id, item_id, start of every passage that stands in a document, at any character.

    The words inside a passage (its first and last may be cut) stand whole in the document; the first run of them
    is the anchor. Documents meet passages by the hash of their word runs, and the text is compared for
    these pairs only. Passages too short for an anchor are compared with every document, the only nested
    loop, over a side whose size is checked."""
    inner = F.slice(F.transform(F.split(F.trim("p_text"), r"[\x20\x09-\x0D]+"), lambda x: F.xxhash64(x)), 2, anchor_words)
    rows = passages.select("item_id", F.col("text").alias("p_text")).withColumn("anchor", F.when(F.size(F.split(F.trim("p_text"), r"[\x20\x09-\x0D]+")) >= anchor_words + 2, F.xxhash64(inner)))
    long, short = rows.where("anchor is not null"), rows.where("anchor is null")
    keys = long.select(F.col("anchor").alias("h"), "item_id", "p_text")
    grams = docs.select("doc_id", F.explode(gram_hashes(F.col("text"), anchor_words)).alias("h"))
    candidates = grams.join(sized_broadcast(keys.select("h", "item_id")), "h").select("doc_id", "item_id").distinct()
    found = candidates.join(docs.select("doc_id", "text"), "doc_id").join(sized_broadcast(keys.select("item_id", "p_text")), "item_id")
    if short.limit(1).count():
        found = found.select("doc_id", "item_id", "text", "p_text").unionByName(docs.select("doc_id", "text").join(sized_broadcast(short.select("item_id", "p_text")), F.col("text").contains(F.col("p_text"))))
    return found.where(F.col("text").contains(F.col("p_text"))).select("doc_id", "item_id", (F.expr("locate(p_text, text)") - 1).cast("long").alias("start"), F.length("p_text").cast("long").alias("n_chars"))


def gram_candidates(left: DataFrame, right: DataFrame, n: int, most_anchors: int = 40) -> DataFrame:
    """left_id, right_id, shared: pairs of (id, text) rows that share word runs; each right row asks with its first anchors."""
    a = left.select(F.col("id").alias("left_id"), F.explode(F.array_distinct(word_grams(F.col("text"), n))).alias("g"))
    b = right.select(F.col("id").alias("right_id"), F.explode(F.array_distinct(F.slice(word_grams(F.col("text"), n), 1, most_anchors))).alias("g"))
    return a.join(b, "g").groupBy("left_id", "right_id").agg(F.count("*").alias("shared"))


def first_overlap(gold: DataFrame, found: DataFrame, key: str, bucket: int = 1000) -> DataFrame:
    """Each gold span (key, g_id, l_start, l_end) with the first found span (key, r_id, r_start, r_end) that overlaps it, or null. Spans
    meet by position bucket, so a document with many of them is spread."""
    def placed(rows: DataFrame, low: str, high: str) -> DataFrame:
        return rows.withColumn("b", F.explode(F.sequence(F.expr(f"{low} div {bucket}"), F.expr(f"greatest({low}, {high} - 1) div {bucket}"))))

    pairs = placed(gold, "l_start", "l_end").join(placed(found, "r_start", "r_end"), [key, "b"]).where(overlaps("l_start", "l_end", "r_start", "r_end"))
    hit = pairs.groupBy(key, "g_id").agg(F.min("r_id").alias("r_id"))
    return gold.select(key, "g_id").join(hit, [key, "g_id"], "left")


def first_paragraph(paragraphs: DataFrame, findings: DataFrame, doc: str) -> DataFrame:
    """Each finding (doc, f_id, text) with the first paragraph (doc, paragraph, text) of its document that holds it, white space aside."""
    def flat(rows: DataFrame, name: str) -> DataFrame:
        return rows.withColumn(name, F.trim(F.regexp_replace("text", r"\s+", " "))).drop("text")

    pairs = flat(findings, "__f").join(flat(paragraphs, "__p"), doc).where(F.col("__p").contains(F.col("__f")))
    return findings.select(doc, "f_id").join(pairs.groupBy(doc, "f_id").agg(F.min("paragraph").alias("paragraph")), [doc, "f_id"], "left")
