"""Document fingerprints: I-Match over several randomised lexicon subsets. DataFrame operations only.

The lexicon keeps terms whose inverse document frequency lies in a band. Copies of a text are one
document for the band's upper edge, so that no number of copies takes a text's own terms out of the
lexicon; at the lower edge every row counts. Frequencies are counted per hash bucket of terms, and the lexicon is one bit per bucket: its
size is fixed, so it can stand in every task whatever the corpus's vocabulary.

Each fingerprint part belongs to one randomised subset of the lexicon. Subsets come in scales
(every 2nd, 8th, ... lexicon term) so that, at any document length, some subsets hold about one of
its terms; a part is the hash of the sorted distinct terms of the document in that subset, or a
zero where it has none. A text without lexicon terms has parts of all its own terms. The likeness of two fingerprints is 1 if they are equal, otherwise the
best scale's share of equal parts with terms.

Defined cases: null text is empty; texts without terms have the fingerprint of no terms; a null doc_id stands
last in descending order; equal doc_ids are ordered by a hash of their text; a single document is
its own next document; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docproof.llm._common import shuffle_parts, table

TERM = r"[\p{L}\p{N}]+"
#: Hash buckets of terms; the lexicon has one bit for each.
LEXICON_BITS = 20
#: The band: terms in at most this share of the distinct texts, and in at least this many rows.
MOST_SHARE, LEAST_COUNT = 0.02, 2
#: Every so many-th lexicon term is in a subset of the scale; subsets of each scale.
SCALES, SEEDS = (2, 8, 32, 128, 512, 2048), 12
#: Bounds that a search for a row's range looks at in one step.
STEP = 256


def term_hashes(text: Column) -> Column:
    """The distinct terms of a text as hashes."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), lambda w: F.xxhash64(w)))


def bucket(term: Column) -> Column:
    return F.shiftrightunsigned(term, 64 - LEXICON_BITS).cast("int")


def lexicon(docs: DataFrame, text: str = "text", most_share: float = MOST_SHARE, least_count: int = LEAST_COUNT) -> DataFrame:
    """One row, one column: the bits of the buckets in the band, 64 to a long."""
    words = 1 << (LEXICON_BITS - 6)
    copies = docs.select(F.xxhash64(text).alias("hash"), F.array_distinct(F.transform(term_hashes(F.col(text)), bucket)).alias("buckets"))
    texts = copies.groupBy("hash").agg(F.first("buckets").alias("buckets"), F.count("*").alias("copies"))
    counts = texts.select(F.explode("buckets").alias("bucket"), "copies").groupBy("bucket").agg(F.sum("copies").alias("rows"), F.count("*").alias("df"))
    size = docs.agg(F.count_distinct(F.xxhash64(text)).alias("n"))
    band = counts.where((F.col("rows") >= least_count) & (F.col("df") <= F.greatest(F.lit(float(least_count)), size.scalar() * F.lit(most_share))))
    bits = band.groupBy((F.col("bucket") / 64).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, bucket % 64)")).alias("bits"))
    every = docs.sparkSession.range(0, words, 1, 1).select(F.col("id").cast("int").alias("at"), F.lit(0).cast("long").alias("bits"))
    dense = bits.union(every).groupBy("at").agg(F.bit_or("bits").alias("bits"))
    return dense.agg(F.array_sort(F.collect_list(F.struct("at", "bits"))).alias("x")).select(F.transform("x", lambda r: r["bits"]).alias("bits"))


def with_lexicon_terms(df: DataFrame, name: str, terms: Column, bits: Column) -> DataFrame:
    """Adds `name`, the sorted terms that are in the lexicon, or all terms where none is in it."""

    def has(t: Column) -> Column:
        b = bucket(t)
        return F.get(bits, F.shiftright(b, 6)).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), b % 64)) != 0

    df = df.withColumn(name, terms).withColumn("__in", F.filter(name, has))
    return df.withColumn(name, F.array_sort(F.when(F.size("__in") > 0, F.col("__in")).otherwise(F.col(name)))).drop("__in")


def in_subset(terms: str, seed: int, scale: int) -> Column:
    """A seed looks at its own bits of the term hash; a larger scale keeps a part of the smaller one's terms."""
    return F.filter(terms, lambda t: F.shiftright(t, 4 * seed).bitwiseAND(F.lit(scale - 1).cast("long")) == 0)


def fingerprint_parts(df: DataFrame, name: str, terms: str) -> DataFrame:
    """Adds `name`, the parts of the fingerprint of the sorted lexicon terms in column `terms`."""
    kept = [terms] * SEEDS
    for k, scale in enumerate(SCALES):
        now = [f"__{name}_{k}_{seed}" for seed in range(SEEDS)]
        df = df.select("*", *[in_subset(kept[s], s, scale).alias(now[s]) for s in range(SEEDS)])
        kept = now
    parts = [F.when(F.size(c) > 0, F.hash(c)).otherwise(0) for c in (f"__{name}_{k}_{s}" for k in range(len(SCALES)) for s in range(SEEDS))]
    return df.select("*", F.array(*parts).alias(name)).drop(*[f"__{name}_{k}_{s}" for k in range(len(SCALES)) for s in range(SEEDS)])


def as_text(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    shares = []
    for k in range(len(SCALES)):
        pairs = F.zip_with(F.slice(a, k * SEEDS + 1, SEEDS), F.slice(b, k * SEEDS + 1, SEEDS), lambda x, y: F.when((x == y) & (x != 0), 1).otherwise(0))
        shares.append(F.aggregate(pairs, F.lit(0), lambda sum_, x: sum_ + x) / SEEDS)
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(*shares))


def even_numbers(spark: SparkSession, ranges: int, parts: int) -> list[int]:
    """Ascending numbers for so many ranges that the shuffle's hash deals to all partitions alike: number k goes to partition k modulo parts."""
    found = spark.range(0, 64 * ranges + 64, 1, 1).select("id", F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)).alias("p")).collect()  # some numbers for each range
    free: dict[int, list[int]] = {}
    for r in found[::-1]:
        free.setdefault(r["p"], []).append(r["id"])
    order = sorted(p for p in free for _ in range(-(-ranges // parts)))
    return sorted(free[p].pop() for p in order if free[p])[:ranges] if len(free) == parts else list(range(ranges))


def in_ranges(docs: DataFrame, parts: int) -> DataFrame:
    """Adds `range`: rows dealt by descending doc_id into about two runs of equal length for each partition, and to
    each run, as a ghost, the first row of the run after it (after the last: of the first run)."""
    spark, runs = docs.sparkSession, max(2, 2 * parts)
    cuts = docs.select("doc_id").where("doc_id is not null").agg(F.percentile_approx("doc_id", [k / runs for k in range(1, runs)], F.lit(100 * runs))).first()[0] or []
    cuts = sorted(set(cuts))
    steps = [cuts[k : k + STEP] for k in range(0, len(cuts), STEP)] or [[]]
    heads = F.array(*[F.lit(s[0]).cast("long") for s in steps if s]).cast("array<bigint>")
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    tails = F.array(*[F.array(*[F.lit(x).cast("long") for x in s]).cast("array<bigint>") for s in steps])
    below = lambda xs: F.size(F.filter(xs, lambda b: b < key))
    step = F.greatest(below(heads) - 1, F.lit(0))
    place = step * STEP + below(F.get(tails, step))
    numbers = F.array(*[F.lit(n).cast("int") for n in even_numbers(spark, len(cuts) + 1, parts)])
    rows = docs.withColumn("range", F.get(numbers, place))
    top = F.max_by(F.struct("doc_id", "text"), F.struct(key, F.bitwise_not(F.xxhash64("text"))))
    first = rows.groupBy("range").agg(top.alias("top")).withColumn("to", F.coalesce(F.lead("range").over(W.orderBy("range")), F.min("range").over(W.partitionBy())))
    ghosts = first.select("top.doc_id", "top.text", F.col("to").alias("range"), F.lit(True).alias("ghost"))
    return rows.withColumn("ghost", F.lit(False)).unionByName(ghosts)


def fingerprints(docs: DataFrame, **band: float) -> DataFrame:
    """doc_id, text, edited, next_parts, and the fingerprint parts of text and edited text."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # one row of fixed size (2**LEXICON_BITS bits); Spark takes no subquery inside a lambda
    bits = F.lit(np.array(lexicon(slim, **band).first()[0], np.int64))
    order = W.partitionBy("range").orderBy("ghost", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    rows = (
        in_ranges(slim, shuffle_parts(docs.sparkSession))
        .withColumn("next", F.lead("text").over(order))
        .withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next", F.lit(1), half)))
        .drop("next")
    )
    rows = with_lexicon_terms(rows, "__terms", term_hashes(F.col("text")), bits)
    rows = with_lexicon_terms(rows, "__edited_terms", F.when(F.col("ghost"), F.array().cast("array<bigint>")).otherwise(term_hashes(F.col("edited"))), bits)
    rows = fingerprint_parts(fingerprint_parts(rows, "parts", "__terms"), "edited_parts", "__edited_terms").drop("__terms", "__edited_terms")
    return rows.withColumn("next_parts", F.lead("parts").over(order)).where("not ghost").drop("ghost", "range")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("parts")).alias("fingerprint"), as_text(F.col("edited_parts")).alias("edited_fingerprint"),
        likeness(F.col("parts"), F.col("edited_parts")).alias("near_edited"), likeness(F.col("parts"), F.col("next_parts")).alias("near_next"),
    )
