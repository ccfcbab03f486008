"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame operations only.

Targets: sources in code point order (null last) weigh 1, 2, 3, repeating, and share the sum of all
sizes; a target stops at `cap` times its source's size and the excess is shared again by weight
until none is above (one pass over the sources ordered by cap/weight finds that level).

Schedule: slot i of N has the van der Corput point of i (its bits reversed), which the cumulative
targets map to a source; slots are ranked within their source. Each source's documents lie in a
hash-shuffled order as one stream of words, repeated up to `cap` times and cut into blocks of
equally many words; the slot of rank r takes block r. The block size is the total over 2**20,
at least one word, so there are at most 2**20 slots at any input size. Whole blocks miss a target by
up to some blocks, and sources smaller than a block may get none; `exact` adds what is missing as
last, partial blocks and cuts what is over, so that each source gives its target rounded to words.
op9_mixing takes whole blocks only, as its SQL states; the pipeline's mix is exact.

A document's place in its stream is found in two levels (hash bucket, then place in the bucket), so
no task holds a whole source.

Defined cases: null text has size 0 and is never taken; a null source is one source, the last;
repeated rows count each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docproof.llm._common import WORD, saved, table

SLOT_BITS = 20
#: Equal parts of [0, 1) by which points and the sources' intervals are joined.
BINS = 4096
#: Hexadecimal digits of a document's hash that name its bucket in the source's stream: 4,096 buckets, so that one holds some hundred
#: thousand documents where a source has a thousand million.
BUCKET_DIGITS = 3


def source_key(column: str = "source"):
    """Sorts as the source does by code point, null last."""
    return F.when(F.col(column).isNull(), F.lit("t")).otherwise(F.concat(F.lit("s"), F.col(column)))


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """source, source_size, target for rows of source and size."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ratio = W.orderBy("ratio", "source")
    rows = (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("place", F.row_number().over(W.orderBy("source")) - 1)
        .withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * cap)
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(W.partitionBy()))
        .withColumn("below", F.sum("most").over(ratio.rowsBetween(W.unboundedPreceding, -1)))
        .withColumn("rest", F.sum("weight").over(ratio.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.coalesce("below", F.lit(0))) / F.col("rest"))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source", "level"))).over(W.partitionBy())["level"])
    )
    return rows.select("source", "source_size", "total", F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def block_words(slot_bits: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col("total") / (1 << slot_bits))).cast("long")


def schedule(shares: DataFrame, slot_bits: int = SLOT_BITS) -> DataFrame:
    """source, rank, block_words: which block of which source each slot takes."""
    points = 1 << slot_bits
    spark = shares.sparkSession
    by_source = W.orderBy("source")
    spans = (
        shares.withColumn("up_to", F.sum(F.round(F.col("target") * 1000).cast("long")).over(by_source.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("all_of_it", F.max("up_to").over(W.partitionBy()))
        .withColumn("high", F.try_divide("up_to", "all_of_it"))
        .withColumn("low", F.coalesce(F.lag("high").over(by_source), F.lit(0.0)))
        .where("high > low")
        .withColumn("block_words", block_words(slot_bits))
        .withColumn("slots", F.ceil(F.col("total") / F.col("block_words")))
        .withColumn("bin", F.explode(F.sequence(F.floor(F.col("low") * BINS), F.least(F.lit(BINS - 1).cast("long"), F.floor(F.col("high") * BINS)))))
    )
    slots = (
        spark.range(points)
        .withColumn("point", F.conv(F.reverse(F.lpad(F.bin("id"), slot_bits, "0")), 2, 10).cast("long") / points)
        .withColumn("bin", F.floor(F.col("point") * BINS))
    )
    hit = slots.join(spans, "bin").where("id < slots and low <= point and point < high")
    return hit.select("source", (F.row_number().over(W.partitionBy("source").orderBy("id")) - 1).cast("long").alias("rank"), "block_words")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, slot_bits: int = SLOT_BITS, exact: bool = True) -> DataFrame:
    """What the mix takes of each document: doc_id, row_key, size, source_size, target, segments.

    segments lists the taken word runs as (copy, start, length): copy counts the stream's
    repetitions from 0. Words are numbered in the document from 0."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("doc_id", "text", F.col("text").isNull()).alias("row_key"),
        source_key().alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(text))).alias("place"),
    ).withColumn("uid", F.monotonically_increasing_id())
    sized = saved(sized, "mix")  # texts are read and counted once
    shares = saved(targets(sized, weights, cap), "shares")  # one row a source
    slots = saved(schedule(shares, slot_bits), "slots")  # at most 2**slot_bits
    bucket = F.conv(F.substring("place", 1, BUCKET_DIGITS), 16, 10).cast("int")
    placed = sized.withColumn("bucket", bucket)
    taken_up_to = slots.groupBy("source").agg((F.count("*") * F.max("block_words")).alias("reach"), F.max("block_words").alias("block_words"))
    facts = shares.join(taken_up_to, "source", "left")
    if exact:
        facts = facts.withColumn("block_words", block_words(slot_bits)).withColumn("whole", F.coalesce("reach", F.lit(0))).withColumn("reach", F.round("target").cast("long"))
        missed = facts.where("reach > whole").select("source", F.explode(F.expr("sequence(whole div block_words, (reach - 1) div block_words)")).alias("rank"), "block_words")
        slots, facts = slots.unionByName(missed), facts.drop("whole")
    before = (
        placed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
        .withColumn("before", F.sum("words").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("words"))
        .select("source", "bucket", "before")
        .join(facts, "source")  # few rows; the documents then meet all of it by source and bucket, never by source alone
    )
    inside = W.partitionBy("source", "bucket").orderBy("place", "uid").rowsBetween(W.unboundedPreceding, 0)
    streams = (
        placed.withColumn("upto", F.sum("size").over(inside))
        .join(before, ["source", "bucket"])
        .withColumn("first", F.col("before") + F.col("upto") - F.col("size"))
        .drop("before", "upto", "bucket", "place")
    )
    copies = (
        streams.where("size > 0 and reach is not null")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(cap - 1))))
        .withColumn("begin", F.col("first") + F.col("copy") * F.col("source_size"))
        .where("begin < reach")
        .withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("reach")))
        .withColumn("rank", F.explode(F.sequence(F.expr("begin div block_words"), F.expr("(end - 1) div block_words"))))
        .select("uid", "source", "copy", "begin", "end", "rank")
    )
    runs = (
        copies.join(slots, ["source", "rank"])
        .withColumn("from", F.greatest("begin", F.col("rank") * F.col("block_words")))
        .withColumn("to", F.least("end", (F.col("rank") + 1) * F.col("block_words")))
        .groupBy("uid", "copy")  # the blocks taken of a copy follow each other: ranks are gapless
        .agg(F.min(F.col("from") - F.col("begin")).alias("start"), F.sum(F.col("to") - F.col("from")).alias("length"))
        .groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("copy", "start", "length"))).alias("segments"))
    )
    none = F.array().cast("array<struct<copy:int,start:bigint,length:bigint>>")
    return streams.join(runs, "uid", "left").select("doc_id", "row_key", "size", "source_size", "target", F.coalesce("segments", none).alias("segments"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), exact=False)
    taken = F.aggregate("segments", F.lit(0).cast("long"), lambda sum_, x: sum_ + x["length"])
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS place
  FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS most,
         CAST(sum(source_size) OVER () AS BIGINT) AS total
  FROM per
), ranked AS (
  SELECT *, most / weight AS ratio FROM weighed
), levels AS (
  SELECT *, (total - coalesce(CAST(sum(most) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
            / CAST(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level
  FROM ranked
), shares AS (
  SELECT source, source_size, total,
         least(CAST(most AS DOUBLE), (SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1) * weight) AS target
  FROM levels
), spans AS (
  SELECT *, CAST(sum(CAST(round(target * 1000) AS BIGINT)) OVER (ORDER BY source NULLS LAST) AS BIGINT) AS up_to,
         greatest(1, CAST(ceil(total / 1048576) AS BIGINT)) AS block_words
  FROM shares
), bounds AS (
  SELECT *, up_to / (SELECT max(up_to) FROM spans) AS high,
         coalesce(lag(up_to) OVER (ORDER BY source NULLS LAST), 0) / (SELECT max(up_to) FROM spans) AS low
  FROM spans
), points AS (
  SELECT i, list_sum(list_transform(range(20), lambda k: ((i >> k) & 1) << (19 - k))) / 1048576 AS point
  FROM (SELECT unnest(range(0, CAST((SELECT max(ceil(total / block_words)) FROM spans) AS BIGINT))) AS i)
), reached AS (
  SELECT source, count(*) * max(block_words) AS reach FROM points JOIN bounds ON low <= point AND point < high GROUP BY source
), streams AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY place, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS first FROM sized
)
SELECT t.doc_id, t.size, s.source_size, s.target,
       CAST(coalesce((SELECT sum(greatest(0, least(t.first + t.size + c * s.source_size, r.reach) - (t.first + c * s.source_size))) FROM range(3) AS q(c)), 0) AS BIGINT) AS taken
FROM streams t JOIN shares s ON t.source IS NOT DISTINCT FROM s.source
LEFT JOIN reached r ON t.source IS NOT DISTINCT FROM r.source
"""
