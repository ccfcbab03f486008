"""Token-id output: a content-addressed store of id streams.

`write` encodes whole texts, cuts each document's id stream where a rolling hash of its last ids says
so, and stores each distinct chunk once, named by its SHA-256. The store has

* objects: (kind, digest, body), bucketed by digest. A chunk's body is its ids, little-endian, 2 bytes
  each if the vocabulary allows, else 4. A recipe's body is the digests of a document's chunks in
  order, and its digest the root of the Merkle tree over them; equal documents share a recipe.
* index: doc_id, n_tokens, root in ascending doc_id order, file after file (null last; equal ids by
  a hash of their text).
* manifest: for each index file its rows, tokens and the hash of its roots in order.

`read_index` and `read_ids` read these files back: every chunk is checked against its name, every
document against its root and every index file against the manifest; a mismatch is an error.

Defined cases: null text is the empty text, which has the end id alone; repeated rows are
indexed each, in unspecified order among themselves; an empty table gives an empty store; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docproof.llm._common import mixed, order_key, row_key, shared_dir, shuffle_parts, small_batches, table, text_bytes, text_slices, tidy
from docproof.llm.tokens import END_ID, default_vocabulary, encoder

#: The rolling hash covers so many ids; a chunk ends at one in 2**CUT_BITS places.
ROLL, CUT_BITS = 16, 9
LEAST, MOST = 64, 2048
CHUNK, RECIPE, DOCUMENT = "chunk", "recipe", "document"
STAGED = "kind string, digest binary, body binary, doc_id long, row long, n_tokens long"


def cut_places(ids: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """For each stream the places after which a chunk ends; the last is the stream's end."""
    sums = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(mixed(ids.astype(np.uint64) + np.uint64(1)), out=sums[1:])
    rolled = mixed(sums[ROLL:] - sums[: max(0, len(sums) - ROLL)])  # of the last ids, whatever stands before them
    marks = np.flatnonzero(rolled >> np.uint64(64 - CUT_BITS) == 0) + ROLL
    out, begin = [], 0
    lows, highs = np.searchsorted(marks, np.append(0, ends[:-1]) + LEAST), np.searchsorted(marks, ends)
    for end, low, high in zip(ends.tolist(), lows.tolist(), highs.tolist(), strict=True):
        cuts, last = [], begin
        for mark in [*marks[low:high].tolist(), end]:
            while mark - last > MOST:
                last += MOST
                cuts.append(last)
            if mark - last >= LEAST or mark == end:
                last = mark
                cuts.append(mark)
        out.append(cuts)
        begin = end
    return out


def merkle_root(digests: list[bytes]) -> bytes:
    level = [hashlib.sha256(b"\0" + d).digest() for d in digests]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + a + b).digest() for a, b in zip(level[::2], level[1::2], strict=False)] + ([level[-1]] if len(level) % 2 else [])
    return hashlib.sha256(len(digests).to_bytes(8, "little") + b"".join(level)).digest()


def _chunker(path: str, end_id: int, width: int, most_seen: int = 300_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = encoder(path), set()
        for batch in batches:
            for part in text_slices(batch):
                ids, ends = enc.encode(text_bytes(part.column("text")), end_id)
                data = ids.astype(f"<u{width}").tobytes()
                rows, begin = [], 0
                if len(seen) > most_seen:
                    seen.clear()
                for doc_id, row, end, cuts in zip(part.column("doc_id").to_pylist(), part.column("row").to_pylist(), ends.tolist(), cut_places(ids, ends), strict=True):
                    digests, first = [], begin
                    for last in cuts:
                        body = data[first * width : last * width]
                        digest = hashlib.sha256(body).digest()
                        digests.append(digest)
                        if digest not in seen:
                            seen.add(digest)
                            rows.append((CHUNK, digest, body, None, None, None))
                        first = last
                    root = merkle_root(digests)
                    if root not in seen:
                        seen.add(root)
                        rows.append((RECIPE, root, b"".join(digests), None, None, None))
                    rows.append((DOCUMENT, root, None, doc_id, row, end - begin))
                    begin = end
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["kind", "digest", "body", "doc_id", "row", "n_tokens"])

    return run


def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the first object of each digest; a task holds all rows of its digests."""
    seen: set[bytes] = set()
    for b in batches:
        kinds, digests = b.column(0).to_pylist(), b.column(1).to_pylist()
        keep = []
        for kind, digest in zip(kinds, digests, strict=True):
            keep.append(kind == DOCUMENT or digest not in seen)
            if kind != DOCUMENT:
                seen.add(digest)
        yield b.filter(pa.array(keep, pa.bool_()))


def write(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID) -> str:
    """Writes the store; returns the name of its objects table."""
    from tokenizers import Tokenizer

    spark, vocabulary = docs.sparkSession, vocabulary or default_vocabulary()
    small_batches(spark, 500)
    parts = shuffle_parts(spark)
    width = 2 if Tokenizer.from_file(vocabulary).get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_key().alias("row"))
    rows = slim.mapInArrow(tidy(_chunker(vocabulary, end_id, width)), STAGED)
    # one bucket is one partition, so chunks are never dealt by digest again
    objects = rows.repartition(parts, "digest").mapInArrow(tidy(once), STAGED)
    name = f"token_objects_{uuid.uuid4().hex}"
    objects.write.option("path", f"{path}/objects").option("compression", "zstd").bucketBy(parts, "digest").partitionBy("kind").saveAsTable(name)
    listed = spark.table(name).where(F.col("kind") == DOCUMENT).select("doc_id", "row", "n_tokens", F.col("digest").alias("root"))
    index = listed.repartitionByRange(parts, order_key()).sortWithinPartitions(order_key(), "row").withColumn("file", F.spark_partition_id())
    index.write.parquet(f"{path}/index")
    index = spark.read.parquet(f"{path}/index")
    manifest(index).withColumn("width", F.lit(width)).coalesce(1).write.parquet(f"{path}/manifest")
    return name


def manifest(index: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct(order_key().alias("k"), "row", F.hex("root").alias("r"))))
    return index.groupBy("file").agg(F.count("*").alias("rows"), F.sum("n_tokens").alias("tokens"), F.sha2(F.array_join(F.transform(ordered, lambda x: x["r"]), ""), 256).alias("root"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, root in the store's order; checks the manifest."""
    index = spark.read.parquet(f"{path}/index")
    said = {r["file"]: r for r in spark.read.parquet(f"{path}/manifest").collect()}  # one row for each index file
    found = {r["file"]: r for r in manifest(index).collect()}
    if said.keys() != found.keys() or any(said[k]["root"] != r["root"] or said[k]["tokens"] != r["tokens"] for k, r in found.items()):
        raise ValueError(f"the index in {path} does not match its manifest")
    before, starts = 0, []
    for k in sorted(said):
        starts.append((k, before))
        before += said[k]["tokens"]
    offsets = spark.createDataFrame(starts, "file int, before long")
    inside = W.partitionBy("file").orderBy(order_key(), "row").rowsBetween(W.unboundedPreceding, 0)
    rows = index.withColumn("upto", F.sum("n_tokens").over(inside)).join(F.broadcast(offsets), "file")
    return rows.select("doc_id", (F.col("before") + F.col("upto") - F.col("n_tokens")).alias("start"), "n_tokens", "root")


def _rebuild(width: int):
    """Rows come sorted by root and place; gives each root's ids, checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, digests, bodies, done, size = None, [], [], [], 0

        def finish() -> None:
            if merkle_root(digests) != root:
                raise ValueError(f"document {root.hex()} does not match its root")
            done.append((root, np.frombuffer(b"".join(bodies), f"<u{width}").astype("<u4").tobytes()))

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array([d[k] for d in done], pa.binary()) for k in (0, 1)], names=["root", "ids"])
            done.clear()
            return out

        for b in batches:
            for r, digest, body in zip(*(b.column(k).to_pylist() for k in ("root", "digest", "body")), strict=True):
                if body is None or hashlib.sha256(body).digest() != digest:
                    raise ValueError(f"chunk {digest.hex()} is missing or damaged")
                if r != root and digests:
                    finish()
                    size += len(done[-1][1])
                    digests, bodies = [], []
                root = r
                digests.append(digest)
                bodies.append(body)
            if size > 4 << 20:
                yield flush()
                size = 0
        if digests:
            finish()
        yield flush()

    return run


def read_ids(spark: SparkSession, path: str, name: str) -> DataFrame:
    """root and its ids (little-endian unsigned 32-bit) for each distinct document."""
    small_batches(spark, 2000)
    first = spark.read.parquet(f"{path}/manifest").select("width").first()
    objects = spark.table(name)
    places = F.sequence(F.lit(0), F.expr("cast(length(body) div 32 as int) - 1"))
    refs = objects.where(F.col("kind") == RECIPE).select(F.col("digest").alias("root"), F.posexplode(F.transform(places, lambda i: F.substring(F.col("body"), i * 32 + 1, F.lit(32)))).alias("place", "digest"))
    chunks = objects.where(F.col("kind") == CHUNK).select("digest", "body")
    parts = refs.join(chunks.hint("merge"), "digest", "left")
    dealt = parts.repartition(shuffle_parts(spark), "root").sortWithinPartitions("root", "place").select("root", "digest", "body")
    return dealt.mapInArrow(tidy(_rebuild(first[0] if first else 4)), "root binary, ids binary")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "token-store")
    name = write(table(spark, sf_dir, "documents"), path)
    index = read_index(spark, path)
    sums = read_ids(spark, path, name).select("root", F.crc32("ids").alias("ids_crc32"))
    return index.join(sums, "root").select("doc_id", "start", "n_tokens", "ids_crc32")
