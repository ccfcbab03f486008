"""Substring deduplication by difference-cover anchors.

A word is removed where a window of `window` consecutive words over it also starts in a document
with a smaller doc_id. Hashes are taken only at word places that a difference cover modulo PERIOD
holds: whatever the places of two equal windows, some shift below PERIOD brings both to cover
places, so both send the same anchor of window - PERIOD + 1 words. Occurrences whose whole surroundings
repeat are settled by two hashes; around the others the windows that hold the anchor are compared by two
independent hashes (see _passages for the exchange).

Defined cases: null and empty texts have no words; documents shorter than the window lose nothing;
a null doc_id stands after all others; rows with one doc_id do not affect each other and equal rows
get equal results; an empty table gives no rows; further columns are ignored or, if named, kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from docproof.llm import _passages as P
from docproof.llm._common import mixed, table, text_bytes, text_slices, tidy

WINDOW = 50
#: A perfect difference set: every difference modulo PERIOD occurs between two of its places.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)

_cover = np.isin(np.arange(PERIOD), COVER)


class Words:
    """The words of some texts as hashes: those of text k stand at first[k] .. first[k] + count[k]."""

    def __init__(self, texts: list[bytes]):
        parts = [t.split() for t in texts]
        self.count = np.array([len(p) for p in parts], np.int64)
        self.first = np.cumsum(self.count) - self.count
        # two 64-bit names of each word, the halves of a 128-bit hash that is no polynomial in the word's bytes
        names = np.frombuffer(b"".join(map(xxh3_128_digest, chain.from_iterable(parts))), "<u8").reshape(-1, 2)
        self.hashes, self.second = np.ascontiguousarray(names[:, 0]), np.ascontiguousarray(names[:, 1])
        self.owner = np.repeat(np.arange(len(texts)), self.count)
        self.place = np.arange(len(names)) - self.first[self.owner]

    def prefixes(self) -> Iterator[P.Prefixes]:
        """Two independent names of any run of words."""
        yield P.Prefixes(self.hashes, 0)
        yield P.Prefixes(self.second, 1)


def anchors(window: int):
    width, reach = window - PERIOD + 1, PERIOD - 1

    def entries(part: pa.RecordBatch) -> tuple:
        w = Words(text_bytes(part.column("text")))
        n = w.count[w.owner]
        at = np.flatnonzero(_cover[w.place % PERIOD] & (w.place + width <= n) & (n >= window))
        sums, around = w.prefixes()
        begin = w.first[w.owner[at]]
        low, high = np.maximum(begin, at - reach), np.minimum(begin + n[at], at + window)
        shape = mixed(((at - low) * (2 * window + PERIOD) + high - low).astype(np.uint64))
        return (w.owner[at], w.place[at], mixed(sums.ranges(at, at + width)), mixed(around.ranges(low, high)) ^ shape), None

    return entries


def windows(window: int):
    """The windows that hold an open anchor, and the settled places to pass on."""
    reach = PERIOD - 1

    def entries(part: pa.RecordBatch) -> tuple:
        payloads = part.column("payloads").to_pylist()
        w = Words(text_bytes(part.column("text")))
        k, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, own in enumerate(payloads):
            places = P.positions(own, P.OPEN)
            if len(places):
                mark = np.zeros(w.count[i] + 1, np.int64)
                np.add.at(mark, np.maximum(0, places - reach), 1)
                np.add.at(mark, np.minimum(places, w.count[i] - window) + 1, -1)
                at.append(np.flatnonzero(np.cumsum(mark) > 0))
                k.append(np.full(len(at[-1]), i))
        k, at = np.concatenate(k), np.concatenate(at)
        begin = w.first[k] + at
        h, c = (mixed(sums.ranges(begin, begin + window)) for sums in w.prefixes())
        return (k, at, h, c), P.settled_before(part)

    return entries


def removed_ranges(payloads: list[bytes] | None, n: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    settled, covered = P.positions(payloads, P.SETTLED), P.positions(payloads, P.COVERED)
    starts = np.concatenate([np.maximum(0, settled - PERIOD + 1), covered])
    return P.merged(starts, np.concatenate([np.minimum(n, settled + window), covered + window]))


def _finisher(window: int, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                counts, kept, spans = [], [], []
                for text, own in zip(text_bytes(part.column("text")), part.column("payloads").to_pylist(), strict=True):
                    words = text.split()
                    starts, ends = removed_ranges(own, len(words), window)
                    spans.append([{"start": int(a), "end": int(b)} for a, b in zip(starts, ends, strict=True)])
                    counts.append(len(words))
                    for a, b in zip(starts[::-1], ends[::-1], strict=True):
                        del words[a:b]
                    kept.append(b" ".join(words).decode())
                cols = [part.column("doc_id"), part.column("text"), *[part.column(f"__keep{k}") for k in range(keep)]]
                span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64()), pa.array(spans, span_type), pa.array(kept, pa.string())], names=["doc_id", "text", *[f"__keep{k}" for k in range(keep)], "n_words", "spans", "kept_text"])

    return run


def dedup(docs: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, the kept columns, n_words, spans (removed word runs) and kept_text of every row."""
    buckets = P.bucket_count(docs)
    base = P.base_rows(docs, keep)
    first = P.exchanged(base.mapInArrow(tidy(P.sender(anchors(window), buckets, False, P.SETTLED)), P.OUT), buckets)
    places = P.answers(first.mapInArrow(tidy(P.reducer(P.anchors_decided(False), buckets)), P.OUT), buckets)
    second = P.exchanged(base.join(places, ["doc", "row"]).mapInArrow(tidy(P.sender(windows(window), buckets, False, P.COVERED)), P.OUT), buckets)
    covered = P.answers(second.mapInArrow(tidy(P.reducer(P.classes_decided(False), buckets)), P.OUT), buckets)
    types = dict(docs.dtypes)
    schema = ", ".join(["doc_id long", "text string", *[f"__keep{k} {types[c]}" for k, c in enumerate(keep)], "n_words long", "spans array<struct<start:long,end:long>>", "kept_text string"])
    out = base.join(covered, ["doc", "row"], "left").mapInArrow(tidy(_finisher(window, len(keep))), schema)
    return out.select("doc_id", "text", *[F.col(f"__keep{k}").alias(c) for k, c in enumerate(keep)], "n_words", "spans", "kept_text")


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))
