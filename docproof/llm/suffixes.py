"""Exact byte-level deduplication by suffix sorting.

A byte is removed where a string of `length` bytes over it also starts earlier (in a smaller doc_id, or
earlier in the same document). Strings are named by an anchor: of the k-grams in a string, the one
with the smallest hash, the leftmost of equals. Equal strings have equal anchors, so all that is to be
compared meets in one place (see _passages for the exchange). There the surroundings of the anchors
that one hash does not settle are laid end to end and their suffixes are sorted by the linear
grouping construction (SuffixGroups.java); suffixes that share `length` bytes stand side by
side, and of each such run all but the earliest string are covered. An anchor with more surroundings than a
block holds is sorted in several blocks; the earliest string of each run then meets those of the other blocks by name.

Defined cases: null and empty texts have no bytes; texts shorter than `length` lose nothing; a null
doc_id stands after all others; rows with one doc_id and different texts are ordered by a hash of
their text, equal rows get equal results; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docproof.llm import _passages as P
from docproof.llm._common import mixed, ragged, table, text_bytes, text_slices, tidy
from docproof.llm.suffix_sort import register

LENGTH = 100
#: Text bytes at a time; each takes about 100 bytes of arrays.
SLICE = 512 << 10


def gram(length: int) -> int:
    """The anchor's length: long enough to be rare, short enough to leave a wide choice of places."""
    return max(1, length * 2 // 5)


class Bytes:
    """Texts laid end to end, one byte between them; text k stands at first[k] .. last[k]."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
        self.last = ends - 1
        self.first = ends - np.array([len(t) + 1 for t in texts], np.int64)
        self.sums = P.Prefixes(P.byte_values(self.data))

    def around_sums(self) -> P.Prefixes:
        """Names that are independent of `sums`."""
        return P.Prefixes(P.byte_values(self.data, 1), 1)

    def around(self, owner: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """All that strings with this anchor can hold."""
        return np.maximum(self.first[owner], at - (length - gram(length))), np.minimum(self.last[owner], at + length)


def anchors(length: int):
    k = gram(length)
    choice = length - k + 1

    def entries(part: pa.RecordBatch) -> tuple:
        b = Bytes(text_bytes(part.column("text")))
        hashes = mixed(b.sums.sliding(k))
        bits = np.uint64(len(b.data).bit_length())
        least = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
        reach = 1
        while 2 * reach <= choice:
            least, reach = np.minimum(least[:-reach], least[reach:]), 2 * reach
        if reach < choice:
            least = np.minimum(least[: len(least) - (choice - reach)], least[choice - reach :])
        owner = np.repeat(np.arange(len(b.first)), b.last - b.first + 1)
        inside = np.arange(len(least)) + length <= b.last[owner[: len(least)]]
        chosen = np.zeros(len(b.data), bool)
        chosen[(least[inside] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)] = True
        at = np.flatnonzero(chosen)
        own = owner[at]
        low, high = b.around(own, at, length)
        shape = mixed(((at - low) * (4 * length) + high - low).astype(np.uint64))
        return (own, at - b.first[own], hashes[at], mixed(b.around_sums().ranges(low, high)) ^ shape), None

    return entries


HEAD = (("h", "<u8"), ("doc", "<i8"), ("row", "<i8"), ("low", "<u4"), ("size", "<u4"))
HEAD_BYTES = sum(np.dtype(t).itemsize for _, t in HEAD)


def read_head(payload: bytes) -> tuple[dict[str, np.ndarray], int]:
    """The columns of some surroundings, and where their bytes begin."""
    n, at, cols = int(np.frombuffer(payload, "<u4", 1)[0]), 4, {}
    for name, kind in HEAD:
        cols[name] = P.unplaned(payload, kind, n, at)
        at += n * cols[name].itemsize
    return cols, at


def write_head(cols: dict[str, np.ndarray]) -> bytes:
    return np.uint32(len(cols["h"])).tobytes() + b"".join(P.planed(cols[name].astype(kind)) for name, kind in HEAD)


def context_sender(length: int, buckets: int):
    """Sends the surroundings of open anchors to the buckets of their anchors, and passes on settled ones."""
    k = gram(length)

    def flush(held: list[tuple], through: list[tuple]) -> Iterator[tuple[int, int, bytes]]:
        if through:
            yield from P.answer(*(np.concatenate(x) for x in zip(*through, strict=True)), P.SETTLED, buckets)
        if not held:
            return
        cols = {name: np.concatenate([x[f] for x in held]) for f, (name, _) in enumerate(HEAD)}
        data = np.concatenate([x[5] for x in held])
        begin = np.cumsum(cols["size"]) - cols["size"]
        bucket = P.bucket_of(cols["h"], buckets)
        order = np.argsort(bucket, kind="stable")
        for a, b in P.runs(P.starts_of(bucket[order])):
            at = order[a:b]
            yield 0, int(bucket[at[0]]), write_head(P.take(cols, at)) + data[ragged(begin[at], cols["size"][at])].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, through, bytes_held = [], [], 0
        for batch in batches:
            for part in text_slices(batch, "text", SLICE):
                payloads = part.column("payloads").to_pylist()
                if settled := P.settled_before(part):
                    through.append(settled)
                places = [P.positions(own, P.OPEN) for own in payloads]
                own = np.repeat(np.arange(len(places)), [len(x) for x in places])
                if not len(own):
                    continue
                b = Bytes(text_bytes(part.column("text")))
                at = np.concatenate(places) + b.first[own]
                low, high = b.around(own, at, length)
                doc, row = (part.column(x).to_numpy(zero_copy_only=False)[own] for x in ("doc", "row"))
                held.append((mixed(b.sums.ranges(at, at + k)), doc, row, low - b.first[own], high - low, b.data[ragged(low, high - low)]))
                bytes_held += len(held[-1][5])
                if bytes_held >= P.FLUSH_BYTES // 2:
                    yield from P.in_batches(flush(held, through))
                    held, through, bytes_held = [], [], 0
        yield from P.in_batches(flush(held, through))

    return run


#: Bytes whose suffixes are sorted at a time; the sorter takes about 50 bytes for each. Bytes of a bucket that are taken up at a
#: time: a bucket with more, which one anchor's many surroundings may make, is sorted in parts whose classes are joined by name.
BLOCK, HOLD = 512 << 10, 4 << 20
BLOCKS = "kind int, key long, payload binary, text binary, ends binary"
#: Kinds of rows: surroundings (0), answers (1), and surroundings of anchors that other blocks may hold as well.
PARTED = 2


def gatherer(most: int, hold: int):
    """The surroundings of whole anchors end to end, about `most` bytes a row; rows for documents pass through."""
    names = ["kind", "key", "payload", "text", "ends"]
    def passed(through: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in through:
            none = pa.nulls(len(b), pa.binary())
            yield pa.record_batch([*b.columns, none, none], names=names)
        through.clear()

    def blocks(key: int, payloads: list[bytes], parted: bool) -> Iterator[pa.RecordBatch]:
        heads, texts = [], []
        for p in payloads:
            cols, at = read_head(p)
            heads.append(cols)
            texts.append(np.frombuffer(p, np.uint8, offset=at))
        cols = {name: np.concatenate([x[name] for x in heads]) for name, _ in HEAD}
        data, size = np.concatenate(texts), cols["size"]
        begin = np.cumsum(size, dtype=np.int64) - size
        order = np.argsort(cols["h"], kind="stable")
        before = np.cumsum(size[order], dtype=np.int64) - size[order]
        first = P.starts_of(cols["h"][order])
        owner = np.cumsum(first) - 1  # an anchor that fills more than a block by itself is parted
        wide = np.bincount(owner, size[order]) > most if len(owner) else np.zeros(0, bool)
        cut = first | wide[owner]
        block = np.maximum.accumulate(np.where(cut, before // most, 0))
        own = np.zeros(len(order), bool)
        own[np.flatnonzero(first)] = wide[owner[first]] | np.append(False, wide[owner[first]][:-1])  # wide anchors share no block
        number = np.cumsum(P.starts_of(block) | own)
        for a, b in P.runs(P.starts_of(number)):
            at = order[a:b]
            ends = np.cumsum(size[at], dtype=np.int64).astype("<u4").tobytes()
            kind = PARTED if parted or wide[owner[a]] else 0
            row = [[kind], [key], [write_head(P.take(cols, at))], [data[ragged(begin[at], size[at])].tobytes()], [ends]]
            yield pa.record_batch([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        through: list[pa.RecordBatch] = []
        held_key, parted = None, False
        held: list[bytes] = []
        size = 0
        for key, payloads in P.by_key(batches, through, one_by_one=True):
            yield from passed(through)
            if key < 0:
                continue
            if held and (key != held_key or size >= hold):
                same = key == held_key
                yield from blocks(held_key, held, parted or same)
                held, size, parted = [], 0, same
            held_key = key
            held += payloads
            size += sum(map(len, payloads))
        if held:
            yield from blocks(held_key, held, parted)
        yield from passed(through)

    return run


def decider(length: int, buckets: int):
    """Of each run of equal strings, all but the earliest are covered. Of parted anchors the earliest of each run goes on by
    its name, to be compared with those of the other blocks."""

    def decide(found: P.Answers, kind: int, head: bytes, text: bytes, classes: bytes) -> Iterator[tuple[int, int, bytes]]:
        cols, _ = read_head(head)
        doc, row, low, size = cols["doc"], cols["row"], cols["low"].astype(np.int64), cols["size"].astype(np.int64)
        number = np.frombuffer(classes, "<i4")
        strings = np.maximum(0, size - length + 1)
        at = ragged(np.cumsum(size) - size, strings)
        piece = np.repeat(np.arange(len(doc)), strings)
        number = number[at]
        if kind != PARTED and len(number):
            several = np.bincount(number)[number] > 1
            at, piece, number = at[several], piece[several], number[several]
        if not len(at):
            return
        order = np.lexsort((row, doc))
        rank = np.zeros(len(doc), np.int64)
        rank[order] = np.cumsum(P.starts_of(doc[order], row[order]))
        pos = low[piece] + at - (np.cumsum(size) - size)[piece]
        key = rank[piece] << 32 | pos
        by_class = np.argsort(number, kind="stable")
        cuts = np.flatnonzero(P.starts_of(number[by_class]))
        earliest = np.minimum.reduceat(key[by_class], cuts)
        late = key[by_class] > np.repeat(earliest, np.diff([*cuts, len(by_class)]))
        who = by_class[late]
        found.add((P.COVERED, doc[piece[who]], row[piece[who]], pos[who]))
        if kind == PARTED:
            data = np.frombuffer(text, np.uint8)
            h, c = (mixed(P.Prefixes(P.byte_values(data, k), k).sliding(length)) for k in (0, 1))
            who = by_class[~late]
            who = who[np.unique(np.stack([number[who], key[who]]), axis=1, return_index=True)[1]]
            yield from P.dealt({"h": h[at[who]], "c": c[at[who]], "doc": doc[piece[who]], "row": row[piece[who]], "pos": pos[who]}, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = P.Answers(buckets)
        for b in batches:
            kinds = b.column(0).to_numpy(zero_copy_only=False)
            through = b.filter(pa.array(kinds == 1))
            if len(through):
                yield pa.record_batch(through.columns[:3], names=["kind", "key", "payload"])
            own = b.filter(pa.array(kinds != 1))
            for k in range(len(own)):
                yield from P.in_batches(decide(found, own.column(0)[k].as_py(), *(own.column(f)[k].as_py() for f in (2, 3, 4))))
                yield from P.in_batches(found.rows())
        yield from P.in_batches(found.rows(last=True))

    return run


def finisher(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for part in text_slices(batch, "text", SLICE):
                sizes, spans, kept = [], [], []
                for text, own in zip(text_bytes(part.column("text")), part.column("payloads").to_pylist(), strict=True):
                    settled, covered = P.positions(own, P.SETTLED), P.positions(own, P.COVERED)
                    starts = np.concatenate([np.maximum(0, settled - (length - gram(length))), covered])
                    starts, ends = P.merged(starts, np.concatenate([np.minimum(len(text), settled + length), covered + length]))
                    sizes.append(len(text))
                    spans.append([{"start": int(a), "end": int(b)} for a, b in zip(starts, ends, strict=True)])
                    kept.append(b"".join(text[a:b] for a, b in zip([0, *ends], [*starts, len(text)], strict=True)) if len(starts) else text)
                yield pa.record_batch([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, span_type), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return run


def dedup(docs: DataFrame, length: int = LENGTH, block: int = BLOCK, hold: int = HOLD) -> DataFrame:
    """doc_id, n_bytes, spans (removed byte runs) and the kept bytes of every row."""
    buckets = P.bucket_count(docs)
    name = register(docs.sparkSession, length)
    base = P.base_rows(docs)
    first = P.exchanged(base.mapInArrow(tidy(P.sender(anchors(length), buckets, True, P.SETTLED, SLICE)), P.OUT), buckets)
    places = P.answers(first.mapInArrow(tidy(P.reducer(P.anchors_decided(True), buckets)), P.OUT), buckets)
    second = P.exchanged(base.join(places, ["doc", "row"]).mapInArrow(tidy(context_sender(length, buckets)), P.OUT), buckets)
    blocks = second.mapInArrow(tidy(gatherer(block, hold)), BLOCKS).select("kind", "key", "payload", "text", F.call_function(name, "text", "ends").alias("classes"))
    third = P.exchanged(blocks.mapInArrow(tidy(decider(length, buckets)), P.OUT), buckets)
    covered = P.answers(third.mapInArrow(tidy(P.reducer(P.classes_decided(True), buckets)), P.OUT), buckets)
    return base.join(covered, ["doc", "row"], "left").mapInArrow(tidy(finisher(length)), "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
