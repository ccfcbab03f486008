"""What the two passage-level deduplicators share: hashing of sequences, and the exchange of anchors.

Both find repeats in three steps that never pair up occurrences:

1. Each document emits anchors, each with a hash `h` of the anchor and a hash `c` of all that any
   window holding the anchor can contain (its context, with the anchor's place in it). Anchors are
   dealt by `h`. An occurrence whose (h, c) also stands earlier is settled: all windows around it
   repeat. Of each (h, c) only the first goes on, and only where its `h` has several contexts.
2. Those are decided window by window by the operator itself, dealt again by content.
3. The covered parts go back to the documents by row key.

Occurrences are packed into binary rows, one for each flush of a task and bucket, and tasks settle what they
can before the shuffle; the largest group therefore brings a task one entry for each flush before it
and distinct context. Buckets are numbered, dealt evenly and decided one after another, so that a task holds one of them
at a time. Answers to documents are packed as well, by bucket of row keys. The texts cross one shuffle, which all
three steps read.

An occurrence's (h, c) are two independent 62-bit names over prime fields, of words or bytes that have two independent
64-bit names each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docproof.llm._common import SLICE_BYTES, mixed, order_key, row_key, shuffle_parts, small_batches, text_slices, tidy

#: Prime moduli below 2**31, so that products and sums of residues fit 64 bits, and a base for each. A sequence is named by
#: two independent pairs of them: modulo a prime, unlike modulo 2**64, no family of sequences collides whatever the base.
PRIMES = (2**31 - 1, 2**31 - 19, 2**31 - 61, 2**31 - 69)
BASES = (1_318_699_027, 884_736_743, 1_640_531_527, 402_653_189)
#: Text bytes whose anchors a task packs at a time.
FLUSH_BYTES = 8 << 20

_powers: dict[tuple[int, int], np.ndarray] = {}


def power_table(base: int, prime: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo prime."""
    have = _powers.get((base, prime))
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64)
        while len(have) < max(n, 1 << 18):
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), prime)) % np.uint64(prime)])
        have = _powers[base, prime] = have.astype(np.uint32)
    return have[:n]


class Prefixes:
    """62-bit names of any ranges of a sequence of values, by prefix sums modulo two primes. `values` are 64-bit; their upper
    and lower halves go to one prime each. `which` takes one of two independent pairs of primes."""

    def __init__(self, values: np.ndarray, which: int = 0):
        n = len(values)
        self.parts = []
        for k, half in enumerate((values >> np.uint64(33), values & np.uint64(0x7FFFFFFF))):
            prime, base = PRIMES[2 * which + k], BASES[2 * which + k]
            sums = np.zeros(n + 1, np.uint64)
            half = (half + np.uint64(1)) * power_table(base, prime, n)
            half %= np.uint64(prime)
            np.cumsum(half, out=sums[1:])  # exact: below 2**64 for 2**33 values
            self.parts.append((sums, power_table(pow(base, -1, prime), prime, n + 1), np.uint64(prime)))

    def ranges(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        a, b = ((sums[last] - sums[first]) % prime * back[first] % prime for sums, back, prime in self.parts)
        return a << np.uint64(31) | b

    def sliding(self, width: int) -> np.ndarray:
        """The name of every range of a width."""
        n = len(self.parts[0][0]) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        a, b = ((sums[width:] - sums[:n]) % prime * back[:n] % prime for sums, back, prime in self.parts)
        return a << np.uint64(31) | b


_bytes = [mixed(np.arange(1 + k, 257 + k, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for k in (0, 1000)]


def byte_values(data: np.ndarray, which: int = 0) -> np.ndarray:
    return _bytes[which][data]


#: An occurrence: hashes, then who and where.
ENTRY = np.dtype([("h", "<u8"), ("c", "<u8"), ("doc", "<i8"), ("row", "<i8"), ("pos", "<u4")])
FIELDS = ENTRY.names


class Planes:
    """Columns of numbers as planes of bytes: the first bytes of all values, then the second ones, and so on. Ids and places of
    one payload differ in few of their bytes, and a plane of equal bytes compresses to nothing however few entries the
    payload has. `widths` names for each column how many of its lower bytes are sent."""

    def __init__(self, **widths: int):
        self.widths, self.width = widths, sum(widths.values())

    def of(self, cols: dict[str, np.ndarray]) -> np.ndarray:
        return np.concatenate([cols[f].astype("<i8" if cols[f].dtype.kind == "i" else "<u8").view(np.uint8).reshape(-1, 8)[:, :w].T for f, w in self.widths.items()])

    def read(self, payloads: list[bytes]) -> dict[str, np.ndarray]:
        planes = np.concatenate([np.zeros((self.width, 0), np.uint8), *(np.frombuffer(p, np.uint8).reshape(self.width, -1) for p in payloads)], 1)
        out, at = {}, 0
        for f, w in self.widths.items():
            whole = np.zeros((planes.shape[1], 8), np.uint8)
            whole[:, :w] = planes[at : at + w].T
            out[f], at = whole.view("<u8").ravel(), at + w
        return out


ENTRIES = Planes(**{f: ENTRY[f].itemsize for f in FIELDS})


def unpack(payloads: list[bytes]) -> dict[str, np.ndarray]:
    cols = ENTRIES.read(payloads)
    return {f: cols[f].astype(ENTRY[f]) if f == "pos" else cols[f].view(ENTRY[f]) for f in FIELDS}


def take(cols: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
    return {f: x[at] for f, x in cols.items()}


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """Marks the first row of every run of equal keys."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new


def runs(new: np.ndarray) -> list[tuple[int, int]]:
    """The ranges of equal keys, from the marks of starts_of."""
    cuts = np.flatnonzero(new).tolist()
    return list(zip(cuts, [*cuts[1:], len(new)], strict=True)) if cuts else []


def planed(x: np.ndarray) -> bytes:
    """A column as planes of bytes (see Planes)."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def unplaned(payload: bytes, kind: str, n: int, at: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(payload, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel()


def answer(doc: np.ndarray, row: np.ndarray, pos: np.ndarray, flag: int, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """Positions for documents, as one payload for each bucket of row keys. Documents have a quarter as many
    buckets as hashes: a step's answers are a fraction of its questions, and rows stay few. A payload holds its flag, the
    numbers of documents and positions, then documents, row keys, counts and positions."""
    buckets = max(1, buckets // SPREAD)
    who = (mixed(x.astype(np.int64).view(np.uint64)) for x in (doc, row))
    bucket = (mixed(next(who) + next(who)) >> np.uint64(32)).astype(np.int64) * buckets >> 32
    order = np.lexsort((pos, row, doc, bucket))
    doc, row, pos, bucket = doc[order], row[order], pos[order], bucket[order]
    owner = np.flatnonzero(starts_of(bucket, doc, row))
    counts = np.diff([*owner, len(pos)])
    cuts = starts_of(bucket[owner])
    for a, b in runs(cuts):
        who, first, last = owner[a:b], owner[a], owner[b] if b < len(owner) else len(pos)
        head = bytes([flag]) + np.array([b - a, last - first], "<u4").tobytes()
        cols = ((doc[who], "<i8"), (row[who], "<i8"), (counts[a:b], "<u4"), (pos[first:last], "<u4"))
        yield 1, int(bucket[first]), head + b"".join(planed(x.astype(kind)) for x, kind in cols)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document: its positions, a payload for each flag. Rows come sorted by bucket; one is held at a time."""

    def of_bucket(payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        docs, rows, flags, places = [], [], [], []
        for p in payloads:
            m, n = np.frombuffer(p, "<u4", 2, 1).tolist()
            counts = unplaned(p, "<u4", m, 9 + 16 * m)
            docs.append(np.repeat(unplaned(p, "<i8", m, 9), counts))
            rows.append(np.repeat(unplaned(p, "<i8", m, 9 + 8 * m), counts))
            flags.append(np.full(n, p[0], np.uint8))
            places.append(unplaned(p, "<u4", n, 9 + 20 * m))
        doc, row, flag, pos = (np.concatenate(x) for x in (docs, rows, flags, places))
        order = np.lexsort((pos, flag, row, doc))
        doc, row, flag, pos = doc[order], row[order], flag[order], pos[order]
        keep = starts_of(doc, row, flag, pos)
        doc, row, flag, pos = doc[keep], row[keep], flag[keep], pos[keep].astype("<u4")
        keys, found = [], []
        for a, b in runs(starts_of(doc, row, flag)):
            if not keys or keys[-1] != (doc[a], row[a]):
                keys.append((doc[a], row[a]))
                found.append([])
            found[-1].append(bytes([flag[a]]) + pos[a:b].tobytes())
        for k in range(0, len(keys), 2000):
            some = np.array(keys[k : k + 2000], np.int64).reshape(-1, 2)
            yield pa.record_batch([pa.array(some[:, 0]), pa.array(some[:, 1]), pa.array(found[k : k + 2000], pa.list_(pa.binary()))], names=["doc", "row", "payloads"])

    for _, payloads in by_key(batches):
        yield from of_bucket(payloads)


def by_key(batches: Iterator[pa.RecordBatch], through: list | None = None, one_by_one: bool = False) -> Iterator[tuple[int, list[bytes]]]:
    """(key, payloads) of rows that come sorted by kind and key. With `through`, rows of kind 1 go there instead. one_by_one
    gives a key's payloads as they come."""
    key, payloads = None, []
    for b in batches:
        kinds = b.column(0).to_numpy(zero_copy_only=False)
        if through is not None and kinds.any():
            through.append(b.filter(pa.array(kinds == 1)))
            b = b.filter(pa.array(kinds == 0))
        for k, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if (k != key or one_by_one) and payloads:
                yield key, payloads
                payloads = []
            key = k
            payloads.append(p)
        if through:
            yield -1, []  # lets the rows pass before more are read
    if payloads:
        yield key, payloads


OUT = "kind int, key long, payload binary"
SETTLED, OPEN, COVERED = 0, 1, 2


def out_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.record_batch([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["kind", "key", "payload"])


def in_batches(rows: Iterator[tuple[int, int, bytes]], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[2])
        if size >= most:
            yield out_batch(held)
            held, size = [], 0
    if held:
        yield out_batch(held)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a hash. Hashes are scrambled once more: those that arrive were often chosen for being small."""
    return (mixed(h + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) * buckets >> 32


def dealt(cols: dict[str, np.ndarray], buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """Entries as one payload for each bucket of h."""
    bucket = bucket_of(cols["h"], buckets)
    order = np.argsort(bucket, kind="stable")  # within a bucket the rows stay together
    bucket, planes = bucket[order], ENTRIES.of(take(cols, order))
    for a, b in runs(starts_of(bucket)):
        yield 0, int(bucket[a]), planes[:, a:b].tobytes()


def first_of_class(cols: dict[str, np.ndarray], within_document: bool) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Sorted entries, and which of them are the first of their (h, c): of the smallest document, and
    within it (if asked) of the smallest place."""
    order = np.lexsort((cols["pos"], cols["row"], cols["doc"], cols["c"], cols["h"]))
    cols = take(cols, order)
    new = starts_of(cols["h"], cols["c"])
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    same = cols["doc"] == cols["doc"][first]
    if within_document:
        same &= (cols["row"] == cols["row"][first]) & (cols["pos"] == cols["pos"][first])
    return cols, same


def sender(entries: Callable[[pa.RecordBatch], tuple], buckets: int, within_document: bool, flag: int, slice_bytes: int = SLICE_BYTES):
    """Sends entries to the buckets of their hash, and settled ones straight to their documents.

    entries(batch) -> (index of the row, pos, h, c), and (docs, rows, positions) settled before, to pass on."""

    def flush(held: list[dict], through: list[tuple]) -> Iterator[tuple[int, int, bytes]]:
        cols, first = first_of_class({f: np.concatenate([np.zeros(0, ENTRY[f]), *(x[f] for x in held)]) for f in FIELDS}, within_document)
        late = take(cols, ~first)
        yield from answer(late["doc"], late["row"], late["pos"], flag, buckets)
        if through:
            yield from answer(*(np.concatenate(x) for x in zip(*through, strict=True)), SETTLED, buckets)
        kept = take(cols, first)
        yield from dealt(take(kept, np.lexsort((kept["pos"], kept["row"], kept["doc"]))), buckets)  # near ids side by side compress well

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, through, size = [], [], 0
        for batch in batches:
            for part in text_slices(batch, "text", slice_bytes):
                (k, pos, h, c), settled = entries(part)
                if settled:
                    through.append(settled)
                if len(k):
                    doc, row = (part.column(x).to_numpy(zero_copy_only=False) for x in ("doc", "row"))
                    held.append({"h": h, "c": c, "doc": doc[k], "row": row[k], "pos": pos})
                size += part.column("text").nbytes
                if size >= FLUSH_BYTES:
                    yield from in_batches(flush(held, through))
                    held, through, size = [], [], 0
        yield from in_batches(flush(held, through))

    return run


#: Positions that a task gathers before it packs them for their documents.
ANSWERS = 1 << 18

#: A flag, and documents, row keys and positions.
Found = tuple[int, np.ndarray, np.ndarray, np.ndarray]


class Answers:
    """Answers of many buckets or blocks, packed together: rows to documents stay few."""

    def __init__(self, buckets: int):
        self.buckets, self.held, self.size = buckets, {}, 0

    def add(self, found: Found) -> None:
        if len(found[1]):
            self.held.setdefault(found[0], []).append(found[1:])
            self.size += len(found[1])

    def rows(self, last: bool = False) -> Iterator[tuple[int, int, bytes]]:
        if last or self.size >= ANSWERS:
            for flag, parts in self.held.items():
                yield from answer(*(np.concatenate(x) for x in zip(*parts, strict=True)), flag, self.buckets)
            self.held, self.size = {}, 0


def reducer(decide: Callable[[list[bytes]], Iterator[Found]], buckets: int):
    """Runs `decide` over the payloads of one bucket after another; rows for documents pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        through: list[pa.RecordBatch] = []
        answers_ = Answers(buckets)
        for _, payloads in by_key(batches, through):
            yield from through
            through.clear()
            if payloads:
                for found in decide(payloads):
                    answers_.add(found)
                yield from in_batches(answers_.rows())
        yield from through
        yield from in_batches(answers_.rows(last=True))

    return run


def anchors_decided(within_document: bool):
    """Settled occurrences, and the open ones: first of their context, in a group of several."""

    def decide(payloads: list[bytes]) -> Iterator[Found]:
        cols, first = first_of_class(unpack(payloads), within_document)
        payloads.clear()
        if not len(first):
            return
        late = ~first
        yield SETTLED, cols["doc"][late], cols["row"][late], cols["pos"][late]
        new_h, new_class = starts_of(cols["h"]), starts_of(cols["h"], cols["c"])
        group = np.cumsum(new_h) - 1
        several = np.bincount(group, new_class)[group] > 1
        if not within_document:  # of several documents
            cuts = np.flatnonzero(new_h)
            several &= (np.minimum.reduceat(cols["doc"], cuts) != np.maximum.reduceat(cols["doc"], cuts))[group]
        pick = first & several
        yield OPEN, cols["doc"][pick], cols["row"][pick], cols["pos"][pick]

    return decide


def classes_decided(within_document: bool):
    """All but the first of each class are covered."""

    def decide(payloads: list[bytes]) -> Iterator[Found]:
        cols, first = first_of_class(unpack(payloads), within_document)
        yield COVERED, cols["doc"][~first], cols["row"][~first], cols["pos"][~first]

    return decide


#: Repeated ids up to which only their own rows are told apart by a hash.
FEW_IDS = 1000


def short_key(docs: DataFrame) -> Column:
    """A row's name beside its doc_id, for columns `doc` and row_key's: 0 where the id is not repeated. Every entry holds it, and
    hashes don't compress. With many repeated ids every row has its hash."""
    repeated = docs.select(order_key(F.col("doc_id").cast("long")).alias("doc")).groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc")
    found = [r.doc for r in repeated.limit(FEW_IDS + 1).collect()]
    # never a constant: as one the optimizer would take it out of the keys by which rows are dealt
    return row_key() if len(found) > FEW_IDS else F.when(order_key().isin(found or [-1]), row_key()).otherwise(0)


def base_rows(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """row, doc, text, the id and columns to keep, dealt by row key: one shuffle that every step reads again."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"__keep{k}") for k, c in enumerate(keep)])
    rows = slim.select("doc_id", "text", order_key().alias("doc"), short_key(docs).alias("row"), *[f"__keep{k}" for k in range(len(keep))])
    return rows.repartition(shuffle_parts(docs.sparkSession), "doc", "row")


#: Buckets of hashes for each shuffle partition: a task decides one of them at a time, which bounds its memory.
SPREAD = 4


def in_buckets(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows by bucket number, equally many buckets to each partition, in sorted order within it."""
    parts = shuffle_parts(rows.sparkSession)
    return rows.repartitionById(parts, (F.col("key") * parts / buckets).cast("int")).sortWithinPartitions("kind", "key")


def answers(rows: DataFrame, buckets: int) -> DataFrame:
    """doc, row, payloads of every document with positions."""
    return in_buckets(rows, max(1, buckets // SPREAD)).mapInArrow(tidy(gathered), "doc long, row long, payloads array<binary>")


def exchanged(rows: DataFrame, buckets: int) -> DataFrame:
    """Entries to the tasks of their buckets; rows for documents, which have fewer buckets, are spread as well."""
    parts = shuffle_parts(rows.sparkSession)
    of = F.when(F.col("kind") == 0, F.col("key") * parts / buckets).otherwise(F.col("key") % parts)
    return rows.repartitionById(parts, of.cast("int")).sortWithinPartitions("kind", "key")


def bucket_count(docs: DataFrame) -> int:
    small_batches(docs.sparkSession)
    return SPREAD * shuffle_parts(docs.sparkSession)


def positions(payloads: list[bytes] | None, flag: int) -> np.ndarray:
    parts = [np.frombuffer(p, "<u4", offset=1) for p in payloads or () if p[0] == flag]
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)


def settled_before(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Documents, row keys and positions that an earlier step settled."""
    places = [positions(own, SETTLED) for own in part.column("payloads").to_pylist()]
    sizes = [len(x) for x in places]
    return (*(np.repeat(part.column(x).to_numpy(zero_copy_only=False), sizes) for x in ("doc", "row")), np.concatenate(places)) if places else None


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges sorted by start, overlapping or touching ones joined."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > reach[:-1]
    cuts = np.flatnonzero(new)
    return starts[cuts], reach[np.append(cuts[1:], len(starts)) - 1]
