"""Packing documents into token sequences: sum-of-squares online packing.

Documents longer than a window give full windows first; what is left of each document is placed,
in arrival order, into the fill level that makes the sum of the squared counts of partly filled
windows smallest. The counts per fill level are one array, so a placement is a few vector
operations. Each task packs its own rows. At a task's end the windows still open are emptied and
their pieces laid end to end, cut at the window size; the last incomplete one is cut into
sequences whose lengths are powers of two, so that nothing is padded there.

Defined cases: null or empty text is one document of its end id alone; null doc_id stays null;
repeated rows are packed once each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docproof.llm._common import small_batches, table, text_bytes, text_slices, tidy
from docproof.llm.tokens import END_ID, default_vocabulary, encoder

WINDOW = 2048
#: Sequences one task may number; the task's partition stands above these bits.
SEQUENCE_BITS = 36

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class SumOfSquares:
    """Open windows by fill level. A piece is (document, start, ids)."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window + 1)]

    def level(self, size: int) -> int:
        """The fill level to add `size` to; 0 opens a window."""
        n = self.counts
        top = self.window - size
        change = 2 * (n[size : self.window + 1] - n[: top + 1]) + 2
        change[0] = 2 * n[size] + 1
        if top:
            change[top] = 1 - 2 * n[top]  # the window becomes full and leaves
        allowed = n[: top + 1] > 0
        allowed[0] = True
        change = np.where(allowed, change, np.iinfo(np.int64).max)
        return top - int(np.argmin(change[::-1]))  # of equals, the fullest

    def place(self, piece: tuple, size: int) -> list | None:
        """Adds a piece of less than a window; gives back the pieces of a window that became full."""
        at = self.level(size)
        if at:
            pieces = self.open[at].pop()
            self.counts[at] -= 1
        else:
            pieces = []
        pieces.append(piece)
        if at + size == self.window:
            return pieces
        self.open[at + size].append(pieces)
        self.counts[at + size] += 1
        return None

    def drain(self) -> Iterator[tuple]:
        """Empties the open windows, fullest first."""
        for level in range(self.window, 0, -1):
            for pieces in self.open[level]:
                yield from pieces
            self.open[level] = []
        self.counts[:] = 0


def recut(pieces: Iterator[tuple], window: int) -> Iterator[list[tuple]]:
    """Lays pieces end to end and cuts sequences of a window; the rest into powers of two."""
    current, room = [], window
    for doc, start, ids in pieces:
        while len(ids):
            take = min(room, len(ids))
            current.append((doc, start, ids[:take]))
            start, ids, room = start + take, ids[take:], room - take
            if not room:
                yield current
                current, room = [], window
    rest = window - room
    while rest:
        want = 1 << (rest.bit_length() - 1)
        rest -= want
        sequence = []
        while want:
            doc, start, ids = current.pop(0)
            take = min(want, len(ids))
            sequence.append((doc, start, ids[:take]))
            want -= take
            if take < len(ids):
                current.insert(0, (doc, start + take, ids[take:]))
        yield sequence


def _packer(path: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, packer = encoder(path), SumOfSquares(window)
        number = TaskContext.get().partitionId() << SEQUENCE_BITS
        rows: list[tuple] = []

        def emit(sequence: list[tuple]) -> None:
            nonlocal number
            offset = 0
            for (doc_id, tokens), start, ids in sequence:
                rows.append((doc_id, start, len(ids), tokens, number, offset, ids.tobytes()))
                offset += len(ids)
            number += 1

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            out = pa.record_batch([pa.array(c, pa.int64()) for c in cols[:6]] + [pa.array(cols[6], pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
            rows.clear()
            return out

        for batch in batches:
            for part in text_slices(batch):
                ids, ends = enc.encode(text_bytes(part.column("text")), END_ID)
                ids = ids.astype("<u4")
                begin = 0
                for doc_id, end in zip(part.column("doc_id").to_pylist(), ends.tolist(), strict=True):
                    size = end - begin
                    doc, cut = (doc_id, size), size - size % window
                    for start in range(0, cut, window):
                        emit([(doc, start, ids[begin + start : begin + start + window])])
                    if size > cut and (full := packer.place((doc, cut, ids[begin + cut : end].copy()), size - cut)):
                        emit(full)
                    begin = end
                    if len(rows) >= 2000:
                        yield flush()
        for sequence in recut(packer.drain(), window):
            emit(sequence)
            if len(rows) >= 2000:
                yield flush()
        yield flush()

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW) -> DataFrame:
    """Pieces of the packed documents: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    ids holds the piece's token ids as little-endian unsigned 32-bit integers. No shuffle: the work
    follows the input's partitions, and a lost task gives the same rows when it runs again."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(tidy(_packer(vocabulary or default_vocabulary(), window)), SCHEMA)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
