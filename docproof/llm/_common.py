"""Shared helpers of the training-data operators.

Word rule: a word is a maximal run of bytes outside 0x20 and 0x09-0x0D, which is exactly
what ``bytes.split()`` yields on UTF-8 text.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: The same word rule as a Java regular expression.
WORD = r"[^\x20\x09-\x0D]+"

#: Text bytes handed to numpy at once inside a task; bounds a Python worker's memory.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_local_root: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share.

    Without that setting a session in one process (a local test) gets a temporary folder; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _local_root:
            _local_root.append(tempfile.mkdtemp(prefix="docproof-"))
        root = _local_root[0]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    trimmed(spark)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str, column: str | None = None) -> tuple[DataFrame, int]:
    """As `saved`, and the number of rows, or the sum of a column, counted as they are written."""
    seen = Observation()
    out = saved(df.observe(seen, (F.sum(column) if column else F.count(F.lit(1))).alias("n")), name)
    return out, int(seen.get["n"] or 0)


def remove_dir(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


#: Keys that hold more than one part in so many of all rows count as hot.
HOT_KEYS = 4096


def joined(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Joins left rows to the one right row of their key, if there is one; right names how many of the `total` left rows each key
    has in `weight`. Keys with more than 1/HOT_KEYS of these, so at most HOT_KEYS of them, are broadcast: no task gets all rows of one."""
    right = right.where(F.col(key).isNotNull())
    hot = right.where(F.col(weight) * HOT_KEYS > total).drop(weight)
    extra = [c for c in hot.columns if c != key]
    marked = left.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), key, "left")
    cold = marked.where("__hot is null").drop(*extra, "__hot").join(right.where(F.col(weight) * HOT_KEYS <= total).drop(weight), key, "left")
    return marked.where("__hot").drop("__hot").unionByName(cold)


def trimmed(spark: SparkSession) -> None:
    """Gives memory that the driver's JVM has freed outside its heap back to the system, as `tidy` does for Python workers: glibc
    keeps what the compilers of plans and code have used, which came to a third of a GB."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    with contextlib.suppress(Py4JError):  # Linux only, from Java 17.0.9 on
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        # by the interface: the server's own class is closed to callers
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(server, args)


def released(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files and broadcasts of finished rounds now: its cleaner waits until the driver's
    garbage is collected, which on a large heap can take longer than many rounds."""
    gc.collect()
    spark._jvm.System.gc()
    trimmed(spark)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of few rows: documents are wide, and a batch lies in memory as a whole."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def order_key(column: str | Column = "doc_id") -> Column:
    """doc_id as a sort key without nulls: a null id stands after all others."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(2**63 - 1))


def row_key(column: str = "doc_id", text: str = "text") -> Column:
    """Names a row among those of its doc_id: rows equal in id and text share it, as their results are equal. Only the pair
    of doc_id and this key names a row of a table."""
    return F.xxhash64(F.col(column), F.col(text), F.col(text).isNull())


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives freed memory back at its end: Python workers live on, idle ones too."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # glibc only
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return tidied


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each piece holds about `most` bytes of text; one text stays whole."""
    col = batch.column(column)
    n = len(col)
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    first = 0
    while first < n:
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(first, last - first)
        first = last


def text_bytes(col: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8 bytes; null becomes the empty text."""
    return [b"" if x is None else x for x in col.cast(pa.large_binary()).to_pylist()]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start..start+length-1 of every pair, one after another."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts.astype(np.int64) - (ends - lengths), lengths) + np.arange(total)


def binaries(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """flat[start:end] of every pair as a binary Arrow column, copied once."""
    size = flat.dtype.itemsize
    lengths = (ends - starts).astype(np.int64)
    data = np.ascontiguousarray(flat[ragged(starts, lengths)])
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths * size, out=offsets[1:])
    kind, width = (pa.binary(), np.int32) if offsets[-1] < 2**31 else (pa.large_binary(), np.int64)
    return pa.Array.from_buffers(kind, len(lengths), [None, pa.py_buffer(offsets.astype(width)), pa.py_buffer(data)])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)
