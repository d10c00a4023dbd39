"""What the operators share: checkpoints, Arrow text slices and vectorised word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.clientserver import DEFAULT_WORKER_SLEEP_TIME
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

#: Text bytes that one vectorised step works on; one longer text is a step of its own.
SLICE_BYTES = 1 << 20
#: Seconds until py4j has told the JVM of all that Python let go of.
RELEASE_S = DEFAULT_WORKER_SLEEP_TIME + 0.2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder of ``spark.checkpoint.dir``; where unset, in an own folder if all runs on one machine (tests)."""
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def released(spark: SparkSession) -> None:
    """Have the driver collect its garbage: Spark then deletes the exchanges and checkpoints of frames that nothing refers to any more, which else stay until it happens to.

    What Python lets go of is told to the JVM by a thread of py4j that looks once a second; the JVM's collection waits for it.
    """
    gc.collect()
    time.sleep(RELEASE_S)
    spark.sparkContext._jvm.System.gc()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of batches, giving what memory its worker no longer uses back once it ends: workers outlive their tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def fresh(df: DataFrame, name: str) -> str:
    """The name, or with underscores before it one that no column of ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def numbered(df: DataFrame, id: str, text: str) -> tuple[DataFrame, str, bool]:
    """The rows with a distinct long column that sorts like (id, nulls first; text), its name, and whether it is the id itself.

    Where ids are null, repeat or aren't longs, the rows are sorted by range and written once; the driver holds a count for each partition.
    """
    key = fresh(df, "_order")
    if df.schema[id].dataType.simpleString() == "bigint" and df.groupBy(id).count().where((F.col("count") > 1) | F.col(id).isNull()).isEmpty():
        return df.withColumn(key, F.col(id)), key, True
    by = [F.col(id).asc_nulls_first(), F.col(text).asc_nulls_first()]
    rows = checkpoint(df.repartitionByRange(partitions(df.sparkSession), *by).sortWithinPartitions(*by))
    counts = {r[0]: r[1] for r in rows.groupBy(F.spark_partition_id()).count().collect()}
    starts, at = {}, 0
    for p in sorted(counts):
        starts[p], at = at, at + counts[p]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = starts.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            yield batch.append_column(key, pa.array(np.arange(n, n + len(batch))))
            n += len(batch)

    out = rows.mapInArrow(lean(count), T.StructType([*df.schema.fields, T.StructField(key, T.LongType())]))
    return checkpoint(out), key, False


def by_shard(df: DataFrame, n: int, column: str = "shard") -> DataFrame:
    """Rows with shard ``s`` (0 to n-1) meet in partition ``s``; AQE leaves the number alone."""
    return df.repartitionById(n, F.col(column))


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of a text or binary Arrow column: (first row, end row, UTF-8 bytes, offsets from 0) in slices. Null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + max_bytes, "right")) - 1)
        b = min(b, n)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


# ---------------------------------------------------------------- hashing

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i modulo 2^64 for i < n (kept by the worker up to a few slices)."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 2 * SLICE_BYTES + 2)
        made = []
        for base in (_BASE, _BASE_INVERSE):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            made.append(np.cumprod(x, dtype=np.uint64))
        if size > 16 * SLICE_BYTES:
            return made[0][:n], made[1][:n]
        _powers = (made[0], made[1])
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def byte_table(separators: str, lower: bool = True) -> np.ndarray:
    """A 256-entry table: A-Z to a-z, separator bytes to 0, all others to themselves."""
    t = np.arange(256, dtype=np.uint8)
    if lower:
        t[65:91] += 32
    t[list(separators.encode("latin-1"))] = 0
    return t


#: White space of ``[^\x20\x09-\x0D]+`` (NUL has no table value of its own and is kept apart below).
SPACE_WORDS = byte_table(" \t\n\x0b\x0c\r")
#: Separators of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` over lower-cased text.
ALNUM_WORDS = byte_table("".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])))


def word_hashes(data: np.ndarray, offsets: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word in order: its text's row, 64-bit hash, first and end byte. Words never cross texts."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none
    mapped = lut[data]
    sep = mapped == 0
    if lut is SPACE_WORDS:
        sep &= data != 0  # NUL is an ordinary character of a word there
    edge = offsets[(offsets > 0) & (offsets < n)]
    before = np.empty(n, bool)
    before[0], before[1:] = True, sep[:-1]
    before[edge] = True
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, sep[1:]
    after[edge - 1] = True
    starts = np.flatnonzero(~sep & before)
    ends = np.flatnonzero(~sep & after) + 1
    up, down = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((mapped.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    h = mix((total[ends] - total[starts]) * down[starts])
    rows = np.searchsorted(offsets, starts, "right") - 1
    return rows, h, starts, ends
