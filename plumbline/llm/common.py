"""What the corpus operators share: reading, shared scratch space, and byte-level access to Arrow text columns."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import cut, scratch  # noqa: F401  (the operators take both from here)

#: Bytes of text that one vectorised step handles; a longer text is a step of its own.
STEP_BYTES = 1 << 19
#: The bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(df: DataFrame) -> int:
    """The number of shuffle partitions that the session asks for."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def crc_bucket(column: str, n: int):
    """crc32 of the column as text, mod n; null where the column is null."""
    return F.crc32(F.col(column).cast("string")) % n


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, end to end, and the rows' bounds in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, bounds, data = column.buffers()
    at = np.frombuffer(bounds, width, len(column) + 1, column.offset * np.dtype(width).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8, at[-1] - at[0], at[0]) if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def steps(batch: pa.RecordBatch, text: str, most: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batch with at most ``most`` bytes of text (or one row), each with its bytes and the rows' bounds."""
    data, at = text_bytes(batch.column(text))
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1))
        yield batch.slice(lo, hi - lo), data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in ``data``, and the index of the first word of each row (with one more for the end).

    Words are runs of bytes other than ASCII white space; they end with their row.
    """
    if not data.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(at.size, np.int64)
    solid = ~BLANK[data]
    first = np.zeros(data.size + 1, bool)
    first[at[(at < data.size)]] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | first[1:-1]
    starts = np.flatnonzero(start)
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | first[1:-1]
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, at)


_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def eights(data: np.ndarray, order: str = "<") -> np.ndarray:
    """For each place the eight bytes from there on as one number; beyond the end come zeros."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((data.size,), np.dtype(f"{order}u8"), padded.data, 0, (1,)).astype(np.uint64)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: the sum of its blocks of eight bytes, each mixed with its place, and the
    length. (No polynomial: modulo 2**64 those are equal for strings of some structure, whatever the base.)
    """
    length = ends - starts
    blocks = (length + 7) >> 3
    stop = np.cumsum(blocks)
    place = np.arange(stop[-1] if stop.size else 0) - np.repeat(stop - blocks, blocks)
    at = np.repeat(starts, blocks) + 8 * place
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    value = np.ndarray((data.size + 1,), "<u8", padded.data, 0, (1,))[at]
    over = np.maximum(at + 8 - np.repeat(ends, blocks), 0).astype(np.uint64) << np.uint64(3)  # bits of the last block beyond the span
    value = (value << over) >> over
    run = np.zeros(value.size + 1, np.uint64)
    np.cumsum(mix(value ^ mix((place.astype(np.uint64) + np.uint64(1)) * _ODD)), out=run[1:])
    return mix(run[stop] - run[stop - blocks] + length.astype(np.uint64) * _ODD)


def lower(data: np.ndarray) -> np.ndarray:
    """Bytes with ASCII and Latin-1 capitals (in UTF-8) made small, length unchanged."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    if data.size > 1:
        latin = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][latin] += 32
    return out


def _names(ddl: str) -> list[str]:
    return [f.name for f in T._parse_datatype_string(ddl).fields]


def packed(docs: DataFrame, text_col: str) -> DataFrame:
    """The rows as they are in one column ``doc``, and the text beside it: whatever their columns are called."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col(text_col).cast("string").alias("text"))


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder, and read from there."""
    path = f"{scratch(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the folders that a table of ``stored`` was read from."""
    sc = df.sparkSession.sparkContext
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def keep_rows(docs: DataFrame, verdict: DataFrame, id_col: str, key) -> DataFrame:
    """The rows of ``docs`` that ``verdict`` (id, key, kept: a row for each) keeps, with ``key`` a column of docs.

    Only pairs of id and key with something to drop are joined. Of rows that repeat both, the verdict keeps all, none or
    one: then the one with the smallest number stays, found by partial aggregation, so that no task meets all repeats.
    """
    mark = "__verdict"
    drops = cut(verdict.groupBy("id", "key").agg(F.count_if("kept").alias("stay"), F.count("*").alias("n")).filter("stay < n"))
    drops = drops.select(F.col("id").alias(f"{mark}_id"), F.col("key").alias(f"{mark}_key"), F.col("stay").alias(f"{mark}_stay"))
    mine = F.col(id_col).eqNullSafe(F.col(f"{mark}_id")) & F.col(mark).eqNullSafe(F.col(f"{mark}_key"))
    keyed = docs.withColumn(mark, key)
    out = keyed.join(drops, mine, "left").filter(F.col(f"{mark}_stay").isNull()).select(*(F.col(f"`{c}`") for c in docs.columns))
    some = drops.filter(F.col(f"{mark}_stay") > 0)
    if not some.isEmpty():  # rows repeated as a whole
        twins = cut(keyed.join(some, mine).withColumn(f"{mark}_row", F.monotonically_increasing_id()))
        firsts = twins.groupBy(f"{mark}_id", f"{mark}_key").agg(F.min(f"{mark}_row").alias(f"{mark}_row"))
        out = out.unionByName(twins.join(firsts.select(f"{mark}_row"), f"{mark}_row", "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns)))
    return out


def release() -> None:
    """Gives memory that freed arrays have left in this process back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """Fewer rows an Arrow batch than Spark's default, which is too much for rows of long texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) == 10_000:
        spark.conf.set(name, 2500)


def extend(df: DataFrame, make, more: str, text: str, most: int = STEP_BYTES, drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` without the columns ``drop`` and with those of ``more`` (DDL), which ``make()`` gives a function for.

    ``make`` runs once a task; what it returns turns (slice, bytes of ``text``, bounds) into the new columns' arrays.
    A column of the input that has a new column's name is replaced by it.
    """
    small_batches(df.sparkSession)
    added = _names(more)
    out_of_the_way = {c.lower() for c in (*added, *drop)}
    kept = [c for c in df.columns if c.lower() not in out_of_the_way]
    ddl = ", ".join([*(f"`{c.replace('`', '``')}` {df.schema[c].dataType.simpleString()}" for c in kept), more])

    def run(batches):
        work = make()
        for batch in batches:
            for part, data, at in steps(batch, text, most):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *work(part, data, at)], names=[*kept, *added])
            del batch
            release()

    return df.mapInArrow(run, ddl)


def sample_of(labelled: DataFrame, id_col: str, most: int) -> DataFrame:
    """At most ``most`` rows, those whose ids have the smallest hashes: the same rows at every partitioning."""
    return labelled.orderBy(F.xxhash64(id_col), id_col).limit(most)
