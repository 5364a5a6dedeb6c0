"""Shared helpers: staged tables in the cluster's shared folder, Arrow slicing, ragged arrays."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.  Where that is unset, a local one on a single machine, and an error on a cluster."""
    path = spark.conf.get(CHECKPOINT_KEY, None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"{CHECKPOINT_KEY} has to name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="cuewright-")
        spark.conf.set(CHECKPOINT_KEY, path)
    return path.rstrip("/")


def staged(df: DataFrame, label: str, compression: str = "zstd", **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The lineage ends there, and a lost executor costs only its own tasks.  The write's shuffle files go
    when it ends, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP_KEY)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        df.write.options(**options).option("compression", compression).parquet(path)
    finally:
        spark.conf.set(CLEANUP_KEY, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove staged tables that nothing will read any more: whatever was made from them is staged itself."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def documents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def give_back() -> None:
    """Return freed memory, Arrow's and the C library's where it can, to the system: a worker process lives on, with what earlier stages left in it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each holds about ``most_bytes`` of ``column`` (one row at least); null texts become empty.

    After each batch freed memory goes back to the system.
    """
    for batch in batches:
        at = batch.schema.get_field_index(column)
        texts = pc.fill_null(batch.column(at).cast(pa.string()), "")
        batch = batch.set_column(at, column, texts)
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        give_back()


def utf8_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an array of strings without nulls, and the offsets of its rows in them."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]


def ragged_take(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of ``flat[s : s + n]`` over the pairs of ``starts`` and ``lengths``."""
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return flat[shift + np.arange(total)]


def sums_by_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of each row of a ragged array; empty rows give 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def broadcast_if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """Mark ``df`` for broadcast only when a count shows it to have at most ``most_rows`` rows."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def hot_rows(total: int) -> int:
    """From how many rows on a key of ``total`` rows is hot: at most 10,000 keys can be."""
    return max(1000, total // 10_000)


def join_by_key(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``keyed`` (staged, one row a key), whose ``count`` tells how many rows have the key.

    The rows of hot keys stay in their tasks and meet a broadcast of at most 10,000 keys; no task
    gathers a hot key.
    """
    hot = F.col(count) > hot_rows(total)
    few = keyed.filter(hot)
    if not few.limit(1).count():
        return rows.join(keyed.drop(count), keys, how)
    rest = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(keyed.filter(~hot).drop(count), keys, how)
    return rows.join(F.broadcast(few.drop(count)), keys).unionByName(rest)


def id_filter(ids: DataFrame, most_bits: int = 1 << 26) -> tuple[np.ndarray, int]:
    """A bitmap of hashed ids (one column), and its mask: 16 bits an id, at most ``most_bits``.

    A row whose bit is unset is surely not among ``ids``; beyond the bound more rows pass, and an
    exact join has to follow in any case.
    """
    name = ids.columns[0]
    bits = min(most_bits, 1 << (max(16 * ids.count(), 1024) - 1).bit_length())
    slots = ids.select(F.xxhash64(name).bitwiseAND(bits - 1).alias("slot"))
    words = slots.groupBy(F.shiftright("slot", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 31 as int))")).alias("bits")).toPandas()
    out = np.zeros(bits // 32, np.uint32)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint32)
    return out, bits - 1


def maybe_in(bitmap: np.ndarray, mask: int, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & mask
    return (bitmap[slot >> 5] >> (slot & 31).astype(np.uint32)) & 1 == 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once: inside a lambda, an expression is computed anew for each element."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))
