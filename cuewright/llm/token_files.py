"""Operator 8: token ids in files of directly addressable codes.

A segment holds the ids of whole documents.  An id is cut into chunks of eight bits, least first;
level k has the k-th chunk of every id that reaches it, with a bitmap telling which ids go on to
level k + 1 and a rank directory: the count of set bits before each block of 512.  The i-th id
takes one look at each of its levels, and no neighbour is decoded.

Files are Parquet tables of segments, so they reach any store that Spark writes, and a lost task
is written again by Spark's commit protocol.  Documents are dealt by ranges of (doc_id, hash of the
text); start positions are the counts of the ranges before, one number for each range.

Null texts are a lone end id.  Null doc_ids come first.  Repeated rows are written as often as they
occur.  Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_slices
from .word_encoder import encoder

BLOCK = 512
LEVEL = "array<struct<chunks: binary, more: binary, ranks: binary>>"
SEGMENT = f"part int, first long, n_ids long, doc_ids array<long>, ends array<long>, levels {LEVEL}"


def dac_encode(ids: np.ndarray) -> list[dict[str, bytes]]:
    """The levels of an array of unsigned 32-bit ids."""
    levels, rest = [], np.asarray(ids, np.uint32)
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        whole = np.zeros(-(-len(more) // BLOCK) * BLOCK // 8, np.uint8)
        whole[: len(bits)] = bits
        ranks = np.cumsum(np.bitwise_count(whole).reshape(-1, BLOCK // 8).sum(1, dtype=np.uint32), dtype=np.uint32)
        ranks = np.concatenate([[0], ranks[:-1]]).astype("<u4") if len(ranks) else ranks.astype("<u4")
        levels.append({"chunks": (rest & 0xFF).astype(np.uint8).tobytes(), "more": whole.tobytes(), "ranks": ranks.tobytes()})
        if not more.any():
            return levels
        rest = rest[more] >> np.uint32(8)


def dac_take(levels: list[dict[str, bytes]], at: np.ndarray) -> np.ndarray:
    """The ids at positions ``at``, each by one look at every level that it reaches."""
    out, live, at = np.zeros(len(at), np.uint32), np.arange(len(at)), np.asarray(at, np.int64)
    for k, level in enumerate(levels):
        chunks, more, ranks = np.frombuffer(level["chunks"], np.uint8), np.frombuffer(level["more"], np.uint8), np.frombuffer(level["ranks"], "<u4")
        out[live] |= chunks[at].astype(np.uint32) << np.uint32(8 * k)
        goes = (more[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        live, at = live[goes], at[goes]
        if not len(live):
            break
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(more), dtype=np.int64)])  # of each byte
        block = at // BLOCK
        inside = before[at >> 3] - before[block * (BLOCK // 8)]
        partial = np.bitwise_count(more[at >> 3] & ((1 << (at & 7)) - 1).astype(np.uint8))
        at = ranks[block] + inside + partial
    return out


def dac_at(levels: list[dict[str, bytes]], i: int) -> int:
    """One id, touching one chunk, one rank and at most one block of bits on each level."""
    value, shift = 0, 0
    for level in levels:
        value |= level["chunks"][i] << shift
        if not level["more"][i >> 3] >> (i & 7) & 1:
            break
        block = i // BLOCK
        bits = int.from_bytes(level["more"][block * (BLOCK // 8) : (block + 1) * (BLOCK // 8)], "little") & ((1 << i % BLOCK) - 1)
        i = int.from_bytes(level["ranks"][4 * block : 4 * block + 4], "little") + bits.bit_count()
        shift += 8
    return value


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, segment_ids: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all texts, ``end_id`` after each, in ascending order of doc_id.

    A segment ends after the document that takes it to ``segment_ids``.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, first = encoder(tokenizer), TaskContext.get().partitionId(), 0
        doc_ids, ends, held, n = [], [], [], 0
        schema = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("levels", pa.list_(pa.struct([("chunks", pa.binary()), ("more", pa.binary()), ("ranks", pa.binary())])))])

        def segment() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"part": part, "first": first, "n_ids": n, "doc_ids": doc_ids, "ends": ends, "levels": dac_encode(np.concatenate(held))}], schema)

        end = np.array([end_id], np.uint32)
        for batch in text_slices(batches, "text", 4 << 20):
            ids, offsets = coder.encode(batch["text"])
            for k, doc_id in enumerate(batch["doc_id"].to_pylist()):
                held += [ids[offsets[k] : offsets[k + 1]], end]
                n += int(offsets[k + 1] - offsets[k]) + 1
                doc_ids.append(doc_id)
                ends.append(n)
                if n >= segment_ids:
                    yield segment()
                    first += n
                    doc_ids, ends, held, n = [], [], [], 0
            held = [np.concatenate(held)] if held else []
        if doc_ids:
            yield segment()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    key = [F.col("doc_id"), F.xxhash64("text")]
    rows.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(encode, SEGMENT).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The segments, each with the count of all ids before it as ``first``."""
    segments = spark.read.schema(SEGMENT).parquet(path)
    # one number for each range of the writer, whose count is that of its tasks
    counts = sorted(segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before, rows = 0, []
    for part, n in counts:
        rows.append((part, before))
        before += n
    starts = spark.createDataFrame(rows, "part int, before long")
    return segments.join(F.broadcast(starts), "part").select(F.col("before").alias("start"), "first", "n_ids", "doc_ids", "ends", "levels")


def token_at(segments: DataFrame, doc_id: int | None, i: int) -> int:
    """The i-th id of a document (of repeated rows, of the first), by one look at each level of the one segment that is fetched."""
    own = segments.filter(F.exists("doc_ids", lambda d: d.eqNullSafe(F.lit(doc_id).cast("long")))).orderBy("start", "first").limit(1).collect()
    if not own:
        raise KeyError(f"no document {doc_id}")
    k = own[0].doc_ids.index(doc_id)
    begin = own[0].ends[k - 1] if k else 0
    if not 0 <= i < own[0].ends[k] - begin:
        raise IndexError(i)
    return dac_at(own[0].levels, begin + i)


def token_spans(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the stored codes."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = dac_take(row["levels"], np.arange(row["n_ids"])).astype("<u4")
                ends = np.array(row["ends"], np.int64)
                begins = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(begins, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(begins + (row["start"] + row["first"])), pa.array(ends - begins), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
