"""Operator 1: best-fit packing of token pieces into sequences of bounded length.

Hierarchical residual packing.  Each partition cuts its documents into pieces and packs them by
best fit, longest first.  Bins that are nearly full leave as sequences.  The underfull ones become
items of a tree merge: each round deals them anew to as many groups as their number asks for, packs
every group by best fit again, and emits what is nearly full.  It ends when one group has packed all,
or when a round saves under ``LEAST_SAVING`` of the bins; a group never gathers what the rounds before
could not shrink.

A null or empty text is the single end token.  Repeated rows are packed as often as they occur; a
null doc_id is kept; other columns are not read.  Only pieces, bins and their sizes are held or
shuffled, never texts or ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, staged, text_slices
from .word_encoder import encoder

LEAST_SAVING = 0.01
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, place long, fill long"


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit decreasing: the bin of each item, its offset there, and each bin's fill.

    Bins stand in one stack for each free size; a bit for each non-empty stack makes the search
    for the least sufficient free size one operation on an integer.
    """
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    fills: list[int] = []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_sizes = 0
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        fitting = open_sizes >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            b = stacks[free].pop()
            if not stacks[free]:
                open_sizes ^= 1 << free
        else:
            free, b = capacity, len(fills)
            fills.append(0)
        bins[k], offsets[k] = b, fills[b]
        fills[b] += size
        left = free - size
        if left:
            stacks[left].append(b)
            open_sizes |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


def token_pieces(batches: Iterator[pa.RecordBatch], tokenizer: str, capacity: int, end_id: int) -> Iterator[tuple]:
    """Columns doc_id, piece, start, length, crc of each slice of a partition."""
    coder = encoder(tokenizer)
    for batch in text_slices(batches, "text", 4 << 20):
        ids, offsets = coder.encode(batch["text"])
        doc_ids, rows = batch["doc_id"].to_pylist(), []
        end = np.array([end_id], "<u4")
        for k, doc_id in enumerate(doc_ids):
            own = np.concatenate([ids[offsets[k] : offsets[k + 1]], end])
            for piece, start in enumerate(range(0, len(own), capacity)):
                part = own[start : start + capacity]
                rows.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes())))
        del ids
        give_back()
        yield rows


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, near_full: int = 8, group_items: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``near_full``: bins with at most that much room left are final; ``group_items``: items that one
    task of a merge round packs.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for part in token_pieces(batches, tokenizer, capacity, end_id) for r in part]
        if not rows:
            return
        doc_id, piece, start, length, crc = zip(*rows, strict=True)
        length = np.array(length, np.int64)
        bins, place, fills = best_fit(length, capacity)
        columns = [pa.array(doc_id, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length), pa.array(crc, pa.int64()), pa.array(bins + (TaskContext.get().partitionId() << 36)), pa.array(place), pa.array(fills[bins])]
        out = pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "place", "fill"])
        for at in range(0, out.num_rows, 10_000):
            yield out.slice(at, 10_000)

    pieces = staged(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(local, PIECES), "pieces")
    moved = merge_rounds(pieces.filter(F.col("fill") < capacity - near_full).groupBy("bin").agg(F.max("fill").alias("fill")), capacity, near_full, group_items)
    own = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if moved is None:
        return pieces.select(*own, F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
    joined = pieces.join(moved, "bin", "left")
    return joined.select(*own, F.coalesce("target", "bin").alias("sequence_id"), (F.col("place") + F.coalesce("shift", F.lit(0))).alias("offset"))


def merge_rounds(items: DataFrame, capacity: int, near_full: int, group_items: int) -> DataFrame | None:
    """bin, target, shift of the bins that moved into another: bin's contents start at ``shift`` of ``target``."""

    def one_group(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("bin", kind="stable")
        bins, shift, fills = best_fit(group["fill"].to_numpy(), capacity)
        # the bin that starts a merged one lends it its number
        names = np.empty(len(fills), np.int64)
        first = shift == 0
        names[bins[first]] = group["bin"].to_numpy()[first]
        return pd.DataFrame({"bin": group["bin"], "target": names[bins], "shift": shift, "fill": fills[bins]})

    moved, n, rounds = None, items.count(), 0
    while n > 1:
        groups = group_count(n, group_items)
        dealt = items.withColumn("group", group_of(groups, rounds))
        packed = staged(dealt.groupBy("group").applyInPandas(lambda g: one_group(g[["bin", "fill"]]), "bin long, target long, shift long, fill long"), "merged")
        if moved is None:
            moved = packed.select("bin", "target", "shift")
        else:
            later = packed.select(F.col("bin").alias("target"), F.col("target").alias("to"), F.col("shift").alias("by"))
            moved = staged(moved.join(later, "target", "left").select("bin", F.coalesce("to", "target").alias("target"), (F.col("shift") + F.coalesce("by", F.lit(0))).alias("shift")), "moved")
        items = packed.filter((F.col("bin") == F.col("target")) & (F.col("fill") < capacity - near_full)).select("bin", "fill")
        left, rounds = items.count(), rounds + 1
        if groups == 1 or n - left < LEAST_SAVING * n:
            break
        n = left
    return moved


def group_count(n: int, group_items: int) -> int:
    """So many groups that an even deal fills them by half, and none beyond ``group_items``."""
    return 1 if n <= group_items else -(-2 * n // group_items)


def group_of(groups: int, rounds: int) -> F.Column:
    return F.pmod(F.xxhash64("bin", F.lit(rounds)), F.lit(groups))
