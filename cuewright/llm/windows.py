"""Operator 12: online packing of whole documents into windows by sums of squares.

Each partition is a stream.  A document of up to a window's tokens goes whole into the fill level that
leaves the least sum of squared counts of partially filled windows; a level array holds the counts.
Longer documents give full windows first, and their rest goes the same way.  When a stream ends, or has
more than ``most_open`` windows open, its windows are settled: the emptiest ones give pieces to the
fullest until these are full, and what one window is left is cut at powers of two.  So no window needs
padding, and only settling cuts documents that fit.

Nothing is shuffled, and a task holds the ids of one slice of texts and of its open windows.  A window's
number is that of its partition and its place there.  A null or empty text is the single end token;
repeated rows are packed as often as they occur; a null doc_id is kept; other columns are not read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_encoder import encoder
from .common import text_slices

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
NEVER = np.int64(1) << 40


@dataclass(slots=True)
class Piece:
    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int


class Levels:
    """How many open windows have each fill, and what it costs to raise one of them.

    Raising a window from fill h to h + s changes the sum of squares by 1 - 2 count[h] and by
    1 + 2 count[h + s].  New windows (fill 0) and full ones are not counted.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.leaving = np.full(capacity + 1, NEVER)
        self.arriving = np.ones(capacity + 1, np.int64)
        self.leaving[0] = self.arriving[capacity] = 0

    def best(self, size: int) -> int:
        """The level to raise by ``size``; of equal ones the fullest."""
        change = self.leaving[: self.capacity - size + 1] + self.arriving[size:]
        return self.capacity - size - int(np.argmin(change[::-1]))

    def add(self, level: int, by: int) -> None:
        if 0 < level < self.capacity:
            n = self.count[level] = self.count[level] + by
            self.leaving[level] = 1 - 2 * n if n else NEVER
            self.arriving[level] = 1 + 2 * n


class Packer:
    """One stream.  ``full`` collects the windows that are done, as lists of pieces."""

    def __init__(self, capacity: int, most_open: int):
        self.capacity, self.most_open = capacity, most_open
        self.levels, self.open = Levels(capacity), [deque() for _ in range(capacity + 1)]
        self.n_open = 0
        self.full: list[list[Piece]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        n, whole = len(ids), len(ids) // self.capacity * self.capacity
        for start in range(0, whole, self.capacity):
            self.full.append([Piece(doc_id, start, ids[start : start + self.capacity], n)])
        if whole < n:
            self.place(Piece(doc_id, whole, ids[whole:].copy(), n))
        if self.n_open > self.most_open:
            self.settle(last=False)

    def place(self, piece: Piece) -> None:
        size = len(piece.ids)
        level = self.levels.best(size)
        window = self.open[level].popleft() if level else []
        self.n_open -= bool(level)
        window.append(piece)
        self.levels.add(level, -1)
        self.put(window, level + size)

    def put(self, window: list[Piece], fill: int) -> None:
        if fill == self.capacity:
            self.full.append(window)
        else:
            self.open[fill].append(window)
            self.levels.add(fill, 1)
            self.n_open += 1

    def settle(self, last: bool) -> None:
        """Fill the open windows from one another; the one that is left stays open, or at the last is cut at powers of two."""
        waiting = deque((window, fill) for fill in range(self.capacity - 1, 0, -1) for window in self.open[fill])
        self.levels, self.open, self.n_open = Levels(self.capacity), [deque() for _ in range(self.capacity + 1)], 0
        while len(waiting) > 1:
            window, fill = waiting.popleft()
            while fill < self.capacity and waiting:
                giver, held = waiting.pop()
                taken = take(giver, self.capacity - fill)
                window += taken
                moved = sum(len(p.ids) for p in taken)
                fill += moved
                if moved < held:
                    waiting.append((giver, held - moved))
            if fill == self.capacity:
                self.full.append(window)
            else:
                waiting.append((window, fill))
        for window, fill in waiting:
            if not last:
                self.put(window, fill)
                continue
            for power in (1 << k for k in range(fill.bit_length())):
                if fill & power:
                    self.full.append(take(window, power))


def take(window: list[Piece], most: int) -> list[Piece]:
    """Up to ``most`` tokens off the window's end; only the last piece taken may be cut."""
    out = []
    while window and most:
        piece = window[-1]
        n = len(piece.ids)
        if n <= most:
            out.append(window.pop())
            most -= n
        else:
            out.append(Piece(piece.doc_id, piece.start + n - most, piece.ids[n - most :], piece.doc_tokens))
            piece.ids, most = piece.ids[: n - most], 0
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, most_open: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, doc_tokens, sequence_id, offset and ids (little-endian unsigned 32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer, end = encoder(tokenizer), Packer(capacity, most_open), np.array([end_id], "<u4")
        number = TaskContext.get().partitionId() << 36
        for batch in text_slices(batches, "text", 4 << 20):
            ids, offsets = coder.encode(batch["text"])
            for k, doc_id in enumerate(batch["doc_id"].to_pylist()):
                packer.add(doc_id, np.concatenate([ids[offsets[k] : offsets[k + 1]], end]))
            yield from rows_of(packer.full, number)
            number, packer.full = number + len(packer.full), []
        packer.settle(last=True)
        yield from rows_of(packer.full, number)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def rows_of(windows: list[list[Piece]], number: int) -> Iterator[pa.RecordBatch]:
    if not windows:
        return
    pieces = [p for w in windows for p in w]
    lengths = np.array([len(p.ids) for p in pieces], np.int64)
    sizes = np.array([len(w) for w in windows])
    before = np.cumsum(lengths) - lengths
    offsets = before - np.repeat(before[np.cumsum(sizes) - sizes], sizes)
    ids = pa.array([p.ids.tobytes() for p in pieces], pa.binary())
    columns = [pa.array([p.doc_id for p in pieces], pa.int64()), pa.array([p.start for p in pieces], pa.int64()), pa.array(lengths), pa.array([p.doc_tokens for p in pieces], pa.int64()), pa.array(np.repeat(np.arange(number, number + len(windows)), sizes)), pa.array(offsets), ids]
    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
