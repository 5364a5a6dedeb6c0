"""Operator 7 as registered: every later occurrence of a repeated line, and of a repeated run of words.

A line's digest is that of its words (A-Z in lower case, white space between them as one).  Digests are
grouped over the whole corpus; the earliest occurrence, by (doc_id, place), stays and all later ones
go, however short the line is.  A repeated paragraph goes as its lines.

Inside and across lines, every run of ``RUN`` words goes that stands word for word earlier in the
corpus (in the same document, where the two don't overlap), whatever stands around it: a longer repeated
passage goes whole, to its last word.  Removed spans are code points of the original text; spans that
overlap are one.

Null texts are empty and keep null.  Repeated rows (same doc_id) are one document and share its spans.
Rows with a null doc_id are ranked nowhere and come back whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_by_key, let, maybe_in, staged, text_slices, utf8_bytes
from .word_hashes import FACTOR, mix, words

RUN = 25  # words of the shortest run that goes inside lines
KEY = 10  # words of an anchor
SPANS = "array<struct<start: int, end: int>>"


class Words:
    """The words of many texts, and the digest of any run of them in constant time."""

    def __init__(self, flat: np.ndarray, offsets: np.ndarray):
        self.hashes, starts, ends, self.at = words(flat, offsets)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.at))
        points = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])
        base = points[offsets[self.text]]
        self.start, self.end = points[starts] - base, points[ends] - base
        self.place = np.arange(len(self.hashes)) - self.at[self.text]
        self.line = np.concatenate([[0], np.cumsum(flat == 0x0A)])[starts]
        one = np.ones(1, np.uint64)
        inverse = np.uint64(pow(int(FACTOR), -1, 1 << 64))
        powers = np.multiply.accumulate(np.concatenate([one, np.full(len(self.hashes), FACTOR)]))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hashes * powers[:-1], dtype=np.uint64)])
        self.undo = np.multiply.accumulate(np.concatenate([one, np.full(len(self.hashes), inverse)]))
        self.others = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.hashes + FACTOR) * powers[:-1], dtype=np.uint64)])

    def digests(self, first: np.ndarray, stop: np.ndarray, other: bool = False) -> np.ndarray:
        """Digests of the runs from word ``first`` up to word ``stop``, the same wherever a run stands; ``other``: independent ones."""
        sums = self.others if other else self.sums
        return mix((sums[stop] - sums[first]) * self.undo[first] + mix((stop - first).astype(np.uint64)))

    def spans(self, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """First code point and end of the runs in one number, which orders them as the text does."""
        return (self.start[first] << 32) + self.end[stop - 1]

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """First word and end of each line that has words."""
        head = np.ones(len(self.hashes), bool)
        head[1:] = (self.text[1:] != self.text[:-1]) | (self.line[1:] != self.line[:-1])
        first = np.flatnonzero(head)
        return first, np.append(first[1:], len(self.hashes)) if len(first) else first

    def groups(self) -> tuple[np.ndarray, ...]:
        """Anchor, first and last run of each group of neighbouring runs of ``RUN`` words that share their anchor.

        A run's anchor is the leftmost of its ``KEY``-word pieces with the least digest, so equal runs
        have equal anchors wherever they stand, and each text's runs fall into few groups.
        """
        n = len(self.hashes) - RUN + 1
        none = np.zeros(0, np.int64)
        if n <= 0:
            return none.astype(np.uint64), none, none
        k = np.arange(len(self.hashes) - KEY + 1)
        keys = self.digests(k, k + KEY)
        least, shift = keys[:n].copy(), np.zeros(n, np.int8)
        for j in range(1, RUN - KEY + 1):
            less = keys[j : n + j] < least
            least[less] = keys[j : n + j][less]
            shift[less] = j
        run = np.flatnonzero(self.text[:n] == self.text[RUN - 1 :])
        if not len(run):
            return none.astype(np.uint64), none, none
        anchor = run + shift[run]
        head = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (run[1:] != run[:-1] + 1)]))
        return least[run[head]], run[head], run[np.append(head[1:], len(run)) - 1]


def bitmap_of(rows: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of the rows' digest ^ doc_id ^ span, and its mask; 16 bits a row, at most 8 MB."""
    bits = min(1 << 26, 1 << (max(16 * rows.count(), 1024) - 1).bit_length())
    slots = rows.select(F.expr(f"(digest ^ doc_id ^ span) & {bits - 1}L").alias("slot"))
    found = slots.groupBy(F.shiftright("slot", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 31 as int))")).alias("bits")).toPandas()
    out = np.zeros(bits // 32, np.uint32)
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).astype(np.uint32)
    return out, bits - 1


START, END = "shiftright({}, 32)", "({} & 4294967295)"


def is_later(disjoint: str) -> F.Column:
    """Whether a row stands in a later document than its ``first``, or later in the same one: behind its end where ``disjoint``."""
    behind = f"if({disjoint}, {START.format('span')} >= {END.format('first.span')}, span > first.span)"
    return F.expr(f"doc_id > first.doc_id or (doc_id = first.doc_id and {behind})")


def cut_out(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.expr(START.format("span")).cast("int").alias("start"), F.expr(END.format("span")).cast("int").alias("end"))


def later_spans(docs: DataFrame) -> DataFrame:
    """doc_id, start, end of each later occurrence of a line, and of a run of ``RUN`` words.

    Lines (odd digests) and groups of runs (even ones) are compared whole at first, by two independent
    digests of 64 bits.  Where an anchor stands in groups that differ, or in one that overlaps its own
    earliest occurrence, a second pass compares run by run.
    """

    def table(ids: pa.Array, *columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c.view(np.int64)) for c in columns)], ["doc_id", "digest", "whole", "span"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", 4 << 20):
            w = Words(*utf8_bytes(batch["text"]))
            (first, stop), (anchor, low, high) = w.lines(), w.groups()
            digest = np.concatenate([w.digests(first, stop) | np.uint64(1), anchor & ~np.uint64(1)])
            whole = np.concatenate([w.digests(first, stop, other=True), w.digests(low, high + RUN)])
            first, stop = np.concatenate([first, low]), np.concatenate([stop, high + RUN])
            yield table(batch["doc_id"].take(pa.array(w.text[first])), digest, whole, w.spans(first, stop))

    schema, key = "doc_id long, digest long, whole long, span long", ["digest", "whole"]
    rows = staged(docs.mapInArrow(split, schema), "rows")
    # digests alone tell which units recur; only their rows go on
    often = staged(rows.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1"), "often")
    again = staged(join_by_key(rows, often, ["digest"], "n", rows.count()), "repeated")
    discard(rows, often)
    total = again.count()
    first = staged(again.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "span")).alias("first")), "first")
    known = staged(join_by_key(again, first.filter("n > 1"), key, "n", total), "known")
    discard(again)
    group = "digest & 1 = 0"
    whole = cut_out(known.filter(is_later(group)))

    # whole groups that repeat are done; what is left are the groups at the edges of a repeated passage
    own = first.filter(group).select(*key, "first.*")
    overlaps = known.filter(F.expr(group) & ~is_later(group) & (F.struct("doc_id", "span") > F.col("first"))).select(*key, "doc_id", "span")
    several = own.unionByName(overlaps).groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1")
    several = staged(several, "several")
    wanted = staged(join_by_key(own.unionByName(overlaps), several, ["digest"], "n", total).select("digest", "doc_id", "span"), "edges")
    discard(first, several)
    bitmap = docs.sparkSession.sparkContext.broadcast(bitmap_of(wanted))

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", 2 << 20):
            w = Words(*utf8_bytes(batch["text"]))
            anchor, low, high = w.groups()
            ids = batch["doc_id"].to_numpy()[w.text[low]]
            good = maybe_in(*bitmap.value, (anchor & ~np.uint64(1)).view(np.int64) ^ ids ^ w.spans(low, high + RUN))
            low, count = low[good], (high - low + 1)[good]
            run = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
            yield table(batch["doc_id"].take(pa.array(w.text[run])), w.digests(run, run + RUN), w.digests(run, run + RUN, other=True), w.spans(run, run + RUN))

    runs = staged(docs.mapInArrow(single, schema), "runs")
    earliest = staged(runs.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "span")).alias("first")).filter("n > 1"), "earliest")
    found = staged(whole.unionByName(cut_out(join_by_key(runs, earliest, key, "n", runs.count()).filter(is_later("true")))), "spans")
    discard(known, wanted, runs, earliest)
    return found


def merged(spans: DataFrame) -> DataFrame:
    """doc_id, removed: each document's spans in order, those that overlap as one."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(batch["spans"].value_lengths().to_numpy(zero_copy_only=False))
            own = np.repeat(np.arange(batch.num_rows), np.diff(ends, prepend=0))
            start, end = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch["spans"].flatten().flatten())
            order = np.lexsort((start, own))
            own, start, end = own[order], start[order], end[order]
            reach = np.maximum.accumulate(end + (own << 32))
            head = np.flatnonzero(np.concatenate([[True], start[1:] + (own[1:] << 32) >= reach[:-1]]))
            last = np.append(head[1:], len(own)) - 1
            pairs = pa.StructArray.from_arrays([pa.array(start[head].astype(np.int32)), pa.array((reach[last] - (own[last] << 32)).astype(np.int32))], ["start", "end"])
            edges = np.searchsorted(own[head], np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.ListArray.from_arrays(pa.array(edges), pairs)], ["doc_id", "removed"])

    # one document's distinct spans, which its own text bounds: repeated rows of a document have the same
    return spans.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("spans")).mapInArrow(merge, f"doc_id long, removed {SPANS}")


def without_spans(text: str = "text", removed: str = "removed") -> F.Column:
    """``text`` without the spans; white space around them stays."""
    edges = F.concat(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))), F.col(removed), F.array(F.struct(F.char_length(text).alias("start"), F.lit(0).alias("end"))))
    piece = lambda e, k: F.substring(F.col(text), F.get(e, k)["end"] + 1, F.get(e, k + 1)["start"] - F.get(e, k)["end"])
    kept = let(edges, lambda e: F.transform(F.sequence(F.lit(0), F.size(e) - 2), lambda k: piece(e, k)))
    return F.when(F.size(removed) > 0, F.array_join(kept, "")).otherwise(F.col(text))


def dedup_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text without its removed spans, removed spans with original offsets, n_removed code points."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = own.filter(F.col("doc_id").isNotNull())
    spans = merged(later_spans(rows))
    joined = own.join(spans, "doc_id", "left").withColumn("removed", F.coalesce("removed", F.array().cast(SPANS)))
    size = F.aggregate("removed", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    return joined.select("doc_id", without_spans().alias("text"), "removed", size.cast("long").alias("n_removed"))
