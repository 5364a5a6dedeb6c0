"""Operator 6: exact Jaccard self-join on word shingles, by set-relation skipping.

A document's set holds the hashes of its distinct five-word shingles.  Two sets link when
7 * overlap >= 3 * (sum of sizes), which is a Jaccard similarity of 0.75 or more.

* Equal sets have equal answers: only one set of each digest (that of the least doc_id) goes on.
* Index lists: a set of n hashes, rarest first by a count sketch over the whole corpus, is listed
  under its first n - ceil(3n/4) + 1 hashes; a linking pair shares one of them.
* Answers from a similar set's: each set is first compared only with that least member of its lists
  with which it shares the most lists.  What links shares one answer (its component), and pairs
  within it are never looked at.
* What is left are pairs of a list in different components.  Lists are cut into blocks by size
  class and by position, and blocks that cannot hold a linking pair are skipped: the smaller set
  must be within its first n - ceil(6n/7) + 1 hashes, the size classes the same or neighbours.
* A pair's shared lists bound its overlap; what may still reach the threshold is verified on the full sets.

All steps group or join by hash, document or component; none collects a list, a group or a
component.  Null and empty texts have an empty set and link with nothing.  Rows with a null doc_id
are given back with no component.  Repeated rows are copies of one another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, discard, id_filter, join_by_key, maybe_in, staged, text_slices, utf8_bytes
from .components import components
from .word_hashes import shingle_sets

SKETCH_BITS = 19
SKETCH_BLOCK = 1 << 13
SLICE = 2 << 20


def batch_sets(batch: pa.RecordBatch, width: int) -> list[np.ndarray]:
    return shingle_sets(*utf8_bytes(batch["text"]), width)


def shingle_counts(texts: DataFrame, width: int) -> np.ndarray:
    """How many sets have a shingle in each of 2^19 hash slots: a sketch of fixed size over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in text_slices(batches, "text", SLICE):
            sets = batch_sets(batch, width)
            total += np.bincount((np.concatenate(sets) & np.uint64(len(total) - 1)).astype(np.int64), minlength=len(total))
        for block, part in enumerate(total.reshape(-1, SKETCH_BLOCK)):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part.astype("<u4").tobytes()], pa.binary())], ["block", "counts"])

    def add(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(c, "<u4").astype(np.int64) for c in table["counts"].to_pylist()]
        return pa.table({"block": table["block"].slice(0, 1), "counts": pa.array([np.minimum(sum(parts), 0xFFFFFFFF).astype("<u4").tobytes()], pa.binary())})

    rows = texts.select("text").mapInArrow(count, "block int, counts binary").groupBy("block").applyInArrow(add, "block int, counts binary").collect()
    out = np.zeros(1 << SKETCH_BITS, np.uint32)
    for row in rows:
        out[row.block * SKETCH_BLOCK : (row.block + 1) * SKETCH_BLOCK] = np.frombuffer(row.counts, "<u4")
    return out


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n (set size), digest of the set, prefix (its first hashes, rarest first)."""
    counts = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs, width))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = counts.value
        for batch in text_slices(batches, "text", SLICE):
            sets = batch_sets(batch, width)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            prefixes = []
            for s in sets:
                keep = len(s) - -(-3 * len(s) // 4) + 1 if len(s) else 0
                rarest = np.lexsort((s, slots[(s & np.uint64(len(slots) - 1)).astype(np.int64)]))[:keep]
                prefixes.append(s[rarest].view(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array([int.from_bytes(d[:8], "little", signed=True) for d in digests]), pa.array([int.from_bytes(d[8:], "little", signed=True) for d in digests]), pa.ListArray.from_arrays(ends, np.concatenate(prefixes))],
                ["doc_id", "n", "digest1", "digest2", "prefix"],
            )

    return staged(docs.mapInArrow(sign, "doc_id long, n long, digest1 long, digest2 long, prefix array<long>"), "signatures")


def similar(overlap: Column, a: Column, b: Column) -> Column:
    return 7 * overlap >= 3 * (a + b)


def verified(pairs: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """a, b of those pairs of documents whose full sets link."""

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(maybe_in(*bitmap.value, batch["hash"].to_numpy())))
            for part in text_slices(iter([batch]), "text", SLICE):
                sets = [s.view(np.int64) for s in batch_sets(part, width)]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.ListArray.from_arrays(ends, np.concatenate(sets))], ["doc_id", "hashes"])

    wanted = staged(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "wanted")
    bitmap = docs.sparkSession.sparkContext.broadcast(id_filter(wanted))
    hashed = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("hash")).mapInArrow(full, "doc_id long, hashes array<long>")
    sets = staged(hashed.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "sets")
    # compared row by row where they are joined: no batch ever holds the sets of many pairs
    right = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("y")), "b")
    both = right.join(sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("x")), "a")
    linked = staged(both.filter(similar(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"))).select("a", "b"), "links")
    discard(wanted, sets)
    return linked


def possible(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """Pairs that may still link by the lists they share.

    Every hash that is among the first of both sets has a list.  Of the set whose first hashes end
    earlier, only the n - p others can add to the overlap.
    """
    own = lists.select("hash", "rep", "n")
    left = pairs.select("a", "b").join(own.select(F.col("rep").alias("a"), "hash", F.col("n").alias("na")), "a")
    both = left.join(own.select(F.col("rep").alias("b"), "hash", F.col("n").alias("nb")), ["b", "hash"]).groupBy("a", "b").agg(F.count("*").alias("shared"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    others = lambda n: F.ceil(3 * F.col(n) / 4) - 1
    most = F.least(F.col("shared") + F.greatest(others("na"), others("nb")), "na", "nb")
    return both.filter(similar(most, F.col("na"), F.col("nb"))).select("a", "b")


def list_pairs(lists: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of a list that lie in different components and in blocks that may hold a linking pair."""
    member = lists.join(known.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = member.groupBy("hash").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("hash")
    member = staged(member.join(mixed, "hash").withColumn("size_class", F.floor(F.log(F.col("n")) / F.log(F.lit(4 / 3)) + 1e-9).cast("int")), "members")
    small = member.filter(F.col("pos") <= F.col("n") - F.ceil(6 * F.col("n") / 7)).select("hash", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("component").alias("ca"), "size_class")
    large = member.select("hash", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("component").alias("cb"), F.explode(F.array("size_class", F.col("size_class") - 1, F.col("size_class") - 2)).alias("size_class"))
    need = 3 * (F.col("na") + F.col("nb"))
    fits = (F.col("ca") != F.col("cb")) & ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))) & (4 * F.col("na") >= 3 * F.col("nb")) & (7 * (F.col("na") - F.col("pa")) >= need) & (7 * (F.col("nb") - F.col("pb")) >= need)
    return small.join(large, ["hash", "size_class"]).filter(fits).select("a", "b").distinct()


def ngram_components(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links) of every row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = signatures(docs, width)
    key = ["digest1", "digest2", "n"]
    sets = signed.filter((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy(*key).agg(F.min("doc_id").alias("rep"), F.first("prefix").alias("prefix"))
    reps = staged(signed.filter((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "reps")

    entries = sets.select("rep", "n", F.posexplode("prefix").alias("pos", "hash"))
    shared = entries.groupBy("hash").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).filter("pivot < last").select("hash", "pivot")
    packed = entries.select("hash", "rep", (F.shiftleft("n", 32) + F.col("pos")).alias("at"))
    lists = staged(packed.join(shared, "hash").select("hash", "rep", F.shiftright("at", 32).alias("n"), F.col("at").bitwiseAND((1 << 32) - 1).alias("pos"), "pivot"), "lists")

    shares = lists.filter("rep <> pivot").groupBy("rep", "pivot").agg(F.count("*").alias("shared"))
    first = shares.groupBy(F.col("rep").alias("b")).agg(F.max_by("pivot", F.struct("shared", -F.col("pivot"))).alias("a")).select("a", "b")
    links = verified(staged(possible(first, lists), "first"), docs, width)
    known = staged(components(links), "components")
    rest = staged(possible(list_pairs(lists, known), lists).join(links.select("a", "b").union(links.select("b", "a")), ["a", "b"], "left_anti"), "pairs")
    discard(lists)
    more = verified(rest, docs, width)
    final = components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))

    # each set's answer, which its copies share
    answers = staged(reps.join(final.withColumnRenamed("node", "rep"), "rep", "left").select(*key, "copies", F.coalesce("component", "rep").alias("component_id")), "answers")
    discard(rest, more, known, links, reps)
    named = join_by_key(signed.select("doc_id", *key), answers, key, "copies", signed.count(), "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, width: int = 5) -> DataFrame:
    """One document of each component: that of the least doc_id, with all its columns.  Rows without doc_id stay."""
    answers = staged(ngram_components(docs, width).filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("rows")), "answers")
    repeated = answers.filter("rows > 1 and doc_id = component_id").select("doc_id")
    gone = broadcast_if_small(answers.filter("rows > 1 or doc_id <> component_id").select("doc_id"), 500_000)
    once = docs.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    own = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    return own.unionByName(once) if repeated.limit(1).count() else own
