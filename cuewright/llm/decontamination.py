"""Operator 10: benchmark decontamination by SimHash of item-sized windows, in DataFrame operations only.

* Shingles are runs of five lower-case words.  One weighs ln(1 + items / items that have it); one that
  no item has weighs ln(1 + items).  Weights are whole numbers of 1e-12, so sums are the same in any order.
* A window similar to an item holds shingles of that item which weigh ``least`` of the item's weight.
  Of every document, all windows of an item's length that hold so much of it are laid, at every start
  (counting a shingle as often as it stands there, which only lets more windows through).
* Each window is printed once: a 64-bit SimHash in which a shingle votes with the root of its weight.
  With these votes the cosine of two sets is at least common / sqrt(own * other), so that a
  similarity of 0.75 means a cosine of 6/7 at least, and 11 bits of distance on average, with a
  standard deviation of 3, however unequal the weights are.
* Windows and all items of their length meet in a multi-index of BLOCKS wide blocks: every item is
  listed under all values within RADIUS / BLOCKS bits of each of its blocks, which finds every pair
  within RADIUS bits.
* Of a document and an item that so meet, the weighted Jaccard similarity of the exact shingle sets
  verifies every window, at 0.75 or more, and the best one is returned (itself at any distance).

Null and empty texts, and texts or items under five words, match nothing.  Rows with null ids are
passed over.  Repeated rows are one document; different texts of one doc_id are looked at one by one,
and the best window of any counts.  Of repeated item ids, the text of the least hash counts.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, discard, let, staged

WIDTH = 5
BLOCKS, RADIUS = 5, 19  # blocks of 12 or 13 bits; RADIUS < BLOCKS * (bits probed in a block + 1)
EDGES = [64 * k // BLOCKS for k in range(BLOCKS + 1)]
UNIT = 1e12
SIMILARITY = 0.75
BROADCAST_SHINGLES = 1_000_000
BROADCAST_DOCS = 200_000


def words_of(text: Column) -> Column:
    return F.split(F.btrim(F.lower(text), F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+")


def shingles(words: Column) -> Column:
    """Hashes of the runs of five words; a null array for fewer words."""
    runs = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - WIDTH), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WIDTH)]))
    return let(words, lambda w: F.when(F.size(w) >= WIDTH, runs(w)))


def printed(rows: DataFrame, key: list[str]) -> DataFrame:
    """``key``, weight and the SimHash of each group of distinct shingles (h, w): a bit is set if the votes for it are more than half."""
    vote = F.round(F.sqrt(F.col("w") / UNIT) * (1 << 20)).cast("long")
    has = lambda b: F.call_function("shiftright", F.col("h"), F.lit(b)).bitwiseAND(F.lit(1).cast("long"))
    sums = rows.withColumn("vote", vote).groupBy(*key).agg(F.sum("w").alias("weight"), F.sum("vote").alias("votes"), *[F.sum(F.col("vote") * has(b)).alias(f"bit{b}") for b in range(64)])
    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(2 * F.col(f"bit{b}") > F.col("votes"), F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(b))).otherwise(F.lit(0).cast("long")) for b in range(64)])
    return sums.select(*key, "weight", bits.alias("fingerprint"))


def blocks(fingerprint: Column) -> Column:
    """(number, bits) of each block of the fingerprint."""
    part = lambda a, b: F.call_function("shiftright", fingerprint, F.lit(a)).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long"))
    return F.array(*[F.struct(F.lit(k).alias("number"), part(a, b).alias("bits")) for k, (a, b) in enumerate(zip(EDGES, EDGES[1:], strict=False))])


def nearby(radius: int) -> Column:
    """All masks of at most radius / BLOCKS bits of a block."""
    width = max(b - a for a, b in zip(EDGES, EDGES[1:], strict=False))
    return F.array(*[F.lit(sum(1 << b for b in chosen)).cast("long") for n in range(radius // BLOCKS + 1) for chosen in combinations(range(width), n)])


def window_starts(hits: Column, span: Column, bound: Column) -> Column:
    """Starts of the windows of ``span`` shingles in which the hits (pos, w), in order, weigh ``bound`` or more.

    A window whose first hit is the i-th starts after the hit before it; at most ``span`` hits follow.
    """

    def of_hit(x: Column, i: Column) -> Column:
        def tried(own: Column) -> Column:
            inside = lambda s: F.aggregate(own, F.lit(0).cast("long"), lambda n, y: n + F.when(y["pos"] < s + span, y["w"]).otherwise(F.lit(0).cast("long"))) >= bound
            low = F.greatest(x["pos"] - span + 1, F.coalesce(F.get(hits, i - 1)["pos"] + 1, F.lit(0)), F.lit(0))
            return F.when(inside(x["pos"]), F.filter(F.sequence(low, x["pos"]), inside)).otherwise(F.array().cast("array<int>"))

        return let(F.slice(hits, i + 1, span), tried)

    return F.flatten(F.transform(hits, of_hit))


def matches(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, least: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, start (word), n_words, distance, similarity: the best window of each document and item."""
    named = benchmark.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    items = staged(named.select("item_id", words_of(F.col("text")).alias("words")).select("item_id", F.size("words").alias("n_words"), F.array_distinct(shingles(F.col("words"))).alias("hashes")).filter("hashes is not null"), "items")
    n = items.count()
    top = F.lit(round(math.log1p(n) * UNIT))
    each = items.select("item_id", "n_words", F.explode("hashes").alias("h"))
    weights = each.groupBy("h").agg(F.round(F.log(F.lit(1.0) + F.lit(float(n)) / F.count("*")) * UNIT).cast("long").alias("w"))
    listed = staged(each.join(weights, "h"), "listed")
    models = printed(listed, ["item_id", "n_words"]).join(listed.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("h", "w"))).alias("item")), "item_id")
    models = staged(models.withColumnRenamed("weight", "item_weight").withColumnRenamed("fingerprint", "model"), "models")  # an item's shingles, which its text bounds

    own = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("version"))
    key = ["doc_id", "version"]
    met = own.select(*key, F.posexplode(shingles(words_of(F.col("text")))).alias("pos", "h")).join(broadcast_if_small(listed, BROADCAST_SHINGLES), "h")
    # a document's hits of one item, which its text bounds
    pairs = met.groupBy(*key, "item_id", "n_words").agg(F.array_sort(F.collect_set(F.struct("pos", "w", "h"))).alias("hits"))
    shared = F.aggregate(F.array_distinct(F.transform("hits", lambda x: F.struct(x["h"], x["w"].alias("w")))), F.lit(0).cast("long"), lambda s, x: s + x["w"])
    bound = F.col("item_weight") * least - UNIT * 1e-9
    enough = pairs.join(broadcast_if_small(models.select("item_id", "item_weight"), BROADCAST_SHINGLES), "item_id").filter(shared >= bound)
    starts = enough.select(*key, "n_words", F.explode(window_starts(F.col("hits"), F.col("n_words") - WIDTH + 1, bound)).alias("start"))
    starts = staged(starts.distinct(), "starts")

    # the windows' shingles: those that items have with their weights, the others at the top weight
    wanted = broadcast_if_small(starts.select(*key).distinct(), BROADCAST_DOCS)
    texts = staged(own.join(wanted, key, "left_semi").dropDuplicates(key).select(*key, shingles(words_of(F.col("text"))).alias("hashes")), "texts")
    window = F.array_distinct(F.slice("hashes", F.col("start") + 1, F.col("n_words") - WIDTH + 1))
    place = [*key, "n_words", "start"]
    shown = starts.join(texts, key).select(*place, F.explode(window).alias("h")).join(broadcast_if_small(weights, BROADCAST_SHINGLES), "h", "left")
    prints = staged(printed(shown.select(*place, "h", F.coalesce("w", top).alias("w")), place), "prints")

    left = prints.select(*key, "n_words", "fingerprint", F.explode(blocks(F.col("fingerprint"))).alias("block"))
    right = models.select("item_id", "n_words", "model", F.explode(blocks(F.col("model"))).alias("block")).select("item_id", "n_words", "model", "block.number", "block.bits", F.explode(nearby(radius)).alias("mask"))
    probes = right.select("item_id", "n_words", "model", F.struct("number", F.col("bits").bitwiseXOR(F.col("mask")).alias("bits")).alias("block"))
    near = left.join(probes.hint("merge"), ["n_words", "block"]).filter(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("model"))) <= radius).select(*key, "n_words", "item_id").distinct()
    # (merged, as the probes are many more than the items from which Spark would guess their size)
    # of a document and an item that meet, all windows are compared
    near = prints.join(near, [*key, "n_words"])
    both = near.join(texts, key).select(*place, "weight", "fingerprint", "item_id", window.alias("window")).join(broadcast_if_small(models.select("item_id", "item_weight", "item", "model"), BROADCAST_SHINGLES // 50), "item_id")
    common = F.aggregate("item", F.lit(0).cast("long"), lambda s, x: s + F.when(F.array_contains("window", x["h"]), x["w"]).otherwise(F.lit(0).cast("long")))
    scored = both.withColumn("common", common).withColumn("similarity", F.col("common") / (F.col("item_weight") + F.col("weight") - F.col("common"))).filter(F.col("similarity") >= least - 1e-9)
    best = F.max_by(F.struct("start", "n_words", F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("model"))).alias("distance"), "similarity"), F.struct("similarity", -F.col("start")))
    found = staged(scored.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.start", "best.n_words", "best.distance", F.round("best.similarity", 9).alias("similarity")), "matches")
    discard(items, listed, models, starts, texts, prints)
    return found


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a benchmark passage."""
    hit = staged(matches(docs, benchmark).select("doc_id").distinct(), "hit")
    return docs.join(broadcast_if_small(hit, 500_000), "doc_id", "left_anti").select(*docs.columns)
