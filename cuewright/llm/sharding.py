"""Operator 4: shards of bounded bytes by extendible hashing, in DataFrame operations only.

A row's key hash has 60 bits.  The directory is indexed by the first bits of the hash; a bucket over
``limit`` bytes splits on its next bit, and no other does, so the leaves have depths of their own.
One grouped pass sizes all prefixes down to a depth with many cells a shard; only cells that are
still too large are sized again, deeper.

A bucket whose rows all have one hash cannot split: a single row larger than the limit is a shard of
its own, and repeated rows spread over overflow pages of at most ``limit`` bytes (a row above half
the limit has a page to itself).  Null keys hash as the word "null"; null texts have 0 bytes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small, staged

BITS = 60
FINER = 5  # levels of cells below the depth at which the average bucket meets the limit
BROADCAST_ROWS = 200_000


def key_hash(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")), 1, 15), 16, 10).cast("long")


def prefix(h: Column, depth: Column | int) -> Column:
    return F.call_function("shiftright", h, (F.lit(BITS) - depth).cast("int"))


def leaves(cells: DataFrame, shallow: int, deep: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Leaves (depth, prefix, bytes, rows, whole) among the prefixes of ``cells``, and each cell's leaf depth, null if none."""
    levels = cells.select("cell", "bytes", "rows", "low", "high", F.explode(F.sequence(F.lit(shallow), F.lit(deep))).alias("depth"))
    at = levels.withColumn("prefix", F.call_function("shiftright", "cell", F.lit(deep) - F.col("depth")))
    sizes = at.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high"))
    fits = staged(sizes.filter((F.col("bytes") <= limit) | (F.col("low") == F.col("high"))).select("depth", "prefix", "bytes", "rows"), "fitting")
    own = at.select("cell", "depth", "prefix").join(fits.select("depth", "prefix"), ["depth", "prefix"]).groupBy("cell").agg(F.min("depth").alias("depth"))
    return fits, cells.select("cell").join(own, "cell", "left")


def assign(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, shard (the bucket's bits, with its page after a dot), depth, shard_bytes of every row."""
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")
    rows = staged(docs.select(F.col(id_col).alias("doc_id"), size.alias("n_bytes"), key_hash(F.col(id_col)).alias("h")), "keys")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    deep = min(BITS, max(0, math.ceil(math.log2(max(total / limit, 1)))) + FINER)
    shallow, open_rows, done = 0, rows, None
    while True:
        cells = staged(open_rows.groupBy(prefix(F.col("h"), deep).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("rows"), F.min("h").alias("low"), F.max("h").alias("high")), "cells")
        fits, depths = leaves(cells, shallow, deep, limit)
        depths = staged(depths, "depths")
        leaf = F.struct("depth", F.call_function("shiftright", "cell", F.lit(deep) - F.col("depth")).alias("prefix"))
        closed = depths.filter(F.col("depth").isNotNull()).select("cell", leaf.alias("leaf")).select("cell", "leaf.depth", "leaf.prefix").join(fits, ["depth", "prefix"])
        named = open_rows.withColumn("cell", prefix(F.col("h"), deep)).join(broadcast_if_small(closed, BROADCAST_ROWS), "cell").drop("cell").withColumnRenamed("bytes", "shard_bytes")
        done = named if done is None else done.unionByName(named)
        still = depths.filter(F.col("depth").isNull()).select("cell")
        if not still.limit(1).count():
            break
        open_rows = staged(open_rows.withColumn("cell", prefix(F.col("h"), deep)).join(still, "cell", "left_semi").drop("cell"), "open")
        shallow, deep = deep + 1, min(BITS, deep + 8)
    bits = F.when(F.col("depth") > 0, F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0"))).otherwise("")
    out = done.select("doc_id", "n_bytes", F.concat(F.lit("b"), bits).alias("shard"), F.col("depth").cast("int").alias("depth"), "shard_bytes", "rows", "h")
    full = (F.col("shard_bytes") > limit) & (F.col("rows") > 1)
    columns = ["doc_id", "n_bytes", "shard", "depth", "shard_bytes"]
    if not done.filter(full).limit(1).count():
        return out.select(*columns)
    return out.filter(~full).select(*columns).unionByName(pages(out.filter(full), limit).select(*columns))


def pages(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of one hash on pages of at most ``limit`` bytes, numbered within each input partition, so that no task takes a hash as a whole."""
    rows = rows.withColumn("task", F.spark_partition_id())
    order = W.partitionBy("shard", "task").orderBy("n_bytes", "doc_id")
    before = F.sum("n_bytes").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n_bytes")
    large = F.concat(F.lit("r"), F.row_number().over(order).cast("string"))
    half = max(limit // 2, 1)
    page = F.when(F.col("n_bytes") > half, large).otherwise(F.floor(before / half).cast("string"))
    # staged: a task's number is not the same in two plans
    named = staged(rows.withColumn("shard", F.concat_ws(".", "shard", F.col("task").cast("string"), page)), "pages")
    return named.drop("shard_bytes").join(named.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes")), "shard")


def write_shards(docs: DataFrame, path: str, limit: int) -> None:
    """Write the rows of ``docs`` to one folder a shard.  doc_id must tell the rows apart; repeated rows share a shard."""
    own = assign(docs, limit).select("doc_id", "shard").dropDuplicates(["doc_id"])
    named = docs.drop("shard").join(own.withColumnRenamed("doc_id", "id_"), F.col("doc_id").eqNullSafe(F.col("id_"))).drop("id_")
    named.repartition("shard").write.partitionBy("shard").parquet(path)


def shard_sql(limit: int, most_depth: int = 40) -> str:
    """The same assignment as DuckDB SQL, sizing every depth outright; without repeated rows above the limit."""
    return f"""
        WITH r AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h FROM documents),
        lv AS (SELECT d, h >> ({BITS} - d) AS p, sum(n_bytes) AS s, min(h) AS lo, max(h) AS hi FROM r, (SELECT CAST(unnest(range(0, {most_depth + 1})) AS INTEGER) AS d) GROUP BY 1, 2),
        leaf AS (SELECT r.doc_id, r.n_bytes, r.h, lv.d, lv.p, lv.s, row_number() OVER (PARTITION BY r.doc_id ORDER BY lv.d) AS k
                 FROM r JOIN lv ON lv.p = r.h >> ({BITS} - lv.d) WHERE lv.s <= {limit} OR lv.lo = lv.hi)
        SELECT doc_id, n_bytes, 'b' || CASE WHEN d = 0 THEN '' ELSE lpad(bin(p), d, '0') END AS shard, d AS depth, CAST(s AS BIGINT) AS shard_bytes FROM leaf WHERE k = 1
    """
