"""Operator 13: how filters of documents interact, over every order in which they could be applied.

Five filters judge a text: A too few words, B too few distinct ones, C too many capitals, D a forbidden
character, E the same text as a document with a smaller id.  A bit mask holds what a document fails, and
everything asked for follows from how many documents of a part have each mask.

E needs the smallest id of each text.  Texts are routed by their xxHash through an RDD, and chains under
a fingerprint hold the full text with the smallest id met so far, so a collision costs a comparison and
no error.  A row whose id is not the smallest is told at once and kept no longer.  Each task first does
this over its own rows, in chains of at most ``chain_bytes``: so of a text that a third of all rows have,
one row for each such chain moves on, and no task gathers the rest.  Masks then meet the labels by id,
and combineByKey merges vectors of counts, one for each part.

A null text is an empty one, a null part an empty string.  A null doc_id is neither smaller nor larger
than another, and has no label.  Of repeated rows with one id and one text none is smaller.  A document is
good or toxic if any of its labels says so.  Empty documents give no rows.  Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
REPEATED = 1 << FILTERS.index("E")
MASKS = np.arange(1 << len(FILTERS))
FAILS = {f: MASKS >> k & 1 == 1 for k, f in enumerate(FILTERS)}
N_FAILS = sum(FAILS[f].astype(np.int64) for f in FILTERS)

LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 3
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
FORBIDDEN = re.compile(rb"[#$%&*|]")
SPACE = re.compile(rb"[\x20\x09-\x0D]")
RECORD = "doc_id long, part string, mask int, n long"
RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def stretches(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """``data`` in stretches of about ``size`` bytes, cut at white space."""
    at = 0
    while at < len(data):
        edge = SPACE.search(data, at + size)
        end = edge.start() if edge else len(data)
        yield data[at:end]
        at = end


def text_mask(text: str, data: bytes) -> int:
    """What a text fails by itself.  ``data`` is the text in UTF-8, whose own split knows just the six white space characters."""
    n, distinct = 0, set()
    for stretch in stretches(data):
        words = stretch.split()
        n += len(words)
        distinct.update(words)
    capitals = len(data) - len(data.translate(None, CAPITALS))
    fails = (n < LEAST_WORDS, 100 * len(distinct) < DISTINCT_PERCENT * n, 100 * capitals > CAPITAL_PERCENT * len(text), FORBIDDEN.search(data) is not None)
    return sum(1 << k for k, failed in enumerate(fails) if failed)


class Chains:
    """The smallest id of each text met, with the rows that have it; every other row is told by ``add``."""

    def __init__(self) -> None:
        self.chains: dict[int, list[list]] = {}
        self.held = 0

    def add(self, key: int, text: bytes, doc_id: int, rows: dict[tuple[str, int], int]) -> Iterator[tuple]:
        """The rows (doc_id, part, mask, n) that this one shows, or that are shown by it, not to be the smallest."""
        chain = self.chains.setdefault(key, [])
        entry = next((e for e in chain if e[0] == text), None)
        if entry is None:
            chain.append([text, doc_id, dict(rows)])
            self.held += len(text) + 200
            return
        if doc_id == entry[1]:
            for own, n in rows.items():
                entry[2][own] = entry[2].get(own, 0) + n
            return
        late_id, late = (doc_id, rows) if doc_id > entry[1] else (entry[1], entry[2])
        if doc_id < entry[1]:
            entry[1:] = [doc_id, dict(rows)]
        for (part, mask), n in late.items():
            yield late_id, part, mask | REPEATED, n

    def smallest(self) -> Iterator[tuple]:
        """key, text, doc_id, rows of each text; nothing is held afterwards."""
        for key, chain in self.chains.items():
            for text, doc_id, rows in chain:
                yield key, text, doc_id, rows
        self.chains, self.held = {}, 0


def told(record: tuple) -> tuple[int, tuple]:
    """A record that is done, on its way by its id."""
    return xxhash.xxh3_64_intdigest(str(record[0])), (None, record)


def routed(rows: Iterator, chain_bytes: int, fingerprint: Callable[[bytes], int]) -> Iterator[tuple[int, tuple]]:
    """What is known within a task: records that are done, and each text's smallest id with its text."""
    chains = Chains()
    for doc_id, text, part in rows:
        data = text.encode()
        mask = text_mask(text, data)
        if doc_id is None:
            yield told((None, part, mask, 1))
            continue
        for record in chains.add(fingerprint(data), data, doc_id, {(part, mask): 1}):
            yield told(record)
        if chains.held > chain_bytes:
            yield from ((key, own) for key, *own in chains.smallest())
    yield from ((key, own) for key, *own in chains.smallest())


def settled(pairs: Iterator[tuple[int, tuple]]) -> Iterator[tuple]:
    """All records of the texts that were routed to one partition."""
    chains = Chains()
    for key, (text, *rest) in pairs:
        if text is None:
            yield rest[0]
        else:
            yield from chains.add(key, text, *rest)
    for _, _, doc_id, rows in chains.smallest():
        for (part, mask), n in rows.items():
            yield doc_id, part, mask, n


def records(docs: DataFrame, partition_bytes: int = 64 << 20, chain_bytes: int = 32 << 20, fingerprint: Callable[[bytes], int] = xxhash.xxh3_64_intdigest, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part, mask and how many rows have them.  Partitions are so many that each gets about ``partition_bytes`` of text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // partition_bytes))
    by_key = rows.rdd.mapPartitions(lambda own: routed(own, chain_bytes, fingerprint)).partitionBy(n, lambda key: key % n)
    return docs.sparkSession.createDataFrame(by_key.mapPartitions(settled), RECORD)


def repeated_ids(docs: DataFrame, **options) -> DataFrame:
    """doc_id and n of the rows whose text a smaller id has."""
    return records(docs, **options).filter(F.col("mask").bitwiseAND(REPEATED) != 0).groupBy("doc_id").agg(F.sum("n").alias("n"))


def mask_counts(rows: DataFrame, labels: DataFrame) -> RDD:
    """(part, counts): of all documents, the good and the toxic ones, how many have each mask."""
    flag = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(c)
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality"), flag("toxic"))
    judged = rows.join(known, "doc_id", "left").select("part", "mask", "n", F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))

    def add(counts: np.ndarray, row: tuple) -> np.ndarray:
        mask, n, good, toxic = row
        counts[:, mask] += (n, n * good, n * toxic)
        return counts

    start = lambda row: add(np.zeros((3, len(MASKS)), np.int64), row)
    return judged.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(start, add, lambda a, b: a + b)


def order_rows(part: str, counts: np.ndarray) -> Iterator[tuple]:
    """Every step of every order, from one part's counts."""
    every = counts[0]
    orders = list(permutations(FILTERS))
    # of k filters that a document fails, each comes first in one k-th of the orders
    first = np.where(N_FAILS > 0, len(orders) // np.maximum(N_FAILS, 1), 0)
    unique = {f: int(every[1 << k]) for k, f in enumerate(FILTERS)}
    shapley = {f: int((every * first)[FAILS[f]].sum()) for f in FILTERS}
    for order in orders:
        gone = np.zeros(len(MASKS), bool)
        for step, f in enumerate(order, 1):
            here, again = FAILS[f] & ~gone, FAILS[f] & gone
            gone = gone | here
            removed, good, toxic = (int(c[here].sum()) for c in counts)
            yield part, "".join(order), step, int(every[~gone].sum()), removed, int(every[again].sum()), unique[f], good, toxic, shapley[f]


def audit(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row for each part, order of the filters and step.  The options are those of ``records``."""
    counts = mask_counts(records(docs, **options), labels)
    return docs.sparkSession.createDataFrame(counts.flatMap(lambda pair: order_rows(*pair)), RESULT)


#: The same by DuckDB's SQL, each order and step counted anew.
AUDIT_SQL = r"""
    WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
    d AS (SELECT doc_id, part, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM w),
    l AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY 1),
    m AS (SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS fails,
              count(*) AS n, count_if(coalesce(good, false)) AS good, count_if(coalesce(toxic, false)) AS toxic FROM d LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
    f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
    o AS (SELECT f1.f || f2.f || f3.f || f4.f || f5.f AS filter_order FROM f f1, f f2, f f3, f f4, f f5 WHERE len(list_distinct([f1.f, f2.f, f3.f, f4.f, f5.f])) = 5),
    s AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM o),
    g AS (SELECT part, filter_order, step, filter_order[step] AS f, fails, n, good, toxic, contains(fails, filter_order[step]) AS hit, regexp_matches(fails, '[' || filter_order[1:step - 1] || '0]') AS gone FROM m, s),
    r AS (SELECT part, filter_order, step, f, sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant,
              sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM g GROUP BY ALL)
    SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
        CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r
"""
