"""A batch of row operations as one plan: operations become rows with ordinals and meet the table once.

A row of the table is looked at by a fold over the operations that could concern it, in their order, so
each sees what the ones before it left and the last writer of a column counts.  Operations that name the
key are routed by it.  Others (updates by other columns) are joined by the values that they ask for; where
the batch itself sets such a column, every row that the batch touches is shown all of them, as it may come
to have the value only then.  A row that no operation fits at first is touched by none later.

Operations that move a row to another key, or look for rows by columns other than the key before they
insert, depend on other rows.  They are plans of their own, in their place in the order; neighbours of
one kind share a plan.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright import schemas as S

INSERT, UPSERT, UPDATE = "insert", "upsert", "update"
MOST_BROADCAST = 200_000  # operations; a batch beyond it is joined by shuffles
HAS_STATUS = {t for t in S.TABLES if "status" in S.columns_of(t)}


@dataclass(frozen=True)
class Operation:
    """``where``: columns that have to be equal; ``only`` and ``never``: states that a row has to have, or must not have."""

    kind: str
    data: dict
    where: dict = field(default_factory=dict)
    key_fields: tuple[str, ...] = ()
    only: tuple[str, ...] = ()
    never: tuple[str, ...] = ()


@dataclass
class Change:
    """Rows that replace those of ``removed`` keys.  ``held`` frames are cached until the batch ends."""

    rows: DataFrame
    removed: DataFrame | None
    held: list[DataFrame] = field(default_factory=list)

    def applied(self, old: DataFrame, key: str) -> DataFrame:
        kept = old if self.removed is None else old.join(self.removed, key, "left_anti").select(*old.columns)
        return kept.unionByName(self.rows)


def typed(table: str, row: dict) -> dict:
    """The columns of the table that ``row`` gives, as their types; other names are dropped."""
    types = dict(f.split() for f in S.TABLES[table].split(", "))
    cast = {"string": lambda v: v if isinstance(v, str) else str(v), "int": int, "double": float}
    bad = [k for k, v in row.items() if k in types and isinstance(v, dict | list)]
    if bad:
        raise ValueError(f"{table}: {bad} have no single value")
    return {k: None if v is None else cast[types[k]](v) for k, v in row.items() if k in types}


def values(table: str, row: dict) -> tuple:
    return tuple(row.get(c) for c in S.columns_of(table))


def few(df: DataFrame, operations: int) -> DataFrame:
    """A frame made of a batch's operations, whose number is its size bound."""
    return F.broadcast(df) if operations <= MOST_BROADCAST else df


def every(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


class Batch:
    """The operations of one table, applied to ``old``."""

    def __init__(self, spark: SparkSession, table: str):
        self.spark, self.table = spark, table
        self.key, self.columns = S.KEYS[table], S.columns_of(table)
        row = ", ".join(f"{c}: {t}" for c, t in (f.split() for f in S.TABLES[table].split(", ")))
        self.row_type = f"struct<{row}>"
        self.op_type = f"struct<ord: int, kind: string, data: {self.row_type}, given: array<boolean>, where: {self.row_type}, asked: array<boolean>, only: array<string>, never: array<string>>"

    def encoded(self, n: int, o: Operation) -> tuple:
        given = [c in o.data and not (o.kind == UPSERT and c == self.key) for c in self.columns]
        return n, o.kind, values(self.table, o.data), given, values(self.table, o.where), [c in o.where for c in self.columns], list(o.only), list(o.never)

    def kind_of(self, o: Operation) -> tuple:
        """What decides whether two neighbours share a plan."""
        if o.kind == UPSERT and o.key_fields != (self.key,):
            return ("search", o.key_fields)
        if o.kind == UPDATE and self.key in o.data:
            return ("move", id(o))
        return ("rows",)

    def runs(self, operations: list[Operation]) -> list[tuple[str, list[tuple[int, Operation]]]]:
        """Neighbours that share a plan, each with its place in the batch."""
        return [(kind[0], list(own)) for kind, own in groupby(enumerate(operations), lambda no: self.kind_of(no[1]))]

    def apply(self, old: DataFrame, operations: list[Operation]) -> tuple[list[Change], dict[int, int]]:
        """The changes in order, and how many rows each update fits.  An insert of a key that is there is an error."""
        changes, hits = [], {}
        for kind, run in self.runs(operations):
            change, own = {"rows": self.rows, "search": self.search, "move": self.move}[kind](old, run)
            changes.append(change)
            hits |= own
            old = change.applied(old, self.key)
        return changes, hits

    # operations on single rows

    def rows(self, old: DataFrame, run: list[tuple[int, Operation]]) -> tuple[Change, dict[int, int]]:
        routed, wide = defaultdict(list), []
        for n, o in run:
            by = o.where.get(self.key) if o.kind == UPDATE else o.data.get(self.key)
            if o.kind != UPDATE and by is None:
                raise ValueError(f"{self.table}: a row needs its {self.key}")
            if o.kind != UPDATE or self.key in o.where:
                if by is not None:
                    routed[by].append((n, o))
            else:
                wide.append((n, o))
        folded = self.folded(self.met(old, routed, wide, len(run))).persist()
        hits = dict.fromkeys((n for n, o in run if o.kind == UPDATE), 0)
        taken = None
        for r in folded.select(F.explode("s.hits").alias("hit")).groupBy("hit").agg(F.count("*").alias("n")).collect():  # at most a row an operation
            if r.hit < 0:
                taken = min(taken or 0, r.hit)
            elif r.hit in hits:
                hits[r.hit] = r.n
        if taken is not None:
            folded.unpersist()
            n = min(n for n, o in run if -n - 1 == taken)
            raise ValueError(f"{self.table} has a row {dict(run)[n].data[self.key]}")
        changed = folded.filter("s.touched")
        return Change(changed.select("s.row.*"), changed.select(F.col("s.row")[self.key].alias(self.key)), [folded]), hits

    def met(self, old: DataFrame, routed: dict, wide: list, size: int) -> DataFrame:
        """key_, row (null for a new key), ops: each row that the run could touch, with the operations to show it."""
        own = {n: self.encoded(n, o) for n, o in [*wide, *(no for ops in routed.values() for no in ops)]}
        set_ = {c for ops in (wide, *routed.values()) for _, o in ops for c in o.data}
        moving = {n for n, o in wide if set_ & o.where.keys()}
        by_columns: dict[tuple, dict[tuple, list]] = defaultdict(lambda: defaultdict(list))
        for n, o in wide:
            if None not in o.where.values():  # null equals nothing
                by_columns[tuple(sorted(o.where))][tuple(o.where[c] for c in sorted(o.where))].append(n)
        types = dict(f.split() for f in S.TABLES[self.table].split(", "))
        rows, lists, touched = old.select(F.struct(*self.columns).alias("row"), *self.columns), [], []
        for k, (names, groups) in enumerate(by_columns.items()):
            found = [(*at, [own[n] for n in ns if n not in moving]) for at, ns in groups.items()]
            frame = self.spark.createDataFrame(found, ", ".join([*(f"{c} {types[c]}" for c in names), f"l{k} array<{self.op_type}>"]))
            rows = rows.join(few(frame, size), list(names), "left")
            lists.append(F.coalesce(F.col(f"l{k}"), F.array().cast(f"array<{self.op_type}>")))
            touched.append(F.col(f"l{k}").isNotNull())
        by_key = self.spark.createDataFrame([(by, [own[n] for n, _ in ops]) for by, ops in routed.items()], f"key_ string, ops array<{self.op_type}>")
        if routed:
            named = few(by_key.select(F.col("key_").alias("named_")), size)
            rows = rows.join(named, rows[self.key] == named["named_"], "left")
            touched.append(F.col("named_").isNotNull())
        one = F.concat(*lists) if lists else F.array().cast(f"array<{self.op_type}>")
        candidates = rows.filter(reduce(lambda a, b: a | b, touched, F.lit(False))).select(F.col(self.key).alias("key_"), "row", one.alias("ops"))
        both = candidates.unionByName(by_key.select("key_", F.lit(None).cast(self.row_type).alias("row"), "ops"))
        grouped = both.groupBy("key_").agg(F.first("row", ignorenulls=True).alias("row"), F.flatten(F.collect_list("ops")).alias("ops"))
        if not wide:
            return grouped
        # a new row may fit any of the others, an old one also those whose columns the batch sets
        shown = self.spark.createDataFrame([(True, [own[n] for n, _ in wide], [own[n] for n, _ in wide if n in moving])], f"all_ boolean, new_ array<{self.op_type}>, moving_ array<{self.op_type}>")
        return grouped.withColumn("all_", F.lit(True)).join(few(shown, size), "all_").select("key_", "row", F.concat("ops", F.when(F.col("row").isNull(), F.col("new_")).otherwise(F.col("moving_"))).alias("ops"))

    def folded(self, met: DataFrame) -> DataFrame:
        """s: the row after the operations, whether any touched it, and which did (below 0: an insert of a key that was there)."""
        columns = list(enumerate(self.columns))
        fits = [f"(NOT o.asked[{k}] OR coalesce(s.`row`.`{c}` = o.`where`.`{c}`, false))" for k, c in columns]
        if self.table in HAS_STATUS:
            fits += [f"(size(o.{name}) = 0 OR coalesce({test}array_contains(o.{name}, s.`row`.status), false))" for name, test in (("only", ""), ("never", "NOT "))]
        merged = ", ".join(f"'{c}', IF(o.given[{k}], o.data.`{c}`, s.`row`.`{c}`)" for k, c in columns)
        hit = f"IF(o.kind = '{INSERT}' AND s.there, -o.ord - 1, o.ord)"
        next_ = f"CASE WHEN NOT f THEN s.`row` WHEN s.there THEN named_struct({merged}) ELSE o.data END"
        step = f"named_struct('row', {next_}, 'there', s.there OR f, 'touched', s.touched OR f, 'hits', IF(f, array_append(s.hits, {hit}), s.hits))"
        start = "named_struct('row', `row`, 'there', `row` IS NOT NULL, 'touched', false, 'hits', CAST(array() AS array<int>))"
        shown = f"transform(array(o.kind <> '{UPDATE}' OR (s.there AND {' AND '.join(fits)})), f -> {step})[0]"
        return met.select(F.expr(f"aggregate(array_sort(ops), {start}, (s, o) -> {shown})").alias("s"))

    # operations that look at other rows

    def search(self, old: DataFrame, run: list[tuple[int, Operation]]) -> tuple[Change, dict[int, int]]:
        """Upserts by other columns than the key: rows with these values take the given columns; without any there is a new row."""
        names, merged, fresh = run[0][1].key_fields, {}, []
        if not names:
            raise ValueError(f"{self.table}: an upsert needs key fields")
        for _, o in run:
            at = tuple(o.data.get(c) for c in names)
            if None in at:
                fresh.append(o.data)  # null equals nothing
            else:
                merged.setdefault(at, {}).update(o.data)
        types = dict(f.split() for f in S.TABLES[self.table].split(", "))
        rows = [(*at, values(self.table, row), [c in row and c not in names for c in self.columns]) for at, row in merged.items()]
        asked = self.spark.createDataFrame(rows, ", ".join([*(f"{c} {types[c]}" for c in names), f"new_ {self.row_type}", "given_ array<boolean>"]))
        met = old.join(few(asked, len(run)), list(names)).persist()
        changed = met.select(*[F.when(F.get("given_", F.lit(k)), F.col("new_")[c]).otherwise(F.col(c)).alias(c) for k, c in enumerate(self.columns)])
        missing = asked.join(met.select(*names).distinct(), list(names), "left_anti").select("new_.*")
        added = self.spark.createDataFrame([values(self.table, r) for r in fresh], S.TABLES[self.table])
        return Change(changed.unionByName(missing).unionByName(added), met.select(self.key), [met]), {}

    def move(self, old: DataFrame, run: list[tuple[int, Operation]]) -> tuple[Change, dict[int, int]]:
        """An update that sets the key itself."""
        (n, o), types = run[0], dict(f.split() for f in S.TABLES[self.table].split(", "))
        tests = [F.coalesce(F.col(c) == F.lit(v), F.lit(False)) for c, v in o.where.items()]
        met = old.filter(every(tests)).persist()
        moved = met.select(*[F.lit(o.data[c]).cast(types[c]).alias(c) if c in o.data else F.col(c) for c in self.columns])
        return Change(moved, met.select(self.key), [met]), {n: met.count()}
