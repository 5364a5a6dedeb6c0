"""The state tables as bucketed Parquet with a log of versions.

``state/log/<n>.json`` lists, for each table, the bucket folders that version n consists of.  A batch
writes new folders for the buckets that it changes, under a name of its own, and then makes the next file
of the log, which only one writer can.  A reader sees all of a batch or none of it, and no path is
overwritten.  A writer that finds the number taken looks at what the versions since its own start changed:
if no table that it read or wrote is among them, it takes the next number; if one is, nothing of it counts
and the batch is worked out again on the new version.

Rows lie in buckets by a hash of their key (segments by their source), sorted by key, so that a lookup
reads one bucket and a change rewrites the buckets that it touches.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os
import uuid
import zlib
from collections.abc import Callable
from functools import reduce
from pathlib import Path
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright import schemas as S
from cuewright.functions import scoring as X
from cuewright.operators import profile
from cuewright.plans.writes import INSERT, UPDATE, UPSERT, Batch, Change, Operation, typed, values
from cuewright.sources.store import Store, is_uri, joined, mounted, reached

T = TypeVar("T")
ATTEMPTS = 20


class Conflict(Exception):
    """Another writer changed what a batch had read."""


def now_iso(now: dt.datetime | None = None) -> str:
    return (now or dt.datetime.now(dt.timezone.utc)).astimezone(dt.timezone.utc).isoformat().replace("+00:00", "Z")


def fresh_id(*parts: object) -> str:
    """A uuid, or for given parts an id that follows from them."""
    return hashlib.sha256("\x1f".join(map(str, parts)).encode()).hexdigest()[:32] if parts else str(uuid.uuid4())


def bucket(column: Column, buckets: int) -> Column:
    return (F.crc32(F.coalesce(column, F.lit("")).cast("binary")) % buckets).cast("int")


class State:
    """``changed`` holds tables that a batch replaces as a whole, ``changes`` those that it changes row by row."""

    def __init__(self, spark: SparkSession, root: str | Path, buckets: int = 8):
        self.spark, self.root, self.buckets = spark, joined(mounted(root), "state"), buckets
        self.changed: dict[str, DataFrame] = {}
        self.changes: dict[str, list[Change]] = {}
        self.base: dict | None = None
        self.inside = False
        self.empty: set[str] = set()  # tables without rows that a batch makes
        self.seen: set[str] = set()
        self.strict: bool | None = None

    # versions

    def log_name(self, n: int) -> str:
        return joined(self.root, "log", f"{n:012d}.json")

    def current(self) -> dict | None:
        """The last version: its number, tables and whether columns that have to be filled are checked; None before the first."""
        numbers = [int(name[:12]) for name, _ in Store(self.spark).names(joined(self.root, "log")) if name.endswith(".json") and name[:12].isdigit()]
        return json.loads(Store(self.spark).read(self.log_name(max(numbers)))) if numbers else None

    def version(self) -> int:
        known = self.current()
        if known is None:
            raise FileNotFoundError(f"no state in {self.root}")
        return known["version"]

    def begin(self) -> dict:
        """The last version; inside a batch, the one that was the last at its first look."""
        base = self.base or self.current() or {"version": 0, "tables": {}, "strict": False}
        if self.inside or self.changed or self.changes:
            self.base = base
        return base

    def forget(self) -> None:
        """Drop what is not published."""
        for change in (c for own in self.changes.values() for c in own):
            for frame in change.held:
                frame.unpersist()
        self.changed, self.changes, self.base, self.inside, self.empty, self.seen, self.strict = {}, {}, None, False, set(), set(), None

    def create(self, strict: bool = False) -> None:
        """Empty tables where there are none, as a new version; tables that exist keep their rows.

        ``strict`` declares from now on that columns have to be filled (schemas.FILLED); rows that are there have to fit.
        """
        Store(self.spark).make(joined(self.root, "log"))

        def body() -> None:
            known, before = self.begin()["tables"], self.unlogged()
            for table, schema in S.TABLES.items():
                if table not in known:
                    self.changed[table] = self.spark.read.schema(schema).parquet(reached(before[table])) if table in before else self.spark.createDataFrame([], schema)
                    if table not in before:
                        self.empty.add(table)
            self.strict = strict or self.begin().get("strict", False)
            self.upsert("schema_meta", [{"key": "schema_version", "value": str(S.SCHEMA_VERSION)}])

        self.transact(body)

    def unlogged(self) -> dict[str, str]:
        """Tables in the folders of an earlier release, which had the file CURRENT and no log."""
        mark = joined(self.root, "CURRENT")
        store = Store(self.spark)
        return {t: joined(self.root, f"v={n}", t) for t, n in json.loads(store.read(mark))["tables"].items()} if store.exists(mark) else {}

    # reading

    def read(self, table: str) -> DataFrame:
        """The table with what this batch has changed so far."""
        if table not in S.TABLES:
            raise ValueError(f"unknown table {table}")
        rows = self.changed[table] if table in self.changed else self.published(table)
        if rows is None:
            raise FileNotFoundError(f"no table {table} in {self.root}")
        types = dict(f.split() for f in S.TABLES[table].split(", "))
        whole = rows.columns == list(types)
        return self.applied(table, rows if whole else rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in types.items()]))

    def applied(self, table: str, rows: DataFrame) -> DataFrame:
        for change in self.changes.get(table, ()):
            rows = change.applied(rows, S.KEYS[table])
        return rows

    def published(self, table: str, buckets: list[int] | None = None) -> DataFrame | None:
        """The table, or some of its buckets, as of the version that this batch reads; None where it has not been written."""
        known = self.begin()["tables"].get(table)
        self.seen.add(table)
        if known is None:
            return None
        return self.parts({"parts": {b: part for b, part in known["parts"].items() if buckets is None or int(b) in buckets}}, table)

    def lookup(self, table: str, values_: list[str], column: str | None = None) -> DataFrame:
        """The published rows with these keys (or these values of the column that the table is bucketed by), from their buckets alone."""
        by = S.BUCKET_BY.get(table, S.KEYS[table])
        column = column or S.KEYS[table]
        known = self.begin()["tables"].get(table)
        if known is None:
            raise FileNotFoundError(f"no table {table} in {self.root}")
        own = [zlib.crc32(v.encode()) % known["buckets"] for v in values_] if column == by else None
        return self.published(table, own).filter(F.col(column).isin(values_))

    # publishing

    def transact(self, body: Callable[[], T]) -> T:
        """Work out ``body`` and publish what it changed; anew where another writer was first."""
        for attempt in range(ATTEMPTS):
            try:
                self.inside = True
                out = body()
                self.publish()
                return out
            except Conflict:
                if attempt == ATTEMPTS - 1:
                    raise
            finally:
                self.forget()
        raise AssertionError

    def touched(self) -> list[str]:
        return [t for t in S.TABLES if t in self.changed or t in self.changes]

    def publish(self) -> None:
        """Write the buckets that changed, check them, and make them the next version."""
        base, tables = self.begin(), self.touched()
        if not tables:
            return self.forget()
        written, key = {}, S.KEYS
        strict = base.get("strict", False) if self.strict is None else self.strict
        token = joined("data", uuid.uuid4().hex)
        for table in tables:
            known, by = base["tables"].get(table), S.BUCKET_BY.get(table, key[table])
            whole = known is None or table in self.changed
            n = self.buckets if whole else known["buckets"]
            if table in self.empty and table not in self.changes:
                written[table] = {"buckets": n, "parts": {}}
                continue
            own = None if whole else self.changed_buckets(table, by, n)
            rows = self.read(table) if whole else self.applied(table, self.published(table, own))
            path = joined(token, table)
            placed = rows.select(*S.columns_of(table)).withColumn("bucket", bucket(F.col(by), n))
            placed.repartition(n if own is None else max(len(own), 1), "bucket").sortWithinPartitions("bucket", key[table]).write.partitionBy("bucket").parquet(reached(joined(self.root, path)))
            kept = {} if whole else {b: p for b, p in known["parts"].items() if int(b) not in own}
            new = {name.removeprefix("bucket="): joined(path, name) for name, _ in Store(self.spark).names(joined(self.root, path)) if name.startswith("bucket=")}
            written[table] = {"buckets": n, "parts": kept | new}
        try:
            self.check(written, strict, strict and not base.get("strict", False))
            self.commit(written, strict)
        except BaseException:
            Store(self.spark).remove(joined(self.root, token))  # nothing names it
            raise
        self.forget()

    def changed_buckets(self, table: str, by: str, n: int) -> list[int]:
        """The buckets that hold a changed row, or held one."""
        key, old = S.KEYS[table], self.published(table)
        placed = lambda rows: rows.select(bucket(F.col(by), n).alias("b"))
        found = []
        for change in self.changes[table]:
            found.append(placed(change.rows))
            if change.removed is not None:
                found.append(placed(change.removed if by == key else old.select(key, by).join(change.removed, key, "left_semi")))
        return [r.b for r in reduce(DataFrame.unionByName, found).distinct().collect()]  # at most the number of buckets

    def check(self, written: dict, strict: bool, from_now_on: bool) -> None:
        """One row that breaks what the tables declare is an error: two rows of one key, a column that has to be filled, a
        name of a row that is not there, or a row removed that others name.  One plan finds it for the whole batch."""
        found = []
        told = lambda rows, table, what: rows.select(F.lit(table).alias("table"), F.col(S.KEYS[table]).alias("id"), what.cast("string").alias("what"))
        after = {t: self.parts(w, t) for t, w in written.items()}
        known = self.begin()["tables"]
        for table, own in (known | written if from_now_on else written).items():
            old = {} if from_now_on else known.get(table, {"parts": {}})["parts"]
            parts = {b: p for b, p in own["parts"].items() if old.get(b) != p}
            if not parts:
                continue
            fresh, key = self.parts({"parts": parts}, table), S.KEYS[table]
            twice = fresh.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
            found.append(told(twice, table, F.lit("has more than one row")))
            for column in [key, *(S.FILLED[table] if strict else [])]:
                found.append(told(fresh.filter(F.col(column).isNull()), table, F.lit(f"has no {column}")))
        for table, references in S.REFERENCES.items():
            for column, parent in references.items():
                if table in written and written[table]["parts"]:
                    named = self.new_rows(table).select(S.KEYS[table], column).filter(F.col(column).isNotNull())
                    there = after[parent] if parent in written else self.published(parent)
                    ids = self.spark.createDataFrame([], f"{column} string") if there is None else there.select(F.col("id").alias(column))
                    lost = named.join(ids, column, "left_anti")
                    found.append(told(lost, table, F.concat(F.lit(f"{parent} has no row "), F.col(column))))
                gone = self.gone(parent, after.get(parent))
                if gone is not None:
                    rows = after[table] if table in written else self.published(table)
                    if rows is not None:
                        left = rows.join(gone.select(F.col("id").alias(column)), column, "left_semi")
                        found.append(told(left, table, F.concat(F.lit(f"names {column} "), F.col(column), F.lit(f", which {parent} would lose"))))
        bad = reduce(DataFrame.unionByName, found).first() if found else None
        if bad is not None:
            raise ValueError(f"{bad['table']} row {bad['id']}: {bad['what']}")

    def parts(self, entry: dict, table: str) -> DataFrame:
        """A table's folders, as a version lists them."""
        paths = [reached(joined(self.root, p)) for p in entry["parts"].values()]
        return self.spark.read.schema(S.TABLES[table]).parquet(*paths) if paths else self.spark.createDataFrame([], S.TABLES[table])

    def new_rows(self, table: str) -> DataFrame:
        """The rows that this batch changed, whose names have to exist; of a table replaced as a whole, those that were not there."""
        if table in self.changed:
            old, rows = self.published(table), self.read(table)
            columns = [S.KEYS[table], *S.REFERENCES[table]]
            return rows if old is None else rows.select(*columns).exceptAll(old.select(*columns))
        first, *later = self.changes[table]
        rows = first.rows
        for change in later:
            rows = change.applied(rows, S.KEYS[table])
        return rows

    def gone(self, parent: str, after: DataFrame | None) -> DataFrame | None:
        """Ids that a parent table loses by this batch."""
        if after is None:
            return None
        if parent in self.changed:
            old = self.published(parent)
            return None if old is None else old.select("id").join(after.select("id"), "id", "left_anti")
        removed = [change.removed.select("id") for change in self.changes[parent] if change.removed is not None]
        return reduce(DataFrame.unionByName, removed).join(after.select("id"), "id", "left_anti") if removed else None

    def commit(self, written: dict, strict: bool) -> None:
        known, store = self.begin(), Store(self.spark)
        store.make(joined(self.root, "log"))
        while True:
            n = known["version"] + 1
            if store.create(self.log_name(n), json.dumps({"version": n, "tables": known["tables"] | written, "strict": strict})):
                return
            latest = self.current()
            theirs = {t for t, entry in latest["tables"].items() if entry != self.base["tables"].get(t)}
            if theirs & (self.seen | written.keys()) or latest["strict"] != self.base.get("strict", False):
                raise Conflict(f"tables {sorted(theirs)} were changed by another writer")
            known = latest

    def vacuum(self, keep: int = 10) -> int:
        """Remove log files but the last ``keep``, and folders that none of these names; readers and writers of older versions have to be done.  The folders removed."""
        store, last = Store(self.spark), self.version()
        kept = [json.loads(store.read(self.log_name(n))) for n in range(max(1, last - keep + 1), last + 1) if store.exists(self.log_name(n))]
        named = {p.split("/")[1] for version in kept for entry in version["tables"].values() for p in entry["parts"].values()}
        for n, _ in store.names(joined(self.root, "log")):
            if n.endswith(".json") and int(n[:12]) <= last - keep:
                store.remove(joined(self.root, "log", n))
        lost = [name for name, _ in store.names(joined(self.root, "data")) if name not in named]
        for name in lost:
            store.remove(joined(self.root, "data", name))
        return len(lost)

    # changes

    def rows(self, table: str, rows: list[dict]) -> DataFrame:
        return self.spark.createDataFrame([values(table, typed(table, r)) for r in rows], S.TABLES[table])

    def change_rows(self, table: str, change: Change) -> None:
        self.changes.setdefault(table, []).append(change)

    def append(self, table: str, new: DataFrame) -> None:
        """Rows with new keys."""
        self.change_rows(table, Change(new.select(*S.columns_of(table)), None))

    def merge(self, table: str, new: DataFrame) -> None:
        """Whole rows by key, as one join: those of ``new`` replace the old ones."""
        self.change_rows(table, Change(new.select(*S.columns_of(table)), new.select(S.KEYS[table])))

    def operate(self, table: str, operations: list[Operation]) -> dict[int, int]:
        """Operations in order, as one plan (see ``writes``); how many rows each update fits."""
        changes, hits = Batch(self.spark, table).apply(self.read(table), operations)
        for change in changes:
            self.change_rows(table, change)
        return hits

    def upsert(self, table: str, rows: list[dict], keys: list[str] | None = None) -> None:
        """Rows by key: the columns that a row gives replace the old values, the others stay.  Of rows with one key the last counts."""
        self.operate(table, [self.operation(table, UPSERT, row, keys=keys)[0] for row in rows])

    def operation(self, table: str, op: str, data: dict, where: dict | None = None, keys: list[str] | None = None) -> tuple[Operation, str | None]:
        """An operation, and the id of the row that it names or makes."""
        if table not in S.TABLES:
            raise ValueError(f"unknown table {table}")
        key, columns = S.KEYS[table], S.columns_of(table)
        if op == UPDATE:
            data, where = ({k: v for k, v in d.items() if k in columns} for d in (data, where))
            if not data or not where:
                raise ValueError("update needs columns to set and columns to match")
            return Operation(UPDATE, typed(table, data), typed(table, where)), None
        if op not in (INSERT, UPSERT):
            raise ValueError(f"unknown operation {op}")
        own = (key,) if op == INSERT or keys is None else tuple(keys)
        if key == "id" and "id" not in data and (op == INSERT or "id" not in own or keys is None):
            data = {**data, "id": fresh_id()}
        return Operation(op, typed(table, data), key_fields=own), data.get("id")

    def apply(self, operations: list[dict]) -> list[dict]:
        """Generic writes {table, op, data, key_fields, where} in order, published together."""
        return self.transact(lambda: self.write(operations))

    def write(self, operations: list[dict]) -> list[dict]:
        """Generic writes, not yet published.  Tables do not depend on one another, so each has one plan for all of its operations."""
        out, of_table = [], {}
        for o in operations:
            table, op = o["table"], o["op"]
            made, id_ = self.operation(table, op, o["data"], o.get("where") if op != UPDATE else o["where"], o["key_fields"] if op == UPSERT else None)
            of_table.setdefault(table, []).append((len(out), made))
            out.append({"table": table, "op": op, "id": id_})
        for table, own in of_table.items():
            hits = self.operate(table, [made for _, made in own])
            for n, (place, made) in enumerate(own):
                if made.kind == UPDATE:
                    out[place] = {"table": table, "op": UPDATE, "rows_affected": hits[n]}
        return out

    # user actions

    def act(self, operations: list[dict], now: dt.datetime | None = None) -> list[dict]:
        """Status changes with their audit rows, published together."""
        return self.transact(lambda: self.change(operations, now))

    def change(self, operations: list[dict], now: dt.datetime | None = None) -> list[dict]:
        """Status changes with their audit rows, not yet published; one plan for each table."""
        out, audits, of_table = [], [], {}

        def update(place: int, name: str, table: str, made: list[Operation]) -> None:
            of_table.setdefault(table, []).extend((place, name, o) for o in made)
            out[place].setdefault(name, 0)

        def audit(kind: str, targets: list[str], action: str, o: dict) -> list[str]:
            rows = [{"id": fresh_id(), "target_type": kind, "target_id": t, "action_type": action, "reason": o.get("reason"), "created_at": o.get("created_at") or now_iso(now)} for t in targets]
            audits.extend(rows)
            return [r["id"] for r in rows]

        for place, o in enumerate(operations):
            action = o["action"]
            out.append({"action": action})
            if action in ("set_item_status", "mark_item_not_useful"):
                status, ids = ("ignored" if action == "mark_item_not_useful" else o["status"]), o.get("item_ids") or ([o["item_id"]] if o.get("item_id") else [])
                if status not in S.ITEM_STATUSES or not ids:
                    raise ValueError("a known status and at least one item id are needed")
                update(place, "rows_affected", "review_items", [Operation(UPDATE, {"status": status}, {"id": i}) for i in dict.fromkeys(ids)])
                out[place]["user_action_ids"] = audit("review_item", ids, f"set_status:{status}", o)
            elif action == "set_category_status":
                language, category, status = o["language"], o["review_category"], o["status"]
                if status not in S.CATEGORY_STATUSES:
                    raise ValueError(f"unknown status {status}")
                update(place, "rows_affected", "review_items", [Operation(UPDATE, {"status": status}, {"language": language, "review_category": category}, never=("deleted",))])
                out[place]["user_action_ids"] = audit("review_category", [f"{language}:{category}"], f"set_status:{status}", o)
            elif action == "archive_source":
                own = o["source_id"]
                update(place, "source_rows_affected", "sources", [Operation(UPDATE, {"status": "archived"}, {"id": own})])
                update(place, "segment_rows_affected", "segments", [Operation(UPDATE, {"status": "archived"}, {"source_id": own}, never=("deleted",))])
                update(place, "review_rows_affected", "review_items", [Operation(UPDATE, {"status": "ignored"}, {"source_id": own}, only=("active", "paused"))])
                out[place]["user_action_ids"] = audit("source", [own], "archive", o)
            else:
                raise ValueError(f"unknown action {action}")
        for table, own in of_table.items():
            for n, hit in self.operate(table, [o for *_, o in own]).items():
                place, name, _ = own[n]
                out[place][name] += hit
        self.append("user_actions", self.rows("user_actions", audits))
        return out

    # review pass

    def record(self, sessions: DataFrame, reviews: DataFrame, events: DataFrame) -> None:
        """Sessions, reviews of items (id, ord, result, reviewed_at) and profile events, not yet published; an unknown item is an error."""
        items = self.read("review_items")
        unknown = [r.id for r in reviews.select("id").distinct().join(items, "id", "left_anti").limit(10).collect()]
        if unknown:
            raise KeyError(f"no review items {unknown}")
        self.merge("sessions", sessions)
        self.merge("review_items", profile.review_fold(items, reviews))
        self.merge("profile_events", events)

    def review(self, payload: dict, now: dt.datetime | None = None) -> dict:
        """A session, its reviewed items and its profile events, published together."""
        at = now_iso(now)
        session = dict(payload.get("session") or {})
        given = {k: v for k, v in session.items() if v is not None}
        session = {"id": fresh_id(), "language": payload.get("language"), "session_type": "review", "started_at": at, "finished_at": at, "status": "completed", **given}
        if not session["language"]:
            raise ValueError("a language is needed")
        reviewed = payload.get("reviewed_items") or []
        bad = [r["result"] for r in reviewed if r["result"] not in (*X.RESULTS, X.MASTERED)]
        if bad:
            raise ValueError(f"unknown results {bad}")
        events = [{"id": fresh_id(), "session_id": session["id"], "created_at": at, **{k: v for k, v in e.items() if v is not None}} for e in payload.get("profile_events") or []]
        rows = [(r["id"], k, r["result"], r.get("reviewed_at") or session["finished_at"]) for k, r in enumerate(reviewed)]
        reviews = self.spark.createDataFrame(rows, "id string, ord int, result string, at string").select("id", "ord", "result", X.parse_time(F.col("at")).alias("reviewed_at"))
        self.transact(lambda: self.record(self.rows("sessions", [session]), reviews, self.rows("profile_events", list({e["id"]: e for e in events}.values()))))
        outcomes: dict[str, int] = {}
        for r in reviewed:
            outcomes[r["result"]] = outcomes.get(r["result"], 0) + 1
        return {"session_id": session["id"], "reviewed_count": len(reviewed), "outcomes": outcomes, "profile_events": len(events)}


def write_json(path: str | Path, value: object, spark: SparkSession | None = None) -> None:
    """Write beside the target, check, keep the old file as .bak, and put the new one in its place; a URI needs ``spark``."""
    text = json.dumps(value, ensure_ascii=False, indent=2) + "\n"
    if is_uri(path):
        store = Store(spark)
        if store.exists(path):
            store.copy(path, f"{path}.bak")
        store.write(path, text)
        json.loads(store.read(path))
        return
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_suffix(path.suffix + ".tmp")
    part.write_text(text, encoding="utf-8")
    json.loads(part.read_text(encoding="utf-8"))
    if path.exists():
        path.with_suffix(path.suffix + ".bak").write_bytes(path.read_bytes())
    os.replace(part, path)
    json.loads(path.read_text(encoding="utf-8"))


def read_json(path: str | Path, spark: SparkSession | None = None) -> object:
    return json.loads(Store(spark).read(path) if is_uri(path) else Path(path).read_text(encoding="utf-8-sig"))
