"""State tables: batches against one operation at a time, two writers, buckets, lookups, and what the tables declare."""

import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from cuewright import schemas as S
from cuewright.plans.state import Conflict, State
from cuewright.plans.writes import Batch, Operation

ITEM = {"language": "en", "review_category": "b", "item_type": "chunk", "content": "c", "normalized_key": "c", "first_seen_at": "2024", "last_seen_at": "2024", "status": "active"}
SOURCE = {"language": "en", "material_type": "m", "track": "live_chat", "title": "t", "raw_path": "r", "imported_at": "2024", "status": "active"}


def op(table, kind, data, **more):
    return {"table": table, "op": kind, "data": data, **more}


def one_by_one(rows, operations):
    """The same operations in a SQL database, one statement each; the rows that each update affects."""
    con = sqlite3.connect(":memory:")
    columns = S.columns_of("review_items")
    types = dict(f.split() for f in S.TABLES["review_items"].split(", "))
    con.execute(f"CREATE TABLE t ({', '.join(f'{c} ' + {'string': 'TEXT', 'double': 'REAL', 'int': 'INTEGER'}[types[c]] + (' PRIMARY KEY' if c == 'id' else '') for c in columns)})")
    con.executemany(f"INSERT INTO t VALUES ({', '.join('?' * len(columns))})", [[r.get(c) for c in columns] for r in rows])
    affected = []
    for o in operations:
        data = {k: v for k, v in o["data"].items() if k in columns}
        if o["op"] == "update":
            where = o["where"]
            done = con.execute(f"UPDATE t SET {', '.join(f'{k} = ?' for k in data)} WHERE {' AND '.join(f'{k} = ?' for k in where)}", [*data.values(), *where.values()])
            affected.append(done.rowcount)
            continue
        text = f"INSERT INTO t ({', '.join(data)}) VALUES ({', '.join('?' * len(data))})"
        if o["op"] == "upsert":
            text += " ON CONFLICT(id) DO UPDATE SET " + ", ".join(f"{k} = excluded.{k}" for k in data if k != "id") if len(data) > 1 else " ON CONFLICT(id) DO NOTHING"
        con.execute(text, list(data.values()))
    return sorted(con.execute(f"SELECT {', '.join(columns)} FROM t").fetchall(), key=repr), affected


def mixed(chance, n, ids):
    """Operations whose updates ask for columns that others of them set."""
    out, fresh = [], 0
    word = lambda: chance.choice(["a", "b", "c", "d"])
    for _ in range(n):
        kind = chance.random()
        if kind < 0.15:
            fresh += 1
            out.append(op("review_items", "insert", {"id": f"n{fresh}", "language": word(), "status": word(), "unknown": 1}))
        elif kind < 0.45:
            data = {c: word() for c in chance.sample(["language", "review_category", "status", "content"], 2)}
            out.append(op("review_items", "upsert", {"id": chance.choice([*ids, f"n{chance.randint(1, 40) + 1000}"]), **data, "stability": chance.random()}, key_fields=["id"]))
        elif kind < 0.7:
            out.append(op("review_items", "update", {"status": word(), "track": word()}, where={"id": chance.choice([*ids, "none"]), **({"language": word()} if chance.random() < 0.5 else {})}))
        else:
            names = chance.sample(["language", "review_category", "status", "source_id"], 2)
            where = {c: chance.choice([*"abcd", None]) if chance.random() < 0.1 else word() for c in names}
            out.append(op("review_items", "update", chance.choice([{"status": word()}, {"content": None}, {"review_category": word(), "interval_days": 2.0}]), where=where))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_batch_as_one_by_one(spark, seed):
    chance = random.Random(seed)
    ids = [f"i{k}" for k in range(60)]
    rows = [{"id": i, "language": chance.choice("abcd"), "review_category": chance.choice("abcd"), "status": chance.choice("abcd"), "source_id": chance.choice(["a", "b", None]), "stability": 0.5} for i in ids]
    operations = mixed(chance, 300, ids)
    state = State(spark, "unpublished")
    state.changed["review_items"] = state.rows("review_items", rows)
    told = state.write(operations)
    assert len(state.changes["review_items"]) == 1  # one plan
    wanted, affected = one_by_one(rows, operations)
    assert sorted(map(tuple, state.read("review_items").collect()), key=repr) == wanted
    assert [t["rows_affected"] for t in told if t["op"] == "update"] == affected
    state.forget()


def test_five_thousand_operations(spark):
    """All over one table in one plan, as in a SQL database."""
    chance = random.Random(9)
    ids = [f"i{k}" for k in range(3000)]
    rows = [{"id": i, "language": chance.choice("abcd"), "review_category": chance.choice("abcd"), "status": "a", "source_id": f"s{k % 400}"} for k, i in enumerate(ids)]
    operations = [o for o in mixed(chance, 5500, ids) if o["op"] != "update" or "id" in o["where"]][:3800]
    operations += [op("review_items", "update", {"content": f"w{k}"}, where={"source_id": f"s{k % 450}", "track": None} if k % 50 == 0 else {"source_id": f"s{k % 450}"}) for k in range(1200)]
    chance.shuffle(operations)
    assert len(operations) == 5000
    state = State(spark, "unpublished")
    state.changed["review_items"] = state.rows("review_items", rows)
    told = state.write(operations)
    assert len(state.changes["review_items"]) == 1
    wanted, affected = one_by_one(rows, operations)
    assert sorted(map(tuple, state.read("review_items").collect()), key=repr) == wanted
    assert [t["rows_affected"] for t in told if t["op"] == "update"] == affected
    state.forget()


def test_runs_and_their_order(spark):
    """Upserts by other columns and updates of the key are plans of their own, in their place."""
    state = State(spark, "unpublished")
    state.changed["review_items"] = state.rows("review_items", [{"id": "1", "language": "en", "content": "x"}, {"id": "2", "language": "en", "content": "y"}, {"id": "3"}])
    by = {"key_fields": ["language", "content"]}
    state.write([
        op("review_items", "update", {"content": "x"}, where={"id": "2"}),
        op("review_items", "upsert", {"id": "1", "language": "en", "content": "z", "status": "s"}, **by),
        op("review_items", "upsert", {"language": "en", "content": "z", "track": "t", "id": "9"}, **by),
        op("review_items", "upsert", {"language": None, "content": "z", "id": "8"}, **by),
        op("review_items", "update", {"id": "7"}, where={"id": "3"}),
        op("review_items", "insert", {"id": "3", "status": "new"}),
        op("review_items", "update", {"track": "moved"}, where={"id": "7"}),
    ])
    found = {r.id: (r.language, r.content, r.status, r.track) for r in state.read("review_items").collect()}
    assert found == {"1": ("en", "x", None, None), "2": ("en", "x", None, None), "9": ("en", "z", "s", "t"), "8": (None, "z", None, None), "7": (None, None, None, "moved"), "3": (None, None, "new", None)}
    kinds = [kind for kind, _ in Batch(spark, "review_items").runs([Operation("insert", {"id": "a"}), Operation("update", {"track": "b"}, {"language": "c"}), Operation("upsert", {"id": "a"}, key_fields=("language",))])]
    assert kinds == ["rows", "search"]
    state.forget()


def test_a_taken_key(spark):
    state = State(spark, "unpublished")
    state.changed["review_items"] = state.rows("review_items", [{"id": "1"}])
    with pytest.raises(ValueError, match="has a row 1"):
        state.write([op("review_items", "insert", {"id": "2"}), op("review_items", "insert", {"id": "1"})])
    with pytest.raises(ValueError, match="has a row 5"):
        state.write([op("review_items", "upsert", {"id": "5"}, key_fields=["id"]), op("review_items", "insert", {"id": "5"})])
    with pytest.raises(ValueError, match="needs its id"):
        state.write([op("review_items", "insert", {"id": None})])


@pytest.fixture
def root(spark, tmp_path):
    State(spark, tmp_path).create()
    return tmp_path


def test_two_writers(spark, root):
    """Between a batch's reading and its publishing another one publishes: it is worked out anew, and no row is lost."""
    one, two, tries = State(spark, root), State(spark, root), []
    one.apply([op("review_items", "insert", {"id": "1", "status": "active"})])

    def body():
        tries.append(len(tries))
        out = one.write([op("review_items", "update", {"track": "seen"}, where={"status": "active"}), op("review_items", "insert", {"id": "3"})])
        if len(tries) == 1:
            two.apply([op("review_items", "insert", {"id": "2", "status": "active"})])
        return out

    assert one.transact(body)[0]["rows_affected"] == 2 and tries == [0, 1]
    assert {(r.id, r.track) for r in one.read("review_items").collect()} == {("1", "seen"), ("2", "seen"), ("3", None)}


def test_writers_of_other_tables(spark, root):
    """Two batches that share no table follow one another without a second try."""
    one, two, tries = State(spark, root), State(spark, root), []
    before = one.version()

    def body():
        tries.append(1)
        one.write([op("user_actions", "insert", {"id": "1"})])
        two.apply([op("schema_meta", "upsert", {"key": "k", "value": "v"}, key_fields=["key"])])

    one.transact(body)
    assert tries == [1] and one.version() == before + 2
    assert one.read("user_actions").count() == 1 and one.read("schema_meta").filter("key = 'k'").count() == 1


def test_a_writer_that_never_comes_first(spark, root, monkeypatch):
    monkeypatch.setattr("cuewright.plans.state.ATTEMPTS", 2)
    one, two = State(spark, root), State(spark, root)

    def body():
        one.write([op("user_actions", "insert", {})])
        two.apply([op("user_actions", "insert", {})])

    with pytest.raises(Conflict):
        one.transact(body)
    assert one.read("user_actions").count() == 2 and one.changes == {}
    data = root / "state" / "data"
    named = {p.split("/")[1] for k in range(1, one.version() + 1) for t in json.loads((root / "state" / "log" / f"{k:012d}.json").read_text())["tables"].values() for p in t["parts"].values()}
    assert {p.name for p in data.iterdir() if any(p.rglob("*.parquet"))} == named  # what lost is gone


def test_only_touched_buckets_are_written(spark, tmp_path):
    state = State(spark, tmp_path, buckets=32)
    state.create()
    segments = [{"id": f"g{s}-{k}", "source_id": f"s{s}", "segment_index": k, "status": "ready"} for s in range(40) for k in range(6)]
    state.transact(lambda: [state.append(t, state.rows(t, rows)) for t, rows in (("sources", [{"id": f"s{s}", **SOURCE} for s in range(40)]), ("segments", segments), ("review_items", [{**ITEM, "id": f"i{k}", "source_id": f"s{k % 40}"} for k in range(400)]))])
    before = state.current()["tables"]
    assert len(before["segments"]["parts"]) > 20
    state.act([{"action": "archive_source", "source_id": "s7"}])
    after = state.current()["tables"]
    changed = {t: [b for b in after[t]["parts"] if after[t]["parts"][b] != before[t]["parts"].get(b)] for t in after}
    assert (len(changed["sources"]), len(changed["segments"])) == (1, 1)
    holding = {r.b for r in state.read("review_items").filter("source_id = 's7'").selectExpr("cast(crc32(cast(id as binary)) % 32 as string) AS b").collect()}
    assert set(changed["review_items"]) == holding and len(holding) <= 10
    assert changed["sessions"] == changed["profile_events"] == []
    assert state.read("segments").filter("status = 'archived'").count() == 6 and state.read("segments").count() == 240
    # a lookup reads one file of many, and its filter reaches the scan
    found = state.lookup("review_items", ["i5"])
    assert len(found.inputFiles()) == 1 and [r.id for r in found.collect()] == ["i5"]
    assert len(state.lookup("segments", ["s3"], "source_id").inputFiles()) == 1 and state.lookup("segments", ["s3"], "source_id").count() == 6
    assert state.lookup("segments", ["g3-1"]).count() == 1 and len(state.read("review_items").inputFiles()) > 20


def test_old_versions_go(spark, root):
    state = State(spark, root)
    for k in range(4):
        state.apply([op("schema_meta", "upsert", {"key": "k", "value": str(k)}, key_fields=["key"])])
    assert state.vacuum(keep=1) >= 3
    assert len(list((root / "state" / "log").glob("*.json"))) == 1
    assert state.read("schema_meta").filter("key = 'k'").first().value == "3" and state.read("review_items").count() == 0
    state.apply([op("schema_meta", "upsert", {"key": "k", "value": "z"}, key_fields=["key"])])
    assert state.read("schema_meta").count() == 2


def test_earlier_layout_is_taken_over(spark, tmp_path):
    from cuewright.plans.transcripts import migrate_root

    rows = State(spark, tmp_path).rows("schema_meta", [{"key": "old", "value": "1"}])
    rows.write.parquet(str(tmp_path / "state" / "v=3" / "schema_meta"))
    (tmp_path / "state" / "CURRENT").write_text(json.dumps({"version": 3, "tables": {"schema_meta": 3}}))
    migrate_root(spark, tmp_path)
    assert {r.key for r in State(spark, tmp_path).read("schema_meta").collect()} == {"old", "schema_version"}


# what the tables declare


@pytest.fixture
def strict(spark, tmp_path):
    state = State(spark, tmp_path)
    state.create(strict=True)
    state.apply([op("sources", "insert", {"id": "s1", **SOURCE}), op("segments", "insert", {"id": "g1", "source_id": "s1", "material_type": "m", "track": "live_chat", "segment_index": 1, "segment_path": "p", "created_at": "2024", "status": "ready"}), op("review_items", "insert", {"id": "i1", **ITEM, "source_id": "s1", "segment_id": "g1"})])
    return state


FULL = {
    "schema_meta": {"key": "k", "value": "v"}, "sources": {"id": "n", **SOURCE}, "review_items": {"id": "n", **ITEM},
    "segments": {"id": "n", "source_id": "s1", "material_type": "m", "track": "t", "segment_index": 2, "segment_path": "p", "created_at": "2024", "status": "ready"},
    "sessions": {"id": "n", "language": "en", "session_type": "review", "started_at": "2024", "status": "completed"},
    "profile_events": {"id": "n", "language": "en", "event_type": "e", "signal": "s", "created_at": "2024"},
    "user_actions": {"id": "n", "target_type": "t", "target_id": "i", "action_type": "a", "created_at": "2024"},
}


def test_columns_that_have_to_be_filled(strict):
    before = strict.version()
    for table, row in FULL.items():
        assert set(row) == {S.KEYS[table], *S.FILLED[table]}
        column = S.FILLED[table][-1]
        with pytest.raises(ValueError, match=f"has no {column}"):
            strict.apply([op(table, "insert", {k: v for k, v in row.items() if k != column})])
    assert strict.version() == before
    strict.apply([op(table, "insert", row) for table, row in FULL.items()])
    with pytest.raises(ValueError, match="has no content"):
        strict.apply([op("review_items", "update", {"content": None}, where={"status": "active"})])


def test_strictness_needs_rows_that_fit(spark, root):
    state = State(spark, root)
    state.apply([op("review_items", "insert", {"id": "1"})])
    with pytest.raises(ValueError, match="has no"):
        state.create(strict=True)
    state.apply([op("review_items", "update", ITEM, where={"id": "1"})])
    state.create(strict=True)
    with pytest.raises(ValueError, match="has no"):
        state.apply([op("review_items", "insert", {"id": "2"})])


def test_keys_are_unique(spark, root):
    state = State(spark, root)
    twice = [{"id": "1"}, {"id": "1", "track": "x"}]
    with pytest.raises(ValueError, match="has more than one row"):
        state.transact(lambda: state.append("review_items", state.rows("review_items", twice)))
    state.apply([op("review_items", "insert", {"id": "1"})])
    with pytest.raises(ValueError, match="has more than one row"):
        state.transact(lambda: state.append("review_items", state.rows("review_items", [{"id": "1"}])))
    with pytest.raises(ValueError, match="has more than one row"):
        state.apply([op("review_items", "insert", {"id": "2"}), op("review_items", "update", {"id": "1"}, where={"id": "2"})])
    assert state.read("review_items").count() == 1


def test_a_named_parent_stays(strict):
    with pytest.raises(ValueError, match="which sources would lose"):
        strict.apply([op("sources", "update", {"id": "s2"}, where={"id": "s1"})])
    # with its children moved along, all in one batch
    strict.apply([op("sources", "update", {"id": "s2"}, where={"id": "s1"}), op("segments", "update", {"source_id": "s2"}, where={"source_id": "s1"}), op("review_items", "update", {"source_id": "s2"}, where={"source_id": "s1"})])
    assert strict.read("segments").first().source_id == "s2"
    with pytest.raises(ValueError, match="segment_id g1"):
        strict.transact(lambda: strict.changed.update(segments=strict.read("segments").filter(F.lit(False))))
    assert strict.read("segments").count() == 1
