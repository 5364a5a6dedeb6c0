"""The filter audit: against its SQL over whole tables, and against a plain version with collisions, nulls and repeats."""

import re
from itertools import permutations

import duckdb
import pytest

from cuewright.llm import filter_audit, queries

DATA = "/root/testdata/sf0.001"
DOCS, LABELS = "doc_id long, text string, lang string, mask int, n long, quality int", "doc_id long, quality int, toxic int"
LONG = " ".join(f"w{k}" for k in range(250))


def rows():
    texts = [None, "", " \t\x0b\x0c\r\n ", "a b c", LONG, LONG + " #", "x " * 300, "X " * 300, LONG + "\xa0A\x1cB C", "É" * 40, "AAA " + "é" * 96, "AAA " + "é" * 97, "|", "w " * 700_000]
    out = [(k * 3 + j, t, ["en", None, "", "de"][(k + j) % 4]) for k, t in enumerate(texts) for j in range(3)]
    return out + [(None, "a b c", "en"), (None, "a b c", "en"), (9, "a b c", "de"), (9, "a b c", "de"), (500, "only one", "fr")] + [(1000 - k, "hot text", "en") for k in range(300)]


def plain_version(docs, labels):
    smallest = {}
    for i, t, _ in docs:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    judged = []
    for i, t, part in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": re.search(r"[#$%&*|]", t) is not None, "E": i is not None and i > smallest[t],
        }
        judged.append((part or "", {f for f in fails if fails[f]}, i in good, i in toxic))
    out = {}
    for part in {p for p, *_ in judged}:
        own = [r[1:] for r in judged if r[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(own)
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                total[f] += len(gone)
                failing = sum(f in r[0] for r in own)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(r[0] == {f} for r in own), sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(total[order[step - 1]])
    return out


def told(df):
    return {tuple(r[:3]): list(r[3:]) for r in df.collect()}


LABEL_ROWS = [(0, 1, 0), (3, 0, 1), (3, 1, 0), (9, 1, 1), (None, 1, 1), (12, None, None), (500, 1, 1), (950, 1, 1), (701, 1, 1), (7777, 1, 1)]


@pytest.mark.parametrize("options", [{}, {"fingerprint": lambda data: len(data) % 3}, {"chain_bytes": 300}])
def test_as_the_plain_version(spark, options):
    docs = [(i, t, p, 1, 2, 3) for i, t, p in rows()]
    found = filter_audit.audit(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(LABEL_ROWS, LABELS), **options)
    wanted = plain_version(rows(), LABEL_ROWS)
    assert told(found) == wanted and found.count() == len(wanted) == 600 * len({p or "" for _, _, p in rows()})


def test_repeated_ids(spark):
    docs = spark.createDataFrame([(5, "a", "x"), (3, "a", "y"), (3, "a", "x"), (8, "a", "x"), (8, "a", "x"), (2, "b", "x"), (None, "a", "x")], "doc_id long, text string, lang string").repartition(4)
    assert sorted(map(tuple, filter_audit.repeated_ids(docs).collect())) == [(5, 1), (8, 2)]


def test_hot_text_moves_once_a_task(spark):
    """Of a text that all rows have, one row a chain is routed with its text."""
    pairs = list(filter_audit.routed(iter([(k, "hot", "en") for k in range(1000, 0, -1)]), 1 << 20, hash))
    assert len([1 for _, value in pairs if value[0] is not None]) == 1 and len(pairs) == 1000
    assert len({key for key, value in pairs if value[0] is None}) == 999


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filter_audit.audit(docs, labels).collect() == []
    one = spark.createDataFrame([(1, "x", "en", 1, 1, 1)], DOCS)
    assert told(filter_audit.audit(one, labels)) == plain_version([(1, "x", "en")], [])


def test_as_sql_over_the_table(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    wanted = {tuple(r[:3]): list(r[3:]) for r in con.sql(filter_audit.AUDIT_SQL).fetchall()}
    assert told(queries.op13_filter_audit(spark, DATA)) == wanted and wanted
