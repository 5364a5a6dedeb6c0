"""Every query that has SQL against DuckDB on the same tables."""

import duckdb
import pytest

from cuewright import file_queries, format_queries, queries, state_queries

DATA = "/root/testdata/sf0.001"
MODULES = (queries, format_queries, state_queries, file_queries)
OWN, SQL = {k: v for m in MODULES for k, v in m.queries().items()}, {k: v for m in MODULES for k, v in m.oracle_sql().items()}


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", OWN)
def test_query(spark, name):
    found = OWN[name](spark, DATA)
    rows = sorted((tuple(plain(r[c]) for c in sorted(found.columns)) for r in found.collect()), key=repr)
    assert rows
    if name in SQL:
        con = duckdb.connect()
        for t in ("documents", "pages", "events", "conversations", "customer", "orders"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        cursor = con.execute(SQL[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(found.columns)
        at = [names.index(c) for c in sorted(names)]
        assert rows == sorted((tuple(plain(r[k]) for k in at) for r in cursor.fetchall()), key=repr)
