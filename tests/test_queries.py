"""Every query with SQL gives what DuckDB gives."""

import duckdb
import pytest

from spoor.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr(tuple(str(r[i]) for i in order)) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    found = QUERIES[name](spark, SF)
    data = found.collect()
    assert data
    if name in ORACLES:
        c = duckdb.connect()
        for t in ("customer", "orders", "lineitem", "events", "documents", "embeddings", "conversations"):
            c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        got = c.execute(ORACLES[name])
        assert rows(found.columns, data) == rows([d[0] for d in got.description], got.fetchall())
