"""Every registered query of the library against its SQL twin."""

from __future__ import annotations

import duckdb
import pytest

from depchron.plans import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tiny}/{t}.parquet')")
    return con


def test_all_have_twins():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(name, spark, tiny, duck):
    df = QUERIES[name](spark, tiny)
    names = sorted(df.columns)
    found = duck.execute(SQL[name])
    order = [d[0] for d in found.description]
    assert sorted(order) == names
    want = sorted(tuple(str(r[order.index(n)]) for n in names) for r in found.fetchall())
    assert sorted(tuple(map(str, r)) for r in df.select(*names).collect()) == want


def test_filtered_log_is_not_narrowed():
    assert "author_name ILIKE" not in SQL["vuln_log_filtered"] and "ecosystem = 'npm'" not in SQL["vuln_log_filtered"]
