"""Every query that has SQL gives what DuckDB gives."""

import duckdb
import pytest

from sparquill.plans import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(columns, found):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(round(r[k], 6) if isinstance(r[k], float) else r[k] for k in at) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    got, want = QUERIES[name](spark, sf_dir), duck.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
