"""Every query that has SQL gives the SQL's rows, at the smallest scale; the driver compares them at the next."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = entry.oracle_sql()


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return con


def test_every_query_is_registered():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, "/root/testdata/sf0.001")
    want = duck.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    clean = lambda columns, rows: key([tuple(round(v, 5) if isinstance(v, float) else v for _, v in sorted(zip(columns, r, strict=True), key=lambda p: p[0])) for r in rows])
    assert clean(got.columns, [tuple(r) for r in got.collect()]) == clean(names, want.fetchall())
