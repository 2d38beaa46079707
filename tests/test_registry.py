"""Every registered query of the library against its SQL on the smallest tables."""

import duckdb
import pytest

from fablework import registry

DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations "
    "clicks sales sale_lines clients client_changes vendors items stamps"
).split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    show = lambda x: "" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x)
    return sorted(columns), sorted(tuple(show(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, DIR)
    got = rows(df.columns, df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got[1]
        return
    cur = con.execute(sql)
    assert got == rows([c[0] for c in cur.description], cur.fetchall())
