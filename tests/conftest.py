import math
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from yearloom.session import local_session

    session = local_session(4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(DATA) if os.path.isdir(DATA) else []:
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(value):
    """A value in a form that both engines share."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, (list, tuple)):
        return str([plain(x) for x in value])
    return str(value)


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted(tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in names]).collect())


def rows_of_sql(con, sql):
    names = sorted(con.sql(sql).columns)
    listed = ", ".join(f'"{c}"' for c in names)
    return names, sorted(tuple(plain(v) for v in r) for r in con.sql(f"SELECT {listed} FROM ({sql})").fetchall())
