"""Every registered query runs on the smallest tables and agrees with its SQL twin in DuckDB."""

import math
import os

import pytest

from tesserae.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def canon(rows):
    def one(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else round(x, 5) + 0.0
        if isinstance(x, bool) or x is None or isinstance(x, str):
            return x
        return round(float(x), 5) + 0.0

    return sorted((tuple(map(one, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    assert rows
    sql = registry.oracle_sql().get(name)
    if sql:
        picked = ", ".join(f'"{c}"' for c in columns)
        want = duck.execute(f"SELECT {picked} FROM ({sql})").fetchall()
        assert len(want) == len(rows)
        assert canon(rows) == canon(want)
