"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import duckdb
import pytest
from millrace.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def _plain(rows):
    return sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, con, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    found = con.execute(catalog.oracle_sql()[name])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    assert _plain([tuple(r[c] for c in columns) for r in df.collect()]) == _plain([tuple(r[i] for i in at) for r in found.fetchall()])


def test_entry(spark):
    assert catalog.flagship(spark, DATA).count() > 0
