"""Every registered query against its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

from turnledger.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "customer orders lineitem part supplier nation region events documents pages benchmark labels conversations".split()


def rows(frame, columns):
    return sorted("|".join(map(str, r)) for r in frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    out = registry.QUERIES[name](spark, DATA).toPandas()
    if name in registry.SQL:
        con = duckdb.connect()
        for t in TABLES:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        want = con.sql(registry.SQL[name]).df()
        assert sorted(out.columns) == sorted(want.columns)
        assert rows(out, sorted(want.columns)) == rows(want, sorted(want.columns))
