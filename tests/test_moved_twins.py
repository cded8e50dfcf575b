"""Moved slots of several users become keys of one team, where a claim that another key already holds opens no slot: query and SQL say so alike."""

import random
from datetime import datetime, timedelta

import duckdb
import pytest

from turnledger.plans import registry


@pytest.mark.parametrize("name", ["d4_moved", "a18_preview"])
def test_twins_under_other_keys(spark, tmp_path, name):
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(seconds=i), rng.choice([1, 71, 141, 211, 2]), rng.choice(["error", "view"]), rng.choice([0.01, 0.12, 0.34, 1.23, 1.29]), '{"k": %d}' % rng.choice([10, 40, 70])) for i in range(60)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    out = registry.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(out.columns)} FROM ({registry.SQL[name]})").fetchall()
    assert sorted(map(tuple, out.collect())) == sorted(want)
