"""Tables that a job writes for itself in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """Write the rows under spark.checkpoint.dir and read them back: what made them runs once, the files outlive a lost executor
    and their size is known to the planner. Where the setting is absent a temporary folder serves in local mode."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("turnledger.tables", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="turnledger-")
        spark.conf.set("turnledger.tables", base)
    path = f"{base.rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
