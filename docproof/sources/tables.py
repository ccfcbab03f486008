"""Scans of the engine's tables, and tables that cut a plan in two."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 100_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized_broadcast(df: DataFrame, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcasts df only if a count shows it to be small; otherwise leaves the choice to the planner."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written once to the folder that the cluster shares and read back: several later steps read it, and a lost executor
    costs nothing of it. Without that folder only a session in one process may go on, with a temporary one."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="docproof-")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
