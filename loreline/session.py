"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "loreline", master: str | None = None, **conf: str) -> SparkSession:
    """Start or reuse a session; `conf` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    merged = SETTINGS | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in merged.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on to a session made elsewhere."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table, under the shared folder of the cluster.

    The folder is `spark.checkpoint.dir`. Only a local session without that
    setting gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        root = _local_root()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str, row_group: int = 16 << 20) -> DataFrame:
    """A table written to the scratch folder and read back: made once, of known size, safe from lost executors.

    Small row groups let tasks share a file that one task wrote.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("parquet.block.size", row_group).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="loreline-")
