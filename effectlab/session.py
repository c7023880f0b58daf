"""Session helpers: a local session for tests, and the shared work folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: str = "8", app: str = "effectlab") -> SparkSession:
    """A session for tests and benches; on a cluster use the session you are given."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("EFFECTLAB_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", os.environ.get("EFFECTLAB_WORK", "") or tempfile.mkdtemp(prefix="effectlab-"))
        # Call sites of every column expression are for debugging and slow plan building.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder for checkpoints and intermediate tables.

    The cluster names its shared folder in ``spark.checkpoint.dir``. Without that setting
    a session on one machine gets a temporary folder, and any other is refused: its
    executors wouldn't see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="effectlab-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df, purpose: str):
    """Write ``df`` to the shared work folder and read it back: a cut in lineage that
    survives lost executors and is computed once however often it is read."""
    spark = df.sparkSession
    path = work_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
