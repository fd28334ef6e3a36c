"""Folders for tables that a job writes on its way."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A fresh folder below the one that the session names in spark.checkpoint.dir, which all executors share.

    A local session that names none gets a temporary one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quillfolio-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/quillfolio-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


#: Whether Spark removes the shuffle files of a query once it has ended, not only when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """df written to a scratch folder and read again; what the write shuffled leaves the disk when it is done."""
    conf, path = df.sparkSession.conf, scratch(df.sparkSession)
    before = conf.get(_CLEANUP)
    conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)
