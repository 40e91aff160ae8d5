"""Tables between the steps of an operator, written to the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir; without that setting below a temporary folder on one machine, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="menurank-steps-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/menurank-step-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df, written and read again: it is computed once, costs no executor's memory, and survives lost executors."""
    path = shared(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._menurank_step = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._menurank_step)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
