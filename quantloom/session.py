"""Session defaults and the folder that executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build(master: str = "local[*]", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.master(master).appName("quantloom").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.ui.enabled", "false")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.config(map=conf).getOrCreate() if conf else b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A local one only where that is unset and all executors run in this process,
    as in tests: on a cluster a local folder would scatter a table over hosts."""
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), f"quantloom-{os.getuid()}", spark.sparkContext.applicationId)
    return f"{named.rstrip('/')}/ticks-{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: for what is read several times, and to cut lineage in
    iterative operators."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> None:
    """Deletes the tables that this application wrote into the shared folder: for when all results are written."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
