"""Sessions, and the shared folder that cuts lineage."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("marlstone")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("MARLSTONE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only where it is unset and there is one machine, a local one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        at = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    from py4j.protocol import Py4JError

    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except (Py4JError, AttributeError, OSError):  # the session is gone; the folder is the cluster's scratch space
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is used once; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df to the shared folder and read it back: the rows survive the loss of executors and
    no later stage recomputes them. The files go when the driver ends."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class rounds:
    """A table that grows by one part a round, each written to the shared folder; all() is one scan of all parts."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n, self.schema = spark, new_path(spark, name), 0, None

    def add(self, df: DataFrame) -> DataFrame:
        at = f"{self.path}/round={self.n}"
        df.write.parquet(at)
        self.n, self.schema = self.n + 1, df.schema
        return self.spark.read.schema(df.schema).parquet(at)

    def all(self) -> DataFrame:
        """All rows so far, with the round that brought them."""
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        return self.spark.read.schema(f"{kinds}, round int").parquet(self.path)
