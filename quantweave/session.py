"""Session defaults."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "quantweave", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``. Where it is
    unset, a local session uses its warehouse; on a cluster that is an error,
    because executors don't share local folders."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.split("[")[0] == "local":
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/staged"
    raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under the shared root, dropped when the session's JVM ends."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back: readers agree on its rows, and a lost executor costs no upstream work."""
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
