"""Tables that cut lineage: written to the folder all executors share, read back as plain scans."""

from __future__ import annotations

import logging
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


log = logging.getLogger("nearfold")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    A machine-local folder is set only where the setting is absent and the master is local, as in tests.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="nearfold-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, in a folder of this application."""
    return f"{shared_dir(spark)}/nearfold/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def clear(spark: SparkSession) -> None:
    """Deletes all that this application wrote to its folder. DataFrames that read it can't be used any more."""
    discard(spark, f"{shared_dir(spark)}/nearfold/{spark.sparkContext.applicationId}")


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder. Lost executors don't lose it, and reading it recomputes nothing."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    log.info("writing %s to %s", name, path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
