"""Tables written in the folder that all machines share, to cut lineage: a lost executor doesn't lose them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where none is named, a temporary one if all of Spark is on this machine; else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='inkfold-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/inkfold-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession) -> str:
    """Where a table of this application can be written."""
    return f"{_folder(spark)}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """Write a table and read it back. instead_of: a table from here that this one replaces, removed once this one is written."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    if old := getattr(instead_of, "_table", None):
        _remove(spark, old)
    found = spark.read.schema(df.schema).parquet(path)
    found._table = path
    return found


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Remove all tables that this application has written, when the results that were made of them are no longer needed."""
    _remove(spark, _folder(spark))
