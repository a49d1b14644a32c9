"""Tables that outlive the executors which made them."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEPT: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Only a local session may leave it unset, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder that driver and executors share.")
    return os.path.join(tempfile.gettempdir(), "timberline")


def new_place(spark: SparkSession, kind: str) -> str:
    """A path for a new table, which ``release`` removes."""
    path = f"{shared_dir(spark)}/timberline-{kind}{uuid.uuid4().hex}"
    _KEPT.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def keep(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: later jobs neither recompute nor depend on executors."""
    spark = df.sparkSession
    path = new_place(spark, "")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, since: int = 0, last: int = 0) -> None:
    """Remove the tables that this application kept, from the ``since``-th on but for the ``last`` ones. Call it when nothing reads them any more."""
    paths = _KEPT.get(spark.sparkContext.applicationId, [])
    gone = paths[since : len(paths) - last]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in gone:
        where = hadoop(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    del paths[since : since + len(gone)]


def kept(spark: SparkSession) -> int:
    """How many tables this application keeps."""
    return len(_KEPT.get(spark.sparkContext.applicationId, []))
