"""Training tables from Parquet: named feature columns and a label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load_table(spark: SparkSession, path: str, features: list[str], label: str | Column) -> DataFrame:
    """Features as float columns, the label as the string column ``label``."""
    label = F.col(label) if isinstance(label, str) else label
    return spark.read.parquet(path).select(*[F.col(f).cast("float").alias(f) for f in features], label.cast("string").alias("label"))
