"""Feature and label sets over the given tables, for Spark and for SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Data:
    features: tuple[str, ...]
    classes: int
    spark: Callable[[SparkSession, str], DataFrame]
    sql: str  # select of features f0.. as FLOAT and label as VARCHAR

    def load(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.spark(spark, sf_dir)
        return df.select(*[F.col(f).cast("float").alias(f) for f in self.features], F.col("label").cast("string").alias("label"))


def _of(table: str, features: tuple[str, ...], label: str, classes: int) -> Data:
    sql = "SELECT " + ", ".join(f"{f}::FLOAT AS f{i}" for i, f in enumerate(features)) + f", {label}::VARCHAR AS label FROM {table}"
    return Data(features, classes, lambda s, d: s.read.parquet(f"{d}/{table}.parquet").withColumn("label", F.expr(label)), sql)


#: Numbers of a vector, all of which are features.
VECTOR = 64


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(*[F.col("embedding")[i].alias(f"d{i + 1}") for i in range(VECTOR)], "label")


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars").join(labels, "doc_id").withColumn("label", F.col("quality"))


_ITEM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_BAND = "CASE WHEN l_quantity * l_extendedprice < 500000 THEN '0' WHEN l_quantity * l_extendedprice < 1500000 THEN '1' ELSE '2' END"

DATA = {
    "lineitem": _of("lineitem", _ITEM, "l_returnflag", 3),
    "band": _of("lineitem", _ITEM, _BAND, 3),
    "part": _of("part", ("p_size", "p_retailprice"), "p_type", 6),
    "events": _of("events", ("value",), "event_type", 5),
    "orders": _of("orders", ("o_totalprice",), "o_orderstatus", 3),
    "customers": _of("orders", ("o_totalprice", "o_orderkey"), "o_custkey", 0),
    "embeddings": Data(tuple(f"d{i + 1}" for i in range(VECTOR)), 10, _vectors, "SELECT " + ", ".join(f"embedding[{i + 1}]::FLOAT AS f{i}" for i in range(VECTOR)) + ", label::VARCHAR AS label FROM embeddings"),
    "quality": Data(("n_chars",), 2, _quality, "SELECT n_chars::FLOAT AS f0, quality::VARCHAR AS label FROM documents JOIN labels USING (doc_id)"),
}
