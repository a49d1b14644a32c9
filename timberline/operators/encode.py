"""Class dictionary and the feature-array form of a training table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Rows of a table of classes or nodes up to which it is sent to all tasks.
FEW = 65_536


def few(df: DataFrame, rows: int) -> DataFrame:
    """For a join: sent to all tasks if it has few rows. A shuffle would bring all rows of a frequent class or node into one task."""
    return F.broadcast(df) if rows <= FEW else df


def class_mapping(df: DataFrame, label: str = "label") -> DataFrame:
    """label, class_id: distinct labels numbered in byte order from 0. The classes are few; the rows never meet in one task."""
    return df.select(F.col(label).alias("label")).distinct().select("label", (F.row_number().over(Window.orderBy("label")) - 1).alias("class_id"))


def encode(df: DataFrame, labels: list[str], label: str = "label") -> DataFrame:
    """features array<float>, class_id; ``labels`` is the collected dictionary."""
    features = [c for c in df.columns if c != label]
    ids = F.create_map(*[x for i, s in enumerate(labels) for x in (F.lit(s), F.lit(i))])
    return df.select(F.array(*[F.col(f"`{c}`").cast("float") for c in features]).alias("features"), ids[F.col(label)].alias("class_id"))


def joined(df: DataFrame, mapping: DataFrame, label: str = "label") -> DataFrame:
    """features array<float>, class_id, by a join with the written dictionary, which may have any number of classes."""
    features = [c for c in df.columns if c != label]
    rows = df.select(F.array(*[F.col(f"`{c}`").cast("float") for c in features]).alias("features"), F.col(label).alias("label"))
    return rows.join(few(mapping.select("label", "class_id"), mapping.count()), "label").select("features", "class_id")


def class_counts(k: int, prefix: str = "c"):
    """Aggregates that count each class, for partial aggregation."""
    return [F.count(F.when(F.col("class_id") == i, 1)).alias(f"{prefix}{i}") for i in range(k)]


def majority(counts: list[int]) -> int:
    """The most frequent class; the smallest id of several; 0 for no rows."""
    return max(range(len(counts)), key=lambda i: (counts[i], -i), default=0)
