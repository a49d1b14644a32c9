"""Prediction on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame

from timberline.operators.model import Tree
from timberline.operators.predict import predict


def predict_stream(stream: DataFrame, tree: Tree) -> DataFrame:
    """The streaming DataFrame with ``prediction``; stateless, so any output mode and trigger fits."""
    return predict(stream, tree)
