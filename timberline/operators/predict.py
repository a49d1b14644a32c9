"""Prediction as a column: batch or stream, no shuffle and no join; and by joins, for trees of any size that are tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.operators.grow import Model, node_id
from timberline.operators.model import Tree
from timberline.tables import keep

#: Leaves of a tree up to which one expression says where a row goes.
EXPRESSION_LEAVES = 200


def leaf_expression(tree: Tree) -> Column:
    """The id of the leaf that a row with the tree's feature columns reaches."""
    made: dict[int, Column] = {}
    for node in reversed(tree.preorder()):
        if node.is_leaf:
            made[node.node_id] = F.lit(node.node_id).cast("long")
        else:
            value = F.col(f"`{node.feature_name}`").cast("float")
            # NaN is above every threshold; a null is, too.
            made[node.node_id] = F.when(value <= F.lit(node.threshold), made[node.left_id]).otherwise(made[node.right_id])
    return made[tree.root().node_id]


def _large(tree: Tree) -> bool:
    return sum(n.is_leaf for n in tree.nodes.values()) > EXPRESSION_LEAVES


def _walked(tree: Tree, kind: str, of) -> Column:
    """``of(node)`` of the leaf that each row reaches; all rows of a batch go down a level at a time."""
    nodes = tree.preorder()
    at = {n.node_id: i for i, n in enumerate(nodes)}
    feature = np.array([-1 if n.is_leaf else n.feature_index for n in nodes])
    threshold = np.array([0.0 if n.is_leaf else n.threshold for n in nodes])
    below = np.array([[i, i] if n.is_leaf else [at[n.left_id], at[n.right_id]] for i, n in enumerate(nodes)])
    result = np.array([of(n) if n.is_leaf else None for n in nodes], dtype=object)

    @F.pandas_udf(kind)
    def walk(rows: pd.Series) -> pd.Series:
        values = np.array([[np.nan if v is None else v for v in r] for r in rows], dtype=np.float32).reshape(len(rows), -1)
        place, going = np.zeros(len(rows), dtype=np.int64), np.arange(len(rows))
        while len(going := going[feature[place[going]] >= 0]):
            here = place[going]
            # NaN is above every threshold; a null is, too.
            place[going] = below[here, np.where(values[going, feature[here]] <= threshold[here], 0, 1)]
        return pd.Series(result[place])

    return walk(F.array(*[F.col(f"`{c}`").cast("float") for c in tree.features]))


def route(df: DataFrame, tree: Tree) -> DataFrame:
    """df with ``leaf_id``: one expression, or for a large tree its nodes as arrays in each task, which the driver holds anyway."""
    leaf = _walked(tree, "long", lambda n: n.node_id) if _large(tree) else leaf_expression(tree)
    return df.withColumn("leaf_id", leaf)


def predict(df: DataFrame, tree: Tree) -> DataFrame:
    """df with ``prediction``."""
    if _large(tree):
        return df.withColumn("prediction", _walked(tree, "string", lambda n: n.leaf_label))
    labels = [x for n in tree.preorder() if n.is_leaf for x in (F.lit(n.node_id).cast("long"), F.lit(n.leaf_label))]
    return df.withColumn("prediction", F.create_map(*labels)[leaf_expression(tree)])


#: Levels of a page, whose nodes a row walks down after one join.
PAGE = 6


def pages(model: Model) -> DataFrame:
    """page, feature, threshold, class_of: the nodes of PAGE levels below a node, by their place: the children of place i are at 2i and 2i + 1.

    A feature is null where there is a leaf or nothing; a leaf has its most frequent class, the first of several.
    """
    top = F.floor(F.col("depth") / PAGE) * PAGE
    below = F.translate(F.expr("substring(path, top + 1)"), "LR", "01")
    place = F.conv(F.concat(F.lit("1"), below), 2, 10).cast("int")
    own = F.array_min(F.zip_with("n", "class_id", lambda n, c: F.struct((-n).alias("n"), c.alias("c"))))["c"]
    nodes = model.nodes.withColumn("top", top.cast("int")).select(F.expr("left(path, top)").alias("at"), place.alias("place"), "feature_index", "threshold", F.when(F.col("feature_index").isNull(), F.coalesce(own, F.lit(0))).alias("own"))
    got = nodes.groupBy("at").agg(F.map_from_entries(F.collect_list(F.struct("place", F.struct("feature_index", "threshold", "own")))).alias("m"))  # at most 63 nodes
    return got.select(node_id(F.col("at")).alias("page"), _at_places("feature_index").alias("feature"), _at_places("threshold").alias("threshold"), _at_places("own").alias("class_of"))


def _at_places(field: str) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit((1 << PAGE) - 1)), lambda i: F.col("m")[i][field])


def route_table(df: DataFrame, model: Model) -> DataFrame:
    """df with ``leaf_path`` and ``leaf_class``: rows join the page of their node and walk down its levels, page after page.

    No task holds more of the tree than pages of 63 nodes. A page that many rows ask
    for is split by the skew join.
    """
    book = keep(pages(model))
    deepest = model.nodes.agg(F.max("depth")).first()[0]
    values = F.array(*[F.col(f"`{c}`").cast("float") for c in model.features])
    rows = df.withColumns({"leaf_path": F.lit(""), "leaf_class": F.lit(None).cast("int"), "__page": node_id(F.lit("")), "__values": values})
    for _ in range(deepest // PAGE + 1):
        def step(at: Column, _: Column) -> Column:
            feature = F.get("feature", at - 1)
            # NaN is above every threshold; a null is, too.
            goes_left = F.coalesce(F.get("__values", feature) <= F.get("threshold", at - 1), F.lit(False))
            return F.when(F.col("__page").isNull() | feature.isNull(), at).otherwise(2 * at + F.when(goes_left, 0).otherwise(1))

        rows = rows.join(book, F.col("__page") == F.col("page"), "left").withColumn("__at", F.aggregate(F.sequence(F.lit(1), F.lit(PAGE)), F.lit(1), step))
        here = F.concat("leaf_path", F.translate(F.expr("substring(bin(__at), 2)"), "01", "LR"))
        on = F.col("__at") >= 1 << PAGE
        rows = rows.withColumns({"leaf_class": F.coalesce("leaf_class", F.get("class_of", F.col("__at") - 1)), "leaf_path": F.when(F.col("page").isNull(), F.col("leaf_path")).otherwise(here)})
        rows = rows.withColumn("__page", F.when(on, node_id(F.col("leaf_path")))).drop("page", "feature", "threshold", "class_of", "__at")
    return rows.drop("__page", "__values")


def predict_table(df: DataFrame, model: Model) -> DataFrame:
    """df with ``prediction``, from the table of nodes."""
    labels = model.labels.select(F.col("class_id").alias("leaf_class"), F.col("label").alias("prediction"))
    return route_table(df, model).join(labels, "leaf_class", "left").drop("leaf_class", "leaf_path")


def evaluate(df: DataFrame, tree: Tree, label: str = "label") -> DataFrame:
    """One row: checked, correct, accuracy (percent), depth, node_count, leaf_count."""
    nodes = tree.preorder()
    correct = F.count(F.when(F.col("prediction") == F.col(label), 1))
    out = predict(df, tree).agg(F.count("*").alias("checked"), correct.alias("correct"))
    return out.withColumns({"accuracy": F.when(F.col("checked") > 0, 100.0 * F.col("correct") / F.col("checked")), "depth": F.lit(tree.depth()), "node_count": F.lit(len(nodes)), "leaf_count": F.lit(sum(n.is_leaf for n in nodes))})
