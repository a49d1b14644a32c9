"""Pruning: one job routes all rows to leaves; the tree is then folded bottom-up, on the driver or, for a tree that is a table, a level at a time by joins."""

from __future__ import annotations

import math
import time
from copy import deepcopy

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions.impurity import pessimistic_errors
from timberline.operators.encode import majority
from timberline.operators.grow import NODE, SPLIT, Model, node_id
from timberline.operators.model import Tree
from timberline.operators.predict import route, route_table
from timberline.options import Options, Pruning
from timberline.tables import keep


def leaf_counts(tree: Tree, df: DataFrame, label: str = "label") -> dict[int, list[int]]:
    """Rows of each class at each leaf, routed by thresholds: one row for each leaf and class reaches the driver."""
    counts = {n.node_id: [0] * len(tree.labels) for n in tree.nodes.values()}
    ids = {s: i for i, s in enumerate(tree.labels)}
    for r in route(df, tree).groupBy("leaf_id", F.col(label).alias("label")).count().collect():
        if r["label"] in ids:
            counts[r["leaf_id"]][ids[r["label"]]] += r["count"]
    for node in reversed(tree.preorder()):
        if not node.is_leaf:
            counts[node.node_id] = [a + b for a, b in zip(counts[node.left_id], counts[node.right_id])]
    return counts


def estimates(spark: SparkSession, pairs: set[tuple[int, int]], factor: float) -> dict[tuple[int, int], float]:
    """Pessimistic errors of (rows, errors): the column expression over one small table."""
    table = spark.createDataFrame(sorted(pairs), "n long, e long")
    return {(r[0], r[1]): r[2] for r in table.select("n", "e", pessimistic_errors(F.col("n"), F.col("e"), factor)).collect()}


def prune(tree: Tree, df: DataFrame, options: Options, label: str = "label") -> Tree:
    """A pruned copy of the tree."""
    tree = deepcopy(tree)
    tree.prune_seconds = 0.0
    if options.pruning is Pruning.NoPruning or not tree.nodes:
        return tree
    began = time.perf_counter()
    counts = leaf_counts(tree, df, label)
    as_leaf = {i: (sum(c), sum(c) - c[majority(c)]) for i, c in counts.items()}
    as_is = {n.node_id: (sum(counts[n.node_id]), sum(counts[n.node_id]) - counts[n.node_id][tree.labels.index(n.leaf_label)]) for n in tree.nodes.values() if n.is_leaf}
    pessimistic = options.pruning is Pruning.PessimisticError
    price = estimates(df.sparkSession, {*as_leaf.values(), *as_is.values()}, options.confidence_factor) if pessimistic else {}
    cost: dict[int, tuple[float, int]] = {}  # of a subtree: errors or estimate, leaves
    for node in reversed(tree.preorder()):
        i = node.node_id
        if node.is_leaf:
            cost[i] = (price[as_is[i]] if pessimistic else as_is[i][1], 1)
            continue
        below = tuple(a + b for a, b in zip(cost[node.left_id], cost[node.right_id]))
        if pessimistic:
            leaf, subtree = price[as_leaf[i]], below[0]
        else:
            leaf, subtree = as_leaf[i][1] + options.ccp_alpha, below[0] + options.ccp_alpha * below[1]
        if not math.isnan(leaf) and leaf <= subtree + options.epsilon:
            for gone in tree.preorder(i)[1:]:
                del tree.nodes[gone.node_id]
            node.is_leaf, node.leaf_label, node.sample_count, node.class_counts = True, tree.labels[majority(counts[i])], sum(counts[i]), counts[i]
            node.feature_index = node.feature_name = node.threshold = node.split_value = node.left_id = node.right_id = None
            cost[i] = (price[as_leaf[i]] if pessimistic else as_leaf[i][1], 1)
        else:
            cost[i] = below
    tree.prune_seconds = time.perf_counter() - began
    return tree


def prune_table(model: Model, df: DataFrame, options: Options, label: str = "label") -> Model:
    """A pruned copy of a tree that is a table.

    The class counts of leaves are rolled up to all prefixes of their paths; costs go up
    by one join a level; nodes below a cut are those with a prefix that is one.
    Rows with a label that the tree does not know count for nothing.
    """
    if options.pruning is Pruning.NoPruning:
        return model
    labels = model.labels.select(F.col("label").alias(label), "class_id")
    reached = route_table(df.select(*[F.col(f"`{c}`") for c in model.features], label), model).join(labels, label).groupBy(F.col("leaf_path").alias("path"), "class_id").agg(F.count("*").alias("m"))
    reached = keep(reached)
    prefixes = F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda i: F.left("path", i)))
    counts = reached.select(prefixes.alias("path"), "class_id", "m").groupBy("path", "class_id").agg(F.sum("m").alias("m"))
    counts = counts.groupBy("path").agg(F.sum("m").alias("rows"), F.max("m").alias("top"), F.array_sort(F.collect_list(F.struct("class_id", "m"))).alias("c"))  # at most a row for each class
    own = F.array_min(F.zip_with("n", "class_id", lambda n, c: F.struct((-n).alias("n"), c.alias("c"))))["c"]
    right = reached.select("path", F.col("class_id").alias("own"), F.col("m").alias("right"))
    zero = F.lit(0).cast("long")
    nodes = model.nodes.withColumn("own", own).join(counts, "path", "left").join(right, ["path", "own"], "left").withColumns({c: F.coalesce(c, zero) for c in ("rows", "top", "right")})
    nodes = keep(nodes.select("path", "depth", F.col("feature_index").isNull().alias("leaf"), "rows", "top", "right", "c"))
    pessimistic = options.pruning is Pruning.PessimisticError
    price = (lambda n, e: pessimistic_errors(n, e, options.confidence_factor)) if pessimistic else (lambda n, e: e.cast("double"))
    alpha = 0.0 if pessimistic else options.ccp_alpha
    as_is, one = price(F.col("rows"), F.col("rows") - F.col("right")), price(F.col("rows"), F.col("rows") - F.col("top"))
    below, cuts = None, []
    for depth in range(nodes.agg(F.max("depth")).first()[0], -1, -1):
        here = nodes.filter(F.col("depth") == depth)
        if below is None:
            here = here.withColumns({"many": F.lit(None).cast("double"), "leaves": F.lit(None).cast("long")})
        else:
            up = below.groupBy(F.expr("left(path, length(path) - 1)").alias("path")).agg(F.sum("cost").alias("many"), F.sum("leaves").alias("leaves"))
            here = here.join(up, "path", "left")
        cut = ~F.col("leaf") & ~F.isnan("one") & (F.col("one") + alpha <= F.col("many") + alpha * F.col("leaves") + options.epsilon)
        here = here.withColumn("one", one).withColumn("cut", cut)
        ends = F.col("leaf") | F.col("cut")
        cost = F.when(F.col("leaf"), as_is).when(F.col("cut"), F.col("one")).otherwise(F.col("many"))
        below = keep(here.select("path", "cut", cost.alias("cost"), F.when(ends, F.lit(1).cast("long")).otherwise(F.col("leaves")).alias("leaves"), "c"))
        cuts.append(below.filter("cut").select("path", "c"))
    cut = cuts[0]
    for more in cuts[1:]:
        cut = cut.unionByName(more)
    cut = keep(cut)
    above = F.explode(F.transform(F.sequence(F.lit(0), F.length("path") - 1), lambda i: F.left("path", i)))
    gone = model.nodes.filter("depth > 0").select("path", above.alias("top")).join(cut.select(F.col("path").alias("top")), "top", "left_semi").select("path")
    left = model.nodes.join(gone, "path", "left_anti").join(cut.withColumn("cut", F.lit(True)), "path", "left")
    leaf = F.coalesce("cut", F.lit(False))
    none = F.array().cast("array<struct<class_id:int,m:bigint>>")
    counted = F.coalesce("c", none)
    changed = {"class_id": F.when(leaf, counted["class_id"]).otherwise(F.col("class_id")), "n": F.when(leaf, counted["m"]).otherwise(F.col("n"))} | {c: F.when(~leaf, F.col(c)) for c in SPLIT}
    return Model(keep(left.withColumns(changed).withColumn("node_id", node_id(F.col("path"))).select(*NODE, *SPLIT)), model.labels, model.features, model.build_seconds)
