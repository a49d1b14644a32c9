"""Level-wise growth: nodes, frontier and class counts are tables, whatever their number.

A level counts the rows of the smaller child of each split; the larger child's
counts are its parent's less those. The counts are written a row a tile, swept,
and reduced to one split a node. Splits give the next frontier with the class
counts of its nodes, and rows find their node by a join with the splits. Nodes of
at most ``finish_rows`` rows wait until the rows are written again, every ``REWRITE``
levels; each is then grown to its leaves in one task. The driver sees how many
nodes wait and grow, and nothing else.

A node's id is a hash of its path. ``Model`` holds the table of nodes; ``fit`` makes a
``Tree`` of it, which the driver holds, for up to ``TREE_NODES`` nodes.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.operators.counts import child_counts, class_totals, counted, counts_of, summed, tiled
from timberline.operators.encode import class_mapping, few, joined
from timberline.operators.finish import finish
from timberline.operators.model import Node, Tree
from timberline.operators.scan import tile_candidates
from timberline.operators.select import best_per_feature, best_split
from timberline.operators.sweep import candidates, swept
from timberline.options import Options, Pruning
from timberline.tables import keep

#: Levels after which the rows are written with their nodes, and small nodes are grown.
REWRITE = 4
#: Nodes that a tree on the driver may have, and nodes times classes.
TREE_NODES, TREE_COUNTS = 1_000_000, 50_000_000
NODE = ["node_id", "path", "depth", "class_id", "n"]
SPLIT = ["feature_index", "threshold", "split_value"]
SPLIT_TYPES = ["int", "double", "float"]


def level_splits(rows: DataFrame, k: int, options: Options) -> DataFrame:
    """The best split of each node of rows(node_id, features, class_id), with a column for each of a few classes: l0.. left, t0.. of the node."""
    return best_split(best_per_feature(candidates(swept(rows, k), k, options), options), options)


def tiles_of(rows: DataFrame, values: int = 0) -> DataFrame:
    """The written class counts of rows(node_id, features, class_id), a row a tile. ``values``: rows times features."""
    return keep(tiled(summed(counted(rows), values), values))


def splits_of(tiles: DataFrame, options: Options) -> DataFrame:
    """The best split of each node that has one, from its tiles."""
    return best_split(best_per_feature(tile_candidates(tiles, options), options), options)


def node_id(path: Column) -> Column:
    return F.xxhash64(path)


@dataclass
class Model:
    """A grown tree as a table of nodes: NODE, with the classes of its rows and how many each has, and SPLIT, null at leaves."""

    nodes: DataFrame
    labels: DataFrame
    features: list[str]
    build_seconds: float = 0.0

    def tree(self) -> Tree:
        """The tree on the driver, its nodes numbered by depth and path."""
        found = self.nodes.limit(TREE_NODES + 1).collect()
        if len(found) > TREE_NODES:
            raise ValueError(f"The tree has over {TREE_NODES} nodes; use the table of nodes.")
        found.sort(key=lambda r: (r["depth"], r["path"]))
        labels = [r[0] for r in self.labels.orderBy("class_id").collect()]
        if len(found) * len(labels) > TREE_COUNTS:
            raise ValueError(f"The tree has over {TREE_COUNTS} class counts; use the table of nodes.")
        number = {r["path"]: i for i, r in enumerate(found)}
        tree = Tree(labels, self.features, build_seconds=self.build_seconds)
        for i, r in enumerate(found):
            path, counts = r["path"], [0] * len(labels)
            for c, n in zip(r["class_id"], r["n"]):
                counts[c] = n
            node = Node(i, number[path[:-1]] if path else None, path, r["depth"], {"": "ROOT", "L": "yes", "R": "no"}[path[-1:]], sample_count=sum(r["n"]), class_counts=counts)
            if r["feature_index"] is None:
                node.leaf_label = labels[min(zip((-n for n in r["n"]), r["class_id"]), default=(0, 0))[1]]
            else:
                node.is_leaf, node.feature_index, node.feature_name = False, r["feature_index"], self.features[r["feature_index"]]
                node.threshold, node.split_value = r["threshold"], r["split_value"]
                node.left_id, node.right_id = number[path + "L"], number[path + "R"]
            tree.nodes[i] = node
        return tree


def _stated(nodes: DataFrame, o: Options) -> DataFrame:
    """The nodes with their rows and what becomes of them: a level grows them, or one task, or they are leaves."""
    done = (F.size("class_id") <= 1) | (F.col("rows") < o.min_samples_to_split)
    if o.max_depth >= 0:
        done = done | (F.col("depth") >= o.max_depth)
    nodes = nodes.withColumn("rows", F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x))
    return nodes.withColumn("state", F.when(done, "leaf").when(F.col("rows") <= o.finish_rows, "small").otherwise("grow"))


def _children(splits: DataFrame, growing: DataFrame, tiles: DataFrame, nodes: int) -> DataFrame:
    """NODE of both children of each split, of at most ``nodes``: below it are the classes of the tiles before it, and those of its own tile up to its value."""
    at = few(splits.select("node_id", "feature_index", "at_tile", "split_value"), nodes)
    earlier = class_totals(tiles).join(at, ["node_id", "feature_index"]).filter("tile < at_tile").select("node_id", "class_id", "n")
    own = tiles.join(at.withColumnRenamed("at_tile", "tile"), ["node_id", "feature_index", "tile"])
    inside = counts_of(own, "split_value").filter("value <= split_value").select("node_id", "class_id", "n")
    left = earlier.unionByName(inside).groupBy("node_id", "class_id").agg(F.sum("n").alias("left"))
    every = growing.join(splits.select("node_id"), "node_id", "left_semi").select("node_id", "path", "depth", F.inline(F.arrays_zip("class_id", "n")))
    both = every.join(left, ["node_id", "class_id"], "left").withColumn("left", F.coalesce("left", F.lit(0).cast("long")))
    sides = F.array(F.struct(F.lit("L").alias("side"), F.col("left").alias("m")), F.struct(F.lit("R").alias("side"), (F.col("n") - F.col("left")).alias("m")))
    counts = both.select("path", "depth", "class_id", F.inline(sides)).filter("m > 0").select(F.concat("path", "side").alias("path"), (F.col("depth") + 1).alias("depth"), "class_id", F.col("m").alias("n"))
    return _gathered(counts, "path", "depth")


def _gathered(counts: DataFrame, *by: str) -> DataFrame:
    """NODE from a row for each class of a node."""
    found = counts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("class_id", "n"))).alias("c"))
    return found.select(node_id(F.col("path")).alias("node_id"), "path", "depth", F.col("c.class_id").alias("class_id"), F.col("c.n").alias("n"))


def _moves(splits: DataFrame, growing: DataFrame, children: DataFrame) -> DataFrame:
    """One row for each split: node_id, SPLIT, and of each child its id, rows and state."""
    out = splits.select("node_id", *SPLIT).join(growing.select("node_id", "path"), "node_id")
    for side in ("L", "R"):
        child = children.filter(F.endswith("path", F.lit(side))).select(F.expr("left(path, length(path) - 1)").alias("path"), *[F.col(c).alias(f"{side}_{c}") for c in ("node_id", "rows", "state")])
        out = out.join(child, "path")
    return out.drop("path")


def _smaller(moves: DataFrame) -> DataFrame:
    """The splits with a child that grows by the level: which child is smaller, and the ids of those that grow."""
    left = F.col("L_rows") <= F.col("R_rows")
    grows = lambda side: F.when(F.col(f"{side}_state") == "grow", F.col(f"{side}_node_id"))
    out = moves.select("node_id", "feature_index", "split_value", left.alias("left_smaller"), F.when(left, grows("L")).otherwise(grows("R")).alias("small_id"), F.when(left, grows("R")).otherwise(grows("L")).alias("large_id"))
    return out.filter("small_id is not null or large_id is not null")


def _routed(rows: DataFrame, moves: DataFrame, waiting: DataFrame, nodes: int) -> DataFrame:
    """The rows at children that grow or wait, and those that wait already; ``nodes``: how many split and wait, at most."""
    left = F.element_at("features", F.col("feature_index") + 1) <= F.col("split_value")
    live = lambda side: F.when(F.col(f"{side}_state") != "leaf", F.col(f"{side}_node_id"))
    ways = moves.select("node_id", "feature_index", "split_value", live("L").alias("below"), live("R").alias("above"))
    ways = ways.unionByName(waiting.select("node_id", F.lit(0).alias("feature_index"), F.lit(0.0).cast("float").alias("split_value"), F.col("node_id").alias("below"), F.col("node_id").alias("above")))
    return rows.join(few(ways, nodes), "node_id").select("features", "class_id", F.when(left, F.col("below")).otherwise(F.col("above")).alias("node_id")).filter("node_id is not null")


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def grow(df: DataFrame, options: Options, label: str = "label") -> Model:
    """Grow a tree on float features and a string label, as a table."""
    began = time.perf_counter()
    labels = keep(class_mapping(df, label))
    classes, named = labels.agg(F.count("*"), F.count("label")).first()
    if not classes:
        raise ValueError("Cannot train on an empty dataset.")
    if classes > named:
        raise ValueError("Every row needs a label.")
    features = [c for c in df.columns if c != label]
    bad = F.exists("features", lambda x: F.isnan(x) | x.isNull())
    rows = joined(df, labels, label).withColumn("features", F.when(bad, F.raise_error(F.lit("Features must be numbers."))).otherwise(F.col("features")))
    rows = keep(rows.withColumn("node_id", node_id(F.lit(""))))
    root = rows.groupBy("class_id").agg(F.count("*").alias("n")).withColumns({"path": F.lit(""), "depth": F.lit(0)})
    frontier = keep(_stated(_gathered(root, "path", "depth"), options))
    none = frontier.filter(F.lit(False)).select("node_id", "path", "depth")
    waiting, waits, finished, tiles, moves = none, 0, [], None, None
    split = 0  # nodes that the level before grew
    for level in count():
        found = frontier.groupBy("state").agg(F.count("*").alias("nodes"), F.sum("rows").alias("rows")).collect()  # three rows at most
        states = {r["state"]: r["nodes"] for r in found}
        if grows := "grow" in states:
            values = len(features) * sum(r["rows"] for r in found if r["state"] == "grow")
            tiles = tiles_of(rows, values) if moves is None else keep(tiled(child_counts(tiles, _smaller(moves), rows, split, values, len(features)), values))
        if moves is not None and (grows or waits or "small" in states):
            rows = _routed(rows, moves, waiting, split + waits)
        if "small" in states:
            waiting, waits = waiting.unionByName(frontier.filter("state = 'small'").select("node_id", "path", "depth")), waits + states["small"]
        if "leaf" in states:
            finished.append(frontier.filter("state = 'leaf'").select(*NODE, *[F.lit(None).cast(t).alias(c) for c, t in zip(SPLIT, SPLIT_TYPES)]))
        if level and level % REWRITE == 0 and grows:
            rows = keep(rows)
        if waits and (not grows or level % REWRITE == 0):
            finished.append(keep(finish(rows, waiting, options).withColumn("node_id", node_id(F.col("path"))).select(*NODE, *SPLIT)))
            waiting, waits = none, 0
        if len(finished) > 20:
            finished = [keep(_union(finished))]
        if not grows:
            break
        split = states["grow"]
        growing = frontier.filter("state = 'grow'")
        splits = keep(splits_of(tiles, options))
        finished.append(growing.join(splits.select("node_id", *SPLIT), "node_id", "left").select(*NODE, *SPLIT))
        children = keep(_stated(_children(splits, growing, tiles, split), options))
        frontier, moves = children, keep(_moves(splits, growing, children))
    return Model(keep(_union(finished)), labels, features, time.perf_counter() - began)


def fit(df: DataFrame, options: Options, label: str = "label") -> Tree:
    """Grow a tree on float features and a string label, for the driver; prunes if the options say so."""
    tree = grow(df, options, label).tree()
    if options.pruning is not Pruning.NoPruning:
        from timberline.operators.prune import prune

        tree = prune(tree, df, options, label)
    return tree
