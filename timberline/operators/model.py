"""The tree: a table of nodes, small enough for the driver, and its DataFrame form."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

NODES = (
    "node_id long, parent_id long, path string, depth int, edge string, is_leaf boolean, feature_index int, feature_name string, threshold double, "
    "split_value float, leaf_label string, sample_count long, class_counts array<long>, left_id long, right_id long"
)


@dataclass
class Node:
    node_id: int
    parent_id: int | None
    path: str
    depth: int
    edge: str
    is_leaf: bool = True
    feature_index: int | None = None
    feature_name: str | None = None
    threshold: float | None = None
    split_value: float | None = None
    leaf_label: str | None = None
    sample_count: int = 0
    class_counts: list[int] = field(default_factory=list)
    left_id: int | None = None
    right_id: int | None = None


@dataclass
class Tree:
    labels: list[str]
    features: list[str]
    nodes: dict[int, Node] = field(default_factory=dict)
    build_seconds: float = 0.0
    prune_seconds: float = 0.0

    def root(self) -> Node:
        if not self.nodes:
            raise ValueError("Cannot predict before training.")
        return self.nodes[0]

    def preorder(self, at: int = 0) -> list[Node]:
        """Nodes from the root, left before right; without recursion, for deep trees."""
        out, stack = [], [at] if self.nodes else []
        while stack:
            node = self.nodes[stack.pop()]
            out.append(node)
            if not node.is_leaf:
                stack += [node.right_id, node.left_id]
        return out

    def depth(self) -> int:
        return max((n.depth for n in self.preorder()), default=-1)

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(vars(n).values()) for n in self.preorder()], NODES)
