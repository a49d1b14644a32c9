"""Small subtrees: a node whose rows fit one task easily is grown to its leaves there, by the rule of the sweep."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from timberline.operators.scan import gain_of, terms_of, weighted
from timberline.options import Impurity, Options, Selection

GROWN = "path string, depth int, class_id array<int>, n array<long>, feature_index int, threshold double, split_value float"


def _best_of_feature(values: np.ndarray, classes: np.ndarray, every: np.ndarray, o: Options) -> tuple | None:
    """(score, gain, ratio, threshold, split value) of the feature's best candidate; ``every``: rows of each class."""
    order = np.argsort(values, kind="stable")
    v, c = values[order], classes[order]
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    if len(first) < 2:
        return None
    # How many of its class are before each row, and thereby how each row changes the sums of terms at both sides.
    by_class = np.argsort(c, kind="stable")
    left = np.empty(len(c), dtype=np.int64)
    left[by_class] = np.arange(len(c)) - (np.cumsum(every) - every)[c[by_class]]
    right = every[c] - left
    left_terms = np.cumsum(terms_of(left + 1, o.impurity) - terms_of(left, o.impurity))[first[1:] - 1]
    all_terms = terms_of(every, o.impurity).sum()
    right_terms = all_terms + np.cumsum(terms_of(right - 1, o.impurity) - terms_of(right, o.impurity))[first[1:] - 1]
    before, after = v[first[:-1]], v[first[1:]]
    ok = np.abs(before - after).astype(float) >= o.epsilon
    if o.candidates == "adjacent":
        ok &= np.maximum.reduceat(c, first)[:-1] != np.minimum.reduceat(c, first)[1:]
    n_left, least = first[1:], max(1, o.min_samples_per_leaf)
    ok &= (n_left >= least) & (len(v) - n_left >= least)
    if not ok.any():
        return None
    n_left, before, after = n_left[ok], before[ok], after[ok]
    gain = gain_of(n_left, len(v) - n_left, left_terms[ok], right_terms[ok], all_terms, o.impurity)
    keep, ratio = gain > o.epsilon, np.zeros(len(gain))
    if o.selection is Selection.MeanGainFiltered:
        terms = terms_of(n_left, Impurity.Entropy) + terms_of(len(v) - n_left, Impurity.Entropy)
        info = weighted(np.array(len(v)), terms, Impurity.Entropy) / len(v)
        info = info.astype(np.float64)
        keep &= info > o.epsilon
        ratio = gain / np.where(info > 0, info, 1.0)
    if not keep.any():
        return None
    score = np.where(keep, ratio if o.selection is Selection.MeanGainFiltered else gain, -np.inf)
    tied = score >= score.max() - o.epsilon
    if o.selection is Selection.MeanGainFiltered:
        tied &= gain >= gain[tied].max() - o.epsilon
    at = np.flatnonzero(tied)[0]  # the lowest threshold
    return float(score[at]), float(gain[at]), float(ratio[at]), float(before[at] + after[at]) / 2.0, float(before[at])


def _best_split(x: np.ndarray, classes: np.ndarray, every: np.ndarray, o: Options) -> tuple[int, float, float] | None:
    """(feature, threshold, split value)."""
    found = [(i, b) for i in range(x.shape[1]) if (b := _best_of_feature(x[:, i], classes, every, o))]
    if not found:
        return None
    ratio = o.selection is Selection.MeanGainFiltered
    if ratio:
        mean = sum(b[1] for _, b in found) / len(found)
        found = [(i, b) for i, b in found if b[1] + o.epsilon >= mean]
    top = max(b[0] for _, b in found)
    found = [(i, b) for i, b in found if b[0] >= top - o.epsilon]
    if ratio:
        top = max(b[1] for _, b in found)
        found = [(i, b) for i, b in found if b[1] >= top - o.epsilon and b[2] > o.epsilon]
    return (found[0][0], found[0][1][3], found[0][1][4]) if found else None


def subtree(x: np.ndarray, classes: np.ndarray, path: str, depth: int, o: Options) -> Iterator[tuple]:
    """A row of GROWN for every node of the subtree, the node itself first."""
    left_to_grow = [(path, depth, np.arange(len(classes)))]
    while left_to_grow:
        path, depth, rows = left_to_grow.pop()
        present, own, every = np.unique(classes[rows], return_inverse=True, return_counts=True)
        done = len(present) == 1 or 0 <= o.max_depth <= depth or len(rows) < o.min_samples_to_split
        split = None if done else _best_split(x[rows], own, every, o)
        yield path, depth, present.astype(np.int32), every, *(split or (None, None, None))
        if split is not None:
            below = x[rows, split[0]] <= np.float32(split[2])
            left_to_grow += [(path + "R", depth + 1, rows[~below]), (path + "L", depth + 1, rows[below])]


def finish(rows: DataFrame, nodes: DataFrame, options: Options) -> DataFrame:
    """GROWN: the nodes of the subtree of each of nodes(node_id, path, depth), from rows(node_id, features, class_id)."""

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        found = subtree(np.stack(part["features"].to_numpy()).astype(np.float32), part["class_id"].to_numpy(np.int64), part["path"].iloc[0], int(part["depth"].iloc[0]), options)
        return pd.DataFrame(found, columns=[c.split()[0] for c in GROWN.split(", ")]).astype({"feature_index": "Int32"})

    return rows.join(nodes, "node_id").groupBy("node_id").applyInPandas(grow, GROWN)
