"""Best split of each feature and of each node, with tolerant ties.

Scores within epsilon of the maximum tie. Ties go to the larger gain (gain
ratio only), the lower feature, the lower threshold. Candidates are first
reduced within their tile, where the sweep left them; only the best of each
tile are sent on, so the whole choice is part of the sweep's job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.options import Options, Selection


def _tied(cand: DataFrame, key: list[str], score: str, eps: float) -> DataFrame:
    """The candidates whose score is within eps of their key's maximum."""
    top = F.max(score).over(Window.partitionBy(*key))
    return cand.withColumn("__top", top).filter(F.col(score) >= F.col("__top") - eps).drop("__top")


def best_per_feature(cand: DataFrame, options: Options) -> DataFrame:
    """One candidate for each node and feature."""
    key = ["node_id", "feature_index"]
    tied = _tied(_tied(cand, [*key, "tile"], "score", options.epsilon).drop("tile"), key, "score", options.epsilon)
    if options.selection is Selection.MeanGainFiltered:
        tied = _tied(tied, key, "gain", options.epsilon)
    rest = [c for c in tied.columns if c not in key]
    return tied.groupBy(*key).agg(F.min_by(F.struct(*rest), "threshold").alias("b")).select(*key, "b.*")


def mean_gain_filter(best: DataFrame, options: Options) -> DataFrame:
    """Features whose gain reaches the mean gain of the node's features; at most a row for each feature meets in a node."""
    if options.selection is Selection.MaxGain:
        return best
    mean = F.avg("gain").over(Window.partitionBy("node_id"))
    return best.withColumn("mean_gain", mean).filter(F.col("gain") + options.epsilon >= F.col("mean_gain")).drop("mean_gain")


def best_split(best: DataFrame, options: Options) -> DataFrame:
    """One split for each node that has one."""
    tied = _tied(mean_gain_filter(best, options), ["node_id"], "score", options.epsilon)
    if options.selection is Selection.MeanGainFiltered:
        tied = _tied(tied, ["node_id"], "gain", options.epsilon).filter(F.col("gain_ratio") > options.epsilon)
    rest = [c for c in best.columns if c != "node_id"]
    return tied.groupBy("node_id").agg(F.min_by(F.struct(*rest), F.struct("feature_index", "threshold")).alias("b")).select("node_id", "b.*")
