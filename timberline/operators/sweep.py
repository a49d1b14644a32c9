"""Threshold sweeps of few classes with DataFrame functions alone: value histograms, running class counts, scored candidates.

Growth counts and scans as in counts.py and scan.py, for any number of classes; a
test compares both. All nodes and features are swept by one plan. Rows are first
counted by (node, feature, value), so later steps see one row a distinct value.
Values fall into tiles by their size alone, and a tile holds at most 65,536
different floats; running counts are taken within tiles, and a row a tile
carries the totals of the tiles before it. So a single feature of a single node
spreads over many tasks, with no sampling and no pass of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions.impurity import gain, impurity, split_information, total
from timberline.operators.encode import class_counts
from timberline.options import Options, Selection


def value_histogram(rows: DataFrame, k: int) -> DataFrame:
    """rows(node_id, features, class_id) -> node_id, feature_index, value, min_class, max_class, c0..ck-1."""
    long = rows.select("node_id", "class_id", F.posexplode("features").alias("feature_index", "value"))
    return long.groupBy("node_id", "feature_index", "value").agg(F.min("class_id").alias("min_class"), F.max("class_id").alias("max_class"), *class_counts(k))


def _columns(k: int, prefix: str) -> list[Column]:
    return [F.col(f"{prefix}{i}") for i in range(k)]


def tile_of(value: Column) -> Column:
    """The 128th of a binary order of magnitude that a float is in: larger values are in the same or a later tile.

    A value a little below a power of two has the same number whichever order
    the rounded logarithm gives.
    """
    size = F.abs(value.cast("double"))
    order = F.floor(F.log2(size))
    number = (order + 200) * 128 + F.floor((size / F.pow(F.lit(2.0), order) - 1) * 128)
    number = F.when(size == 0, 0).when(size > 3.5e38, 50_000).otherwise(number)
    return (F.when(value < 0, -1).otherwise(1) * number).cast("int")


def boundaries(hist: DataFrame, k: int) -> DataFrame:
    """Each value with its tile, the value before it, that value's largest class, counts below (l0..) and of the node (t0..)."""
    key, i = ["node_id", "feature_index"], range(k)
    tiles = hist.withColumn("tile", tile_of(F.col("value")))
    sums = tiles.groupBy(*key, "tile").agg(*[F.sum(f"c{c}").alias(f"s{c}") for c in i], F.max(F.struct("value", "max_class", "min_class")).alias("last"))
    of = Window.partitionBy(*key).orderBy("tile")
    earlier, whole = of.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*key)
    carried = sums.select(*key, "tile", *[F.coalesce(F.sum(f"s{c}").over(earlier), F.lit(0)).alias(f"p{c}") for c in i], *[F.sum(f"s{c}").over(whole).alias(f"t{c}") for c in i], F.lag("last").over(of).alias("carried"))
    by = Window.partitionBy(*key, "tile").orderBy("value")
    below = by.rowsBetween(Window.unboundedPreceding, -1)
    inner = {"before": F.lag("value").over(by), "before_class": F.lag("max_class").over(by)} | {f"l{c}": F.sum(f"c{c}").over(below) for c in i}
    out = {"before": F.coalesce("before", F.col("carried.value")), "before_class": F.coalesce("before_class", F.col("carried.max_class"))}
    out |= {f"l{c}": F.coalesce(f"l{c}", F.lit(0)) + F.col(f"p{c}") for c in i}
    found = tiles.withColumns(inner).join(carried, [*key, "tile"]).withColumns(out)
    return found.filter("before is not null").drop("carried", *[f"p{c}" for c in i])


def swept(rows: DataFrame, k: int) -> DataFrame:
    """Boundaries of rows(node_id, features, class_id)."""
    return boundaries(value_histogram(rows, k), k)


def candidates(bounds: DataFrame, k: int, options: Options) -> DataFrame:
    """Valid candidates: node_id, feature_index, tile, threshold, split_value, n_left, n_right, gain, split_info, gain_ratio, score, l0.., t0.."""
    left, every = _columns(k, "l"), _columns(k, "t")
    right = [t - x for t, x in zip(every, left)]
    apart = F.abs(F.col("before") - F.col("value")) >= options.epsilon
    if options.candidates == "adjacent":
        apart = apart & (F.col("before_class") != F.col("min_class"))
    wide = bounds.filter(apart).withColumns({"n_left": total(left), "n_right": total(right)})
    least = max(1, options.min_samples_per_leaf)
    wide = wide.filter((F.col("n_left") >= least) & (F.col("n_right") >= least))
    # Float sum, then a double half. Exploding one struct keeps the optimizer from repeating the formulas in filters and ratios.
    ratio = options.selection is not Selection.MaxGain
    info = split_information([F.col("n_left"), F.col("n_right")]) if ratio else F.lit(0.0)
    once = F.struct(gain(every, [left, right], options.impurity).alias("gain"), info.alias("split_info"))
    wide = wide.withColumns({"threshold": (F.col("before") + F.col("value")).cast("double") / 2.0, "split_value": F.col("before")}).select("*", F.inline(F.array(once))).filter(F.col("gain") > options.epsilon)
    if ratio:
        wide = wide.filter(F.col("split_info") > options.epsilon).withColumn("gain_ratio", F.col("gain") / F.col("split_info")).withColumn("score", F.col("gain_ratio"))
    else:
        wide = wide.withColumns({"gain_ratio": F.lit(0.0), "score": F.col("gain")})
    return wide.select("node_id", "feature_index", "tile", "threshold", "split_value", "n_left", "n_right", "gain", "split_info", "gain_ratio", "score", *left, *every)


def partition_measures(df: DataFrame, part: str, labels: list[str], label: str, kind) -> DataFrame:
    """Information gain and split information of a partition of any arity into the groups of ``part``: one aggregate of group rows."""
    from timberline.operators.encode import class_counts as counts

    k = len(labels)
    ids = F.create_map(*[x for i, s in enumerate(labels) for x in (F.lit(s), F.lit(i))])
    groups = df.withColumn("class_id", ids[F.col(label)]).groupBy(part).agg(*counts(k))
    c = _columns(k, "c")
    n = total(c)
    groups = groups.withColumns({"n": n, "weighted": n * impurity(c, kind)})
    sums = groups.agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(k)], F.sum("n").alias("n"), F.sum("weighted").alias("weighted"), F.sum(F.col("n") * F.log2("n")).alias("sized"), F.count("*").alias("parts"))
    return sums.select("parts", "n", (impurity(c, kind) - F.col("weighted") / F.col("n")).alias("gain"), (F.log2("n") - F.col("sized") / F.col("n")).alias("split_info"))
