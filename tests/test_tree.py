"""Growth, prediction and pruning against values worked out by hand."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from timberline.functions.impurity import extra_errors, impurity, normal_quantile
from timberline.operators.grow import Model, fit, grow, tiles_of
from timberline.operators.predict import evaluate, predict, predict_table, route
from timberline.operators.prune import prune, prune_table
from timberline.operators.render import tree_text
from timberline.operators.scan import tile_candidates
from timberline.operators.sweep import boundaries, candidates, swept, tile_of, value_histogram
from timberline.options import C45, CART, Impurity, Pruning


def table(spark, rows):
    return spark.createDataFrame([(float(v), c) for v, c in rows], "v float, label string")


def leaves(tree):
    return [(n.leaf_label, n.sample_count) for n in tree.preorder() if n.is_leaf]


@pytest.mark.parametrize(
    "rows, options, expected",
    [
        ([(1, "a"), (2, "a")], CART, [("a", 2)]),
        ([(1, "a"), (1, "b")], CART, [("a", 2)]),
        ([(1, "a")] * 4 + [(1, "b")] + [(2, "b")] * 4 + [(2, "c")], CART, [("b", 10)]),
        ([(0, "a"), (5e-10, "b")], CART, [("a", 2)]),
        ([(1, "a"), (2, "b"), (3, "b")], replace(CART, min_samples_per_leaf=2), [("b", 3)]),
        ([(1, "a"), (2, "b"), (3, "b")], replace(CART, min_samples_per_leaf=0), [("a", 1), ("b", 2)]),
        ([(1, "a"), (2, "b")], replace(CART, min_samples_to_split=3), [("a", 2)]),
    ],
)
def test_small_tables(spark, rows, options, expected):
    assert leaves(fit(table(spark, rows), options)) == expected


def test_all_boundaries_split_what_adjacent_classes_skip(spark):
    rows = [(1, "a")] * 4 + [(1, "b")] + [(2, "b")] * 4 + [(2, "c")]
    tree = fit(table(spark, rows), replace(CART, candidates="all", max_depth=1))
    assert tree.root().threshold == 1.5


def test_equal_features_take_the_first(spark):
    df = table(spark, [(1, "a"), (2, "b")]).select("v", F.col("v").alias("w"), "label")
    assert fit(df, C45).root().feature_name == "v"


def test_float_threshold_may_reach_the_upper_value(spark):
    df = table(spark, [(16777215, "a"), (16777216, "b")])
    tree = fit(df, CART)
    assert tree.root().threshold == 16777216.0 and leaves(tree) == [("a", 1), ("b", 1)]
    assert [r.prediction for r in predict(df, tree).orderBy("v").collect()] == ["a", "a"]


def test_empty_and_untrained(spark):
    from timberline.operators.model import Tree

    with pytest.raises(ValueError, match="empty dataset"):
        fit(table(spark, []), CART)
    with pytest.raises(ValueError, match="before training"):
        predict(table(spark, [(1, "a")]), Tree(["a"], ["v"]))
    assert tree_text(Tree([], [])) == "Tree is empty."


def test_missing_features_are_refused(spark):
    df = spark.createDataFrame([(float("nan"), "a"), (1.0, "b")], "v float, label string")
    with pytest.raises(Exception, match="must be numbers"):
        fit(df, CART)


@pytest.mark.parametrize("n, e, cf, expected", [(1, 0, 0.25, 0.75), (6, 0, 0.25, 1.237797), (9, 0, 0.25, 1.284804), (50, 1, 0.25, 1.549067), (54, 5, 0.25, 2.183211), (2, 1, 0.25, 0.791493), (100, 50, 0.25, 3.862372), (10, 3, 0.5, 0.5), (10, 3, 0.0005, 4.806139), (5, 5, 0.25, 0.0)])
def test_extra_errors(spark, n, e, cf, expected):
    got = spark.range(1).select(extra_errors(F.lit(n), F.lit(e), cf)).first()[0]
    assert got == pytest.approx(expected, abs=1e-6)


def test_quantile_and_impurity(spark):
    row = spark.range(1).select(normal_quantile(F.lit(0.75)), normal_quantile(F.lit(0.01)), normal_quantile(F.lit(0.0)), impurity([F.lit(0), F.lit(0)], Impurity.Entropy), impurity([F.lit(2), F.lit(2)], Impurity.Entropy), impurity([F.lit(1), F.lit(1)], Impurity.Gini)).first()
    assert row[0] == pytest.approx(0.6744897501960817, abs=1e-8) and row[1] == pytest.approx(-2.3263478740408408, abs=1e-8)
    assert row[2] == float("-inf") and tuple(row[3:]) == (0.0, 1.0, 0.5)


def test_tiles_keep_the_order_of_floats(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.integers(0, 2**32, 3000, dtype=np.uint32).view(np.float32), np.float32(2.0) ** np.arange(-140, 127, dtype=np.float32), np.nextafter(np.float32(2.0) ** np.arange(-120, 127, dtype=np.float32), np.float32(0)), np.float32([0, -0.0, np.inf, -np.inf])])
    values = np.concatenate([values, -values])
    values = np.sort(values[~np.isnan(values)])
    rows = spark.createDataFrame(pd.DataFrame({"n": np.arange(len(values)), "v": values}))
    tiles = [r[0] for r in rows.select("n", tile_of(F.col("v")).alias("t")).orderBy("n").select("t").collect()]
    assert (np.diff(tiles) >= 0).all()
    many = pd.DataFrame({"v": np.linspace(1, 2, 300_001, dtype=np.float32)})
    assert spark.createDataFrame(many).groupBy(tile_of(F.col("v")).alias("t")).count().count() == 129


def test_tiled_sweep_equals_plain_sums(spark):
    df = spark.range(500).select(F.array((F.col("id") % 97 - 40).cast("float"), F.pmod(F.hash("id"), F.lit(50)).cast("float")).alias("features"), F.pmod(F.hash("id", F.lit(1)), F.lit(3)).alias("class_id"), (F.col("id") % 2).alias("node_id"))
    rows = [(r.node_id, f, v, r.class_id) for r in df.collect() for f, v in enumerate(r.features)]
    want = []
    for node, f in {(n, f) for n, f, _, _ in rows}:
        here = sorted((v, c) for n, g, v, c in rows if (n, g) == (node, f))
        values = sorted({v for v, _ in here})
        for before, value in zip(values, values[1:]):
            below = [sum(c == i and v < value for v, c in here) for i in range(3)]
            want.append((node, f, before, value, max(c for v, c in here if v == before), min(c for v, c in here if v == value), *below, *(sum(c == i for _, c in here) for i in range(3))))
    got = boundaries(value_histogram(df, 3), 3).select("node_id", "feature_index", "before", "value", "before_class", "min_class", *[f"{x}{i}" for x in "lt" for i in range(3)])
    assert sorted(map(tuple, got.collect())) == sorted(want)


def noisy(spark, n, classes=3):
    hashed = lambda salt, m: F.pmod(F.hash("id", F.lit(salt)), F.lit(m))
    return spark.range(n).select(hashed(1, 40).cast("float").alias("a"), (hashed(2, 5000) / 7).cast("float").alias("b"), (hashed(3, 9) - 4).cast("float").alias("c"), F.concat(F.lit("k"), F.pmod(hashed(1, 40) + hashed(3, 9) + hashed(4, 3), F.lit(classes))).alias("label"))


@pytest.mark.parametrize("options", [C45, replace(CART, candidates="all", min_samples_per_leaf=3)])
def test_small_subtrees_grow_by_the_same_rule(spark, options):
    df = noisy(spark, 700)
    swept_only = fit(df, replace(options, max_depth=3, finish_rows=0))
    mixed = fit(df, replace(options, max_depth=3, finish_rows=250))
    assert tree_text(swept_only) == tree_text(fit(df, replace(options, max_depth=3))) == tree_text(mixed)
    assert all(n.sample_count == sum(n.class_counts) for n in mixed.preorder())


def test_rows_written_at_any_level(spark, monkeypatch):
    from timberline.operators import grow

    df = noisy(spark, 600)
    whole = tree_text(fit(df, replace(CART, max_depth=4)))
    monkeypatch.setattr(grow, "REWRITE", 1)
    assert tree_text(fit(df, replace(CART, max_depth=4, finish_rows=60))) == whole


def test_thousands_of_nodes_and_classes(spark):
    """16,384 classes of one row each: by entropy the best split is the middle one, so the last level but one has 8,192 growing nodes."""
    n = 1 << 14
    df = spark.range(n).select(F.col("id").cast("float").alias("v"), F.format_string("k%05d", "id").alias("label"))
    model = grow(df, replace(CART, impurity=Impurity.Entropy, finish_rows=0))
    levels = {r.depth: (r.nodes, r.rows, r.leaves) for r in model.nodes.groupBy("depth").agg(F.count("*").alias("nodes"), F.sum(F.expr("aggregate(n, 0L, (a, x) -> a + x)")).alias("rows"), F.count(F.when(F.col("feature_index").isNull(), 1)).alias("leaves")).collect()}
    assert levels == {d: (1 << d, n, n if d == 14 else 0) for d in range(15)}
    middle = model.nodes.filter("depth = 1").select(F.element_at("class_id", 1), F.element_at("class_id", -1), "threshold").orderBy("path").collect()
    assert [tuple(r) for r in middle] == [(0, n // 2 - 1, n / 4 - 0.5), (n // 2, n - 1, 3 * n / 4 - 0.5)]
    with pytest.raises(ValueError, match="table of nodes"):
        import timberline.operators.grow as module

        few, module.TREE_NODES = module.TREE_NODES, 100
        try:
            model.tree()
        finally:
            module.TREE_NODES = few


def test_children_are_counted_by_the_smaller_one(spark, monkeypatch):
    from timberline.operators import counts

    rows = spark.range(1000).select(F.lit(7).cast("long").alias("node_id"), F.array((F.col("id") % 50).cast("float"), F.pmod(F.hash("id"), F.lit(9)).cast("float")).alias("features"), (F.col("id") % 3).cast("int").alias("class_id"))
    tiles = counts.tiled(counts.summed(counts.counted(rows)))
    seen = []
    plain = counts.counted
    monkeypatch.setattr(counts, "counted", lambda r: seen.append(r.count()) or plain(r))
    for limit, smaller in ((12.0, 260), (40.0, 180)):
        split = spark.createDataFrame([(7, 0, limit, limit < 25, 71 if limit < 25 else 72, 72 if limit < 25 else 71)], "node_id long, feature_index int, split_value float, left_smaller boolean, small_id long, large_id long")
        got = counts.child_counts(tiles, split, rows)
        sides = rows.withColumn("node_id", F.when(F.col("features")[0] <= limit, 71).otherwise(72).cast("long"))
        want = counts.summed(plain(sides))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and seen.pop() == smaller
        only = counts.child_counts(tiles, split.withColumn("small_id", F.lit(None).cast("long")), rows)
        assert {r.node_id for r in only.collect()} == {72 if limit < 25 else 71} and seen.pop() == smaller
    assert counts.counts_of(tiles).count() == counts.summed(plain(rows)).count()


def test_wide_rows_leave_tasks_as_counts(spark):
    """64 features of four values: a task hands on a row for each value and class, not one for each row and feature."""
    from timberline.operators.counts import counted

    wide = spark.range(0, 5000, 1, 2).select(F.lit(0).alias("node_id"), F.array(*[F.pmod(F.hash("id", F.lit(f)), F.lit(4)).cast("float") for f in range(64)]).alias("features"), (F.col("id") % 2).cast("int").alias("class_id"))
    made = counted(wide)
    assert made.count() <= 2 * 64 * 4 * 2 and made.agg(F.sum("n")).first()[0] == 64 * 5000


@pytest.mark.parametrize("options", [CART, C45, replace(CART, impurity=Impurity.Entropy, candidates="all", min_samples_per_leaf=7)])
def test_scan_equals_the_dense_sweep(spark, options):
    """Candidates from sparse running sums against those from a column for each class."""
    df = spark.range(3000).select((F.col("id") % 2).alias("node_id"), F.array((F.pmod(F.hash("id"), F.lit(1700)) / 16 - 40).cast("float"), (F.col("id") % 13 - 6).cast("float")).alias("features"), F.pmod(F.hash("id", F.lit(1)), F.lit(4)).cast("int").alias("class_id"))
    shown = ["node_id", "feature_index", "threshold", "split_value", "n_left", "n_right", *[F.round(c, 10) for c in ("gain", "split_info", "gain_ratio")]]
    dense = candidates(swept(df, 4), 4, options).select(*shown).collect()
    sparse = tile_candidates(tiles_of(df), options, every=True).select(*shown).collect()
    assert sorted(map(tuple, sparse)) == sorted(map(tuple, dense)) and len(dense) > 100


@pytest.mark.parametrize("options", [replace(CART, pruning=Pruning.CostComplexity, ccp_alpha=2.0), replace(C45, pruning=Pruning.PessimisticError)])
def test_tables_predict_and_prune_as_trees_do(spark, options):
    df = noisy(spark, 900)
    model = grow(df, replace(options, max_depth=9))
    tree = model.tree()
    some = df.withColumn("a", F.when(F.col("b") > 3, F.col("a"))).withColumn("c", F.when(F.col("a") > 5, float("nan")).otherwise(F.col("c")).cast("float"))
    order = [*df.columns, "prediction"]
    assert sorted(map(repr, predict_table(some, model).select(order).collect())) == sorted(map(repr, predict(some, tree).select(order).collect()))
    other = df.limit(700).unionByName(df.limit(5).withColumn("label", F.lit("unknown")))
    assert tree_text(prune_table(model, other, options).tree()) == tree_text(prune(tree, other, options))
    assert 1 < len(prune(tree, other, options).nodes) < len(tree.nodes)


def test_a_million_leaves_predict(spark):
    """A complete tree of 20 levels over one feature: a value's leaf is its whole part."""
    depth = 20
    levels = [spark.range(1 << d).select(F.lit(d).alias("depth"), F.col("id"), F.lpad(F.bin("id"), d, "0").alias("bits")) for d in range(depth + 1)]
    nodes = levels[0]
    for more in levels[1:]:
        nodes = nodes.unionByName(more)
    size = F.pow(F.lit(2.0), depth - F.col("depth"))
    inner = F.col("depth") < depth
    nodes = nodes.select(
        F.translate("bits", "01", "LR").alias("path"), "depth", F.array((F.col("id") % 3).cast("int")).alias("class_id"), F.array(F.lit(1).cast("long")).alias("n"), F.when(inner, 0).alias("feature_index"), F.when(inner, (F.col("id") + 0.5) * size - 0.5).alias("threshold"), F.when(inner, F.lit(0.0)).cast("float").alias("split_value")
    )
    model = Model(nodes.withColumn("node_id", F.xxhash64("path")), spark.createDataFrame([(f"k{i}", i) for i in range(3)], "label string, class_id int"), ["v"])
    rows = spark.range(4000).select((F.pmod(F.hash("id"), F.lit(1 << depth))).cast("float").alias("v"))
    got = predict_table(rows, model).collect()
    assert len(got) == 4000 and all(r.prediction == f"k{int(r.v) % 3}" for r in got)


def test_unlimited_depth_ends(spark, monkeypatch):
    df = noisy(spark, 20_000)
    tree = fit(df, replace(CART, finish_rows=3000))
    assert sum(n for _, n in leaves(tree)) == 20_000 and tree.depth() > 10
    some = df.limit(500).withColumn("a", F.when(F.col("b") > 3, F.col("a")))
    assert evaluate(df.limit(2000), tree).first().accuracy > 90
    monkeypatch.setattr("timberline.operators.predict.EXPRESSION_LEAVES", 10**9)
    small = fit(df.limit(2000), replace(CART, finish_rows=3000, max_depth=7))
    by_expression = [r.leaf_id for r in route(some, small).collect()]
    monkeypatch.setattr("timberline.operators.predict.EXPRESSION_LEAVES", 1)
    assert [r.leaf_id for r in route(some, small).collect()] == by_expression and len(set(by_expression)) > 9


def test_null_labels_are_refused(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, None)], "v float, label string")
    with pytest.raises(ValueError, match="needs a label"):
        fit(df, CART)


def test_three_classes_grown_and_pruned(spark):
    flowers = [(1.0, 1.0, "a")] * 50 + [(4.0, 1.5, "b")] * 49 + [(4.0, 1.5, "c")] * 5 + [(5.0, 2.0, "b")] + [(5.0, 2.0, "c")] * 45
    df = spark.createDataFrame([(float(i), w, c) for i, (x, w, c) in enumerate(flowers)], "i double, w float, label string").select((F.col("i") * 0).cast("float").alias("none"), "w", "label")
    options = replace(CART, max_depth=2)
    tree = fit(df, options)
    assert tree_text(tree).split("\n") == [
        "ROOT [n=150]: if w <= 1.250",
        "  yes [n=50]: Leaf -> a",
        "  no [n=100]: if w <= 1.750",
        "    yes [n=54]: Leaf -> b",
        "    no [n=46]: Leaf -> c",
    ]
    measured = evaluate(df, tree).first()
    assert (measured.correct, measured.accuracy, measured.depth, measured.node_count) == (144, 96.0, 2, 5)
    cost = lambda alpha: len(prune(tree, df, replace(options, pruning=Pruning.CostComplexity, ccp_alpha=alpha)).nodes)
    assert [cost(a) for a in (0.5, 43.9, 44.0, 50.0)] == [5, 5, 3, 1]
    assert len(prune(tree, df, replace(options, pruning=Pruning.PessimisticError)).nodes) == 5
    assert leaves(fit(df, replace(CART, max_depth=0))) == [("a", 150)]
    assert fit(df, replace(C45, max_depth=1)).root().feature_name == "w"


def test_order_and_partitions_do_not_matter(spark):
    df = spark.range(400).select((F.pmod(F.hash("id"), F.lit(40))).cast("float").alias("a"), (F.col("id") % 13).cast("float").alias("b"), F.when(F.pmod(F.hash("id"), F.lit(40)) + F.col("id") % 13 > 25, "x").otherwise("y").alias("label"))
    one = fit(df, replace(C45, max_depth=3))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    two = fit(df.orderBy(F.rand(3)).repartition(5), replace(C45, max_depth=3, finish_rows=50))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert tree_text(one) == tree_text(two)
    assert sum(n for _, n in leaves(one)) == 400 and one.depth() <= 3


def test_no_pruning_changes_nothing(spark):
    tree = fit(table(spark, [(1, "a"), (2, "b"), (3, "b")]), CART)
    same = prune(tree, table(spark, [(1, "b")]), replace(CART, pruning=Pruning.NoPruning))
    assert tree_text(same) == tree_text(tree) and same is not tree and same.prune_seconds == 0.0
