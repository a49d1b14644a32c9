"""Steps of growth whose memory must not grow with the table."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from timberline.operators import counts
from timberline.operators.encode import class_mapping, joined
from timberline.operators.grow import tiles_of
from timberline.operators.scan import before_tiles, tile_candidates
from timberline.operators.sweep import candidates, swept
from timberline.options import C45, CART, Impurity
from timberline.tables import keep


def crowded(spark, n=4000, classes=4):
    """All values but 16 of the first feature fall into one tile; the second has three values with every class."""
    value = F.when(F.col("id") < n - 16, 1 + F.pmod(F.hash("id"), F.lit(3000)) / 524288).otherwise(F.col("id"))
    return spark.range(0, n, 1, 3).select(F.lit(0).cast("long").alias("node_id"), F.array(value.cast("float"), (F.col("id") % 3).cast("float")).alias("features"), F.pmod(F.hash("id", F.lit(1)), F.lit(classes)).cast("int").alias("class_id"))


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_no_row_of_tiles_is_long(spark):
    """A tile of 12,000 entries, and one value with as many classes, lie in several rows, and their counts come back."""
    rows = spark.range(12_000).select(F.lit(0).cast("long").alias("node_id"), F.array((1 + F.col("id") / 2_097_152).cast("float"), F.lit(5.0).cast("float")).alias("features"), F.col("id").cast("int").alias("class_id"))
    summed = counts.summed(counts.counted(rows))
    tiles = keep(counts.tiled(summed))
    assert tiles.agg(F.max(F.size("value"))).first()[0] <= 4096 and tiles.agg(F.max(F.size("total_class"))).first()[0] <= 4096
    assert sorted(map(tuple, counts.counts_of(tiles).collect())) == sorted(map(tuple, summed.collect()))


@pytest.mark.parametrize("options", [CART, C45])
def test_pieces_are_scanned_as_whole_tiles(spark, monkeypatch, options):
    """Pieces of three entries: values are cut within their classes, too."""
    monkeypatch.setattr(counts, "PIECE", 3)
    df = crowded(spark)
    shown = ["node_id", "feature_index", "threshold", "split_value", "n_left", "n_right", *[F.round(c, 10) for c in ("gain", "split_info", "gain_ratio")]]
    dense = candidates(swept(df, 4), 4, options).select(*shown).collect()
    tiles = tiles_of(df)
    assert tiles.agg(F.max(F.size("value"))).first()[0] == 3
    assert sorted(map(tuple, tile_candidates(tiles, options, every=True).select(*shown).collect())) == sorted(map(tuple, dense)) and len(dense) > 100


def test_rows_of_few_classes_are_not_dealt_by_class(spark):
    """A shuffle by label brings all rows of a class into one task; without automatic broadcasts the dictionary is sent all the same."""
    df = spark.range(1000).select(F.col("id").cast("float").alias("v"), (F.col("id") % 3).cast("string").alias("label"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in plan(joined(df, keep(class_mapping(df))))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_candidates_hold_no_classes(spark):
    """What is chosen from has rows of one size, however many classes a tile has."""
    df = spark.range(3000).select(F.lit(0).cast("long").alias("node_id"), F.array((1 + F.col("id") / 524288).cast("float")).alias("features"), F.col("id").cast("int").alias("class_id"))
    found = tile_candidates(tiles_of(df), CART)
    assert found.count() and not [t for _, t in found.dtypes if t.startswith("array")]


def test_sums_are_dealt_by_size(spark, monkeypatch):
    """Counts are summed behind the shuffle alone, in as many tasks as the values need, and come out the same."""
    df = crowded(spark)
    few = counts.summed(counts.counted(df))
    want = sorted(map(tuple, few.collect()))
    monkeypatch.setattr(counts, "IN_ONE", 1000)
    many = counts.summed(counts.counted(df), 8000)
    assert many.select(F.spark_partition_id()).distinct().count() == 8 and sorted(map(tuple, many.collect())) == want
    for values in (0, 8000):  # from the top: no aggregate stands below the shuffle by value
        shown = plan(counts.summed(counts.counted(df), values))
        assert shown.count("HashAggregate") == 2 and shown.rindex("HashAggregate") < shown.index("Exchange hashpartitioning(node_id")
    assert counts.tiled(many, 8000).agg(F.sum(F.size("value"))).first()[0] == len(want)


def test_sums_are_dealt_by_size_in_sessions_of_many_partitions(spark, monkeypatch):
    """Partitions of few compressed bytes are not merged into tasks of more values than IN_ONE."""
    monkeypatch.setattr(counts, "IN_ONE", 1000)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        df = crowded(spark)
        many = counts.summed(counts.counted(df), 8000)
        assert many.select(F.spark_partition_id()).distinct().count() == 8
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


@pytest.mark.parametrize("kind", list(Impurity))
def test_sums_over_tiles_are_running_sums(spark, kind):
    """A frame that ends with the partition costs the square of a feature's tiles, in one task."""
    shown = plan(before_tiles(tiles_of(crowded(spark)), kind))
    assert "unboundedpreceding$(), currentrow$()" in shown and "currentrow$(), unboundedfollowing$()" not in shown


def test_counts_leave_tasks_by_part(spark, monkeypatch):
    """A row for each part of a feature's values, here eight, and not for each value and class: the shuffle's writer holds what it is given."""
    monkeypatch.setattr(counts, "PARTS", 1 << 4)
    df = crowded(spark)
    made = counts.counted(df)
    assert made.count() <= 3 * (8 + 3) and made.agg(F.sum("n")).first()[0] == 2 * 4000
    want = df.select("node_id", F.posexplode("features").alias("feature_index", "value"), "class_id").groupBy("node_id", "feature_index", "value", "class_id").agg(F.count("*").alias("n"))
    got = counts.summed(made, 8000).drop("tile").select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    tiles = keep(counts.tiled(counts.summed(made, 8000)))
    again = counts.repacked(tiles, 2)
    assert again.count() <= 8 * (8 + 3) and again.agg(F.sum("n")).first()[0] == 2 * 4000
    assert sorted(map(tuple, counts.summed(again).drop("tile").select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
