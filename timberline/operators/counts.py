"""Counts of (node, feature, value, class): made in the tasks, summed by a shuffle, kept a row a tile.

A task counts its rows for all features at once, as arrays, so what leaves it is
each distinct combination and not one for each row and feature. The sum
is dealt by parts of the values, by their bits: a feature whose values all fall into one tile still spreads
over all tasks, which are as many as the values need (``IN_ONE``). Combinations of one part leave
as the arrays of one row, so that the writer of the shuffle holds a third of what a row for each would take. Nothing is summed
before the shuffle but what a task counts at once, as a table of all that a task
counts would grow with the distinct values of its rows. Tiles are the floats that agree in their upper 16 bits, at most
65,536, cut into pieces of ``PIECE`` entries, even within a value, so that no row and
nothing made of it grows with the table. A piece's row has its values, classes and
counts as arrays and, small and beside them, the totals of its classes and its last
value. So the table is written once: a reader of the totals does not read the values.

The counts of a node whose parent's are kept need no look at the rows if its
sibling's are known: they are the parent's less the sibling's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.operators.encode import FEW, few

#: Values of rows that a task counts at once.
AT_ONCE = 500_000
#: Values of rows whose counts one task sums, about.
IN_ONE = 2_000_000
#: Parts into which the values of all features are dealt, about; those of a wide table have fewer each.
PARTS = 1 << 13
#: Entries (value, class) of one row of TILES, at most.
PIECE = 4096
#: Counts of one part as arrays of the same length; ``n`` is the sum of ``each``.
PACKED = "node_id long, feature_index int, part int, n long, tile array<int>, value array<float>, class_id array<int>, each array<long>"
COUNTS = "node_id long, feature_index int, tile int, value float, class_id int, n long"
#: ``tile`` of these is the tile of COUNTS in the upper half and the number of the piece in the lower one.
TILES = "node_id long, feature_index int, tile long, value array<float>, class_id array<int>, n array<long>, total_class array<int>, total_n array<long>, last float, last_class int"
KEY = ["node_id", "feature_index", "tile"]


def ordered(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of floats (no NaN); both zeros have one."""
    bits = (values.astype(np.float32) + np.float32(0)).view(np.int32)
    return (bits ^ ((bits >> 31) & 0x7FFFFFFF)).astype(np.int64)


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination begins in sorted columns."""
    new = np.ones(len(columns[0]), dtype=bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _part(values: np.ndarray, features: int) -> tuple[np.ndarray, int]:
    """Where values are dealt, and how many parts there are: the upper bits of a product, even for values that are neighbours."""
    bits = max(1, (PARTS // features).bit_length() - 1)
    return ((ordered(values).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64), 1 << bits


def _packed(features: int, node: np.ndarray, feature: np.ndarray, of: np.ndarray, *counts: np.ndarray) -> pa.RecordBatch:
    """PACKED from tiles, values, classes and counts of a table of ``features``; ``of``: the place of each one's node and feature."""
    part, parts = _part(counts[1], features)
    key = of * parts + part
    key = key.astype(np.min_scalar_type(int(key.max())))
    order = np.argsort(key, kind="stable")
    at = runs(key[order])
    of, part = np.divmod(key[order[at]].astype(np.int64), parts)
    offsets = pa.array(np.append(at, len(order)).astype(np.int32))
    columns = [pa.array(x) for x in (node[of], feature[of], part.astype(np.int32), np.add.reduceat(counts[3][order], at))]
    columns += [pa.ListArray.from_arrays(offsets, pa.array(x[order])) for x in counts]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PACKED.split(", ")])


def _counted(nodes: np.ndarray, values: np.ndarray, classes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One batch for each feature, a column of ``values``."""
    distinct, rank = np.unique(nodes, return_inverse=True)
    for f in range(values.shape[1]):
        place = ordered(values[:, f])
        key = (rank.astype(np.int64) << 32) + (place + (1 << 31))
        order = np.lexsort((classes, key))
        key, c = key[order], classes[order]
        at = runs(key, c)
        some = order[at]
        n = np.diff(np.append(at, len(key)))
        yield _packed(values.shape[1], distinct, np.full(len(distinct), f, np.int32), rank[some], (place[some] >> 16).astype(np.int32), values[some, f] + np.float32(0), c[at].astype(np.int32), n.astype(np.int64))


def counted(rows: DataFrame) -> DataFrame:
    """rows(node_id, features, class_id) -> PACKED, for the rows of each task apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(1).flatten()
            if flat.null_count or len(flat) % batch.num_rows:
                raise ValueError("Features must be numbers.")
            values = flat.to_numpy(zero_copy_only=False).astype(np.float32).reshape(batch.num_rows, -1)
            held.append((batch.column(0).to_numpy().copy(), values, batch.column(2).to_numpy().copy()))  # no batch stays for its columns
            size += values.size
            if size >= AT_ONCE:
                yield from _counted(*(np.concatenate(c) for c in zip(*held)))
                held, size = [], 0
        if held:
            yield from _counted(*(np.concatenate(c) for c in zip(*held)))

    return rows.select(F.col("node_id").cast("long"), "features", F.col("class_id").cast("int")).mapInArrow(run, PACKED)


def dealt(counts: DataFrame, values: int, keys: list[str]) -> DataFrame:
    """By keys, into a task for each IN_ONE ``values``, at least as many as run at once; without a number given, small partitions would be merged by their compressed bytes."""
    tasks = -(-values // IN_ONE)
    return counts.repartition(*([max(tasks, counts.sparkSession.sparkContext.defaultParallelism)] if tasks > 1 else []), *keys)


def repacked(tiles: DataFrame, features: int) -> DataFrame:
    """PACKED from TILES of a table of ``features``: dealt as ``counted`` deals its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("value").offsets.to_numpy())
            upto = np.cumsum(sizes)
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] - sizes[lo] + AT_ONCE, side="right")))
                some = batch.slice(lo, hi - lo)
                node, feature, tile = (some.column(c).to_numpy() for c in KEY)
                at = runs(node, feature)
                of = np.repeat(np.repeat(np.arange(len(at)), np.diff(np.append(at, len(node)))), sizes[lo:hi])
                each = [some.column(c).flatten().to_numpy() for c in ("value", "class_id", "n")]
                yield _packed(features, node[at], feature[at], of, np.repeat((tile >> 32).astype(np.int32), sizes[lo:hi]), *each)
                lo = hi

    return tiles.select(*KEY, "value", "class_id", "n").mapInArrow(run, PACKED)


def summed(counts: DataFrame, values: int = 0) -> DataFrame:
    """COUNTS from PACKED of all tasks; what adds up to nothing is left out. ``values``: rows times features, about."""
    keys = [c.split()[0] for c in COUNTS.split(", ")[:-1]]
    part = ["node_id", "feature_index", "part"]
    entries = F.inline(F.arrays_zip("tile", "value", "class_id", F.col("each").alias("n")))
    found = dealt(counts.select(*part, "tile", "value", "class_id", "each"), values, part).select(*part, entries)
    return found.groupBy("part", *keys).agg(F.sum("n").alias("n")).filter("n <> 0").select(*keys, "n")


def tiled(counts: DataFrame, values: int = 0) -> DataFrame:
    """TILES from summed counts: one row a piece of a tile. ``values`` as above."""

    def packed(t: pa.Table) -> pa.RecordBatch:
        key = [t.column(c).to_numpy() for c in KEY]
        first = runs(*key)
        sizes = np.diff(np.append(first, t.num_rows))
        value, cls, n = (t.column(c).to_numpy() for c in ("value", "class_id", "n"))
        group = np.repeat(np.arange(len(first)), sizes)
        order = np.lexsort((cls, group))
        at = runs(group[order], cls[order])
        totals, of = np.add.reduceat(n[order], at), group[order][at]
        last = np.append(first[1:], t.num_rows) - 1
        offsets = pa.array(np.append(first, t.num_rows).astype(np.int32))
        total_offsets = pa.array(np.searchsorted(of, np.arange(len(first) + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (value, cls, n)]
        more = [pa.ListArray.from_arrays(total_offsets, pa.array(x)) for x in (cls[order][at], totals)]
        return pa.RecordBatch.from_arrays([*(pa.array(k[first]) for k in key), *lists, *more, pa.array(value[last]), pa.array(cls[last])], [c.split()[0] for c in TILES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        of, before = None, 0  # the tile of the batch before, and its entries so far
        for batch in batches:
            if not batch.num_rows:
                continue
            key = [batch.column(c).to_numpy() for c in KEY]
            first = runs(*key)
            place = np.arange(batch.num_rows) - np.repeat(first, np.diff(np.append(first, batch.num_rows)))
            if of == tuple(k[0] for k in key):
                place[: first[1] if len(first) > 1 else None] += before
            of, before = tuple(k[-1] for k in key), int(place[-1]) + 1
            key[2] = (key[2].astype(np.int64) << 32) + place // PIECE
            batch = pa.RecordBatch.from_arrays([*map(pa.array, key), *batch.columns[3:]], batch.schema.names)
            held.append(batch)
            last = int(runs(*key)[-1])  # the last piece may go on in the next batch
            if last:
                yield packed(pa.Table.from_batches([*held[:-1], batch.slice(0, last)]))
                held = [batch.slice(last)]
        if held:
            yield packed(pa.Table.from_batches(held))

    order = [*KEY, "value", "class_id"]
    return dealt(counts, values, KEY).sortWithinPartitions(*order).mapInArrow(run, TILES)


def counts_of(tiles: DataFrame, *more: str | Column) -> DataFrame:
    """Rows of COUNTS again, from the rows of tiles."""
    return tiles.select(*KEY[:2], F.shiftright("tile", 32).cast("int").alias("tile"), *more, F.inline(F.arrays_zip("value", "class_id", "n")))


def class_totals(tiles: DataFrame, *more: str) -> DataFrame:
    """node_id, feature_index, tile, class_id, n: totals of the tiles, without a look at their values."""
    return tiles.select(*KEY, *more, F.inline(F.arrays_zip(F.col("total_class").alias("class_id"), F.col("total_n").alias("n"))))


def child_counts(tiles: DataFrame, split: DataFrame, rows: DataFrame, nodes: int = FEW + 1, values: int = 0, features: int = 0) -> DataFrame:
    """Summed COUNTS of the growing children of ``split(node_id, feature_index, split_value, left_smaller, small_id, large_id)``.

    Of each node only the rows of its smaller child are counted; the larger one's
    counts are the node's, from its ``tiles``, less those. ``small_id`` or ``large_id``
    is null where that child does not grow. ``nodes``: how many rows ``split`` has, at most;
    ``values``: rows of the children times features; ``features``: how many, looked up if not given.
    """
    goes_left = F.element_at("features", F.col("feature_index") + 1) <= F.col("split_value")
    smaller = rows.join(few(split, nodes), "node_id").filter(goes_left == F.col("left_smaller"))
    ids = few(split.select("node_id", "small_id", "large_id"), nodes)
    new = counted(smaller.select("node_id", "features", "class_id")).join(ids, "node_id")
    both = F.array(F.struct(F.col("small_id").alias("node_id"), "each"), F.struct(F.col("large_id").alias("node_id"), F.transform("each", lambda n: -n).alias("each")))
    new = new.select("feature_index", "part", "tile", "value", "class_id", F.inline(both))
    parents = tiles.join(few(split.filter("large_id is not null").select("node_id", "large_id"), nodes), "node_id")
    old = repacked(parents.withColumn("node_id", F.col("large_id")), features or len((rows.first() or {"features": [0]})["features"]))
    return summed(new.unionByName(old.select(*new.columns)).filter("node_id is not null"), values)
