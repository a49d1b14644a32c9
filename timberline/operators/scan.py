"""Threshold candidates of tiles, scored as running sums over their sparse class counts.

Impurities are kept as sums over classes of a term of each count (its square, or
the count times its logarithm). A count that grows changes one term, so a value
costs as much as it has classes, however many classes there are. What precedes a
tile is given by numbers, and by the counts of the tile's own classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.operators.counts import KEY, class_totals, runs
from timberline.options import Impurity, Options, Selection
from timberline.tables import keep

#: Values and counts of tiles that are scored at once.
AT_ONCE = 1 << 17
CANDIDATES = "node_id long, feature_index int, tile long, threshold double, split_value float, n_left long, n_right long, gain double, split_info double, gain_ratio double, score double"
#: Of a candidate that may be chosen: what stays of the tile when the best are.
PLACE = "at_tile long"
BEFORE = ["before", "before_class", "n_before", "left_rest", "right_rest", "n_all", "all_rest"]


def _term(count: Column, kind: Impurity) -> Column:
    """As a decimal, so that sums of differences are exact."""
    size = count.cast("double")
    if kind is Impurity.Gini:
        return (size * size).cast("decimal(38,0)")
    return F.when(size > 0, size * F.log2(size)).otherwise(0.0).cast("decimal(38,18)")


def terms_of(count: np.ndarray, kind: Impurity) -> np.ndarray:
    """In extended precision, for small differences of large sums matter."""
    count = count.astype(np.longdouble)
    return count * count if kind is Impurity.Gini else count * np.log2(np.maximum(count, 1))


def weighted(n: np.ndarray, terms: np.ndarray, kind: Impurity) -> np.ndarray:
    """Rows times impurity, from the sum of all terms."""
    n = np.maximum(n.astype(np.longdouble), 1)
    return n - terms / n if kind is Impurity.Gini else n * np.log2(n) - terms


def gain_of(n_left: np.ndarray, n_right: np.ndarray, left: np.ndarray, right: np.ndarray, every: np.ndarray, kind: Impurity) -> np.ndarray:
    """Information gain from the rows and the sums of terms at both sides and of the node."""
    n_all = n_left + n_right
    if kind is Impurity.Entropy:
        return ((weighted(n_all, every, kind) - weighted(n_left, left, kind) - weighted(n_right, right, kind)) / n_all).astype(np.float64)
    # As one fraction, so that whole numbers stay exact as long as they fit.
    a, b, n = (np.maximum(x, 1).astype(np.longdouble) for x in (n_left, n_right, n_all))
    return ((n * (b * left + a * right) - a * b * every) / (n * n * a * b)).astype(np.float64)


def before_tiles(tiles: DataFrame, kind: Impurity) -> DataFrame:
    """For each tile what precedes it: KEY, BEFORE, and of its own classes the counts before it and of the node.

    Reads the totals of the tiles only. Counts before a tile are sums over the tiles
    of the same class, sums of terms over the tiles of the feature; neither
    has more rows than a feature has tiles, nor lists of classes in its rows.
    """
    of = ["node_id", "feature_index"]
    ends = F.struct("last", "last_class")
    totals = class_totals(tiles, ends.alias("end"))
    by_class = Window.partitionBy(*of, "class_id")
    earlier = by_class.orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns({"l": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "t": F.sum("n").over(by_class)})
    l, n, t = F.col("l"), F.col("n"), F.col("t")  # noqa: E741
    terms = {"left": _term(l, kind), "right": _term(t - l, kind), "all": _term(t, kind), "left_step": _term(l + n, kind) - _term(l, kind), "right_step": _term(t - l, kind) - _term(t - l - n, kind)}
    own = keep(totals.withColumns(terms).groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in (*terms, "n")], F.first("end").alias("end"), F.collect_list(F.struct("class_id", "l", "t")).alias("own")))
    whole = Window.partitionBy(*of)
    by_tile = whole.orderBy("tile")
    before = by_tile.rowsBetween(Window.unboundedPreceding, -1)
    # From the last tile down: a frame that ends with the partition is summed anew for each row.
    on = whole.orderBy(F.desc("tile")).rowsBetween(Window.unboundedPreceding, 0)
    # Of the sums over all classes, only what the tile's own classes do not give goes on.
    found = own.select(
        *KEY,
        F.lag("end").over(by_tile).alias("prior"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
        (F.coalesce(F.sum("left_step").over(before), F.lit(0)) - F.col("left")).cast("double").alias("left_rest"),
        (F.sum("right_step").over(on) - F.col("right")).cast("double").alias("right_rest"),
        F.sum("n").over(whole).alias("n_all"),
        (F.sum("right_step").over(whole) - F.col("all")).cast("double").alias("all_rest"),
    )
    found = found.select(*KEY, F.col("prior.last").alias("before"), F.col("prior.last_class").alias("before_class"), *BEFORE[2:])
    return found.join(own.select(*KEY, *[F.col(f"own.{c}").alias(f"own_{c}") for c in ("class_id", "l", "t")]), KEY)


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def scored(batch: pa.RecordBatch, o: Options, every: bool) -> pa.RecordBatch | None:
    """The candidates of tiles with what precedes them: all, or those that may be the best of their node and feature."""
    column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
    value, sizes = _flat(batch.column("value"))
    cls, n = _flat(batch.column("class_id"))[0].astype(np.int64), _flat(batch.column("n"))[0]
    own, own_sizes = _flat(batch.column("own_class_id"))
    own_l, own_t = _flat(batch.column("own_l"))[0], _flat(batch.column("own_t"))[0]
    tile = np.repeat(np.arange(batch.num_rows), sizes)
    start = np.cumsum(sizes) - sizes
    k = int(max(cls.max(), own.max())) + 1
    # Counts before each entry: of the tiles before, and of the same class earlier in the tile.
    key = tile * k + cls
    order = np.argsort(key, kind="stable")
    so_far = np.cumsum(n[order]) - n[order]
    first = runs(key[order])
    within = np.empty(len(n), dtype=np.int64)
    within[order] = so_far - np.repeat(so_far[first], np.diff(np.append(first, len(n))))
    own_key = np.repeat(np.arange(batch.num_rows), own_sizes) * k + own
    own_order = np.argsort(own_key)
    found = own_order[np.searchsorted(own_key[own_order], key)]
    left = own_l[found] + within
    right = own_t[found] - left

    def running(step: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Sums before each entry, from what precedes its tile on."""
        before = np.cumsum(step) - step
        return before - before[start][tile] + base[tile]

    kind = o.impurity
    own_start = np.cumsum(own_sizes) - own_sizes
    base = lambda rest, count: column(rest).astype(np.longdouble) + np.add.reduceat(terms_of(count, kind), own_start)
    n_left = running(n, column("n_before").astype(np.int64))
    left_terms = running(terms_of(left + n, kind) - terms_of(left, kind), base("left_rest", own_l))
    right_terms = running(terms_of(right - n, kind) - terms_of(right, kind), base("right_rest", own_t - own_l))
    all_terms = base("all_rest", own_t)
    at = runs(tile, value)  # the first entry of each value, which has its least class
    inner = np.zeros(len(at), dtype=bool)
    inner[1:] = tile[at[1:]] == tile[at[:-1]]
    before, before_class = column("before").astype(np.float32)[tile[at]], column("before_class")[tile[at]].astype(np.float64)
    before[inner], before_class[inner] = value[at[np.flatnonzero(inner) - 1]], cls[at[inner] - 1]
    n_all = column("n_all").astype(np.int64)[tile[at]]
    n_left = n_left[at]
    n_right = n_all - n_left
    ok = ~np.isnan(before)
    with np.errstate(invalid="ignore", over="ignore"):
        ok &= np.abs(before - value[at]).astype(np.float64) >= o.epsilon
        threshold = (before + value[at]).astype(np.float64) / 2.0
    if o.candidates == "adjacent":
        ok &= before_class != cls[at]
    least = max(1, o.min_samples_per_leaf)
    ok &= (n_left >= least) & (n_right >= least)
    ratio = o.selection is not Selection.MaxGain
    gain = gain_of(n_left, n_right, left_terms[at], right_terms[at], all_terms[tile[at]], kind)
    ok &= gain > o.epsilon
    info = weighted(n_all, terms_of(n_left, Impurity.Entropy) + terms_of(n_right, Impurity.Entropy), Impurity.Entropy) / n_all if ratio else np.zeros(len(at))
    info = info.astype(np.float64)
    if ratio:
        ok &= info > o.epsilon
    gain_ratio = np.where(ok, gain / np.where(info > 0, info, 1.0), 0.0) if ratio else np.zeros(len(at))
    score = gain_ratio if ratio else gain
    if not every and ok.any():
        top = np.full(batch.num_rows, -np.inf)
        np.maximum.at(top, tile[at[ok]], score[ok])
        ok &= score >= top[tile[at]] - o.epsilon
        if not ratio:  # behind a candidate of a lower threshold that scores as much, none is chosen
            best, of = -np.inf, -1
            for i in np.flatnonzero(ok).tolist():
                if tile[at[i]] != of:
                    best, of = -np.inf, tile[at[i]]
                ok[i] = score[i] > best
                best = max(best, score[i])
    pick = np.flatnonzero(ok)
    if not len(pick):
        return None
    rows = tile[at[pick]]
    out = [*(column(c)[rows] for c in KEY), threshold[pick], before[pick], n_left[pick], n_right[pick], gain[pick], info[pick], gain_ratio[pick], score[pick]]
    arrays, names = [pa.array(x) for x in out], [c.split()[0] for c in CANDIDATES.split(", ")]
    if not every:
        arrays.append(arrays[2])
        names.append(PLACE.split()[0])
    return pa.RecordBatch.from_arrays(arrays, names)


def tile_candidates(tiles: DataFrame, options: Options, every: bool = False) -> DataFrame:
    """CANDIDATES of all tiles; unless ``every``, those that may be chosen, with PLACE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(np.diff(batch.column("value").offsets.to_numpy()))
            lo = 0
            while lo < batch.num_rows:
                done = sizes[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(sizes, done + AT_ONCE, side="right")))
                if (found := scored(pa.RecordBatch.from_arrays([_whole(c) for c in batch.slice(lo, hi - lo).columns], batch.schema.names), options, every)) is not None:
                    yield found
                lo = hi

    def _whole(c: pa.Array) -> pa.Array:
        """A slice with offsets of its own."""
        return pa.concat_arrays([c])

    swept = tiles.drop("total_class", "total_n", "last", "last_class").join(before_tiles(tiles, options.impurity), KEY)
    return swept.mapInArrow(run, CANDIDATES if every else f"{CANDIDATES}, {PLACE}")
