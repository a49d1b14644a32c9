"""The registered queries of the tree engine, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timberline.functions.impurity import impurity, pessimistic_errors, total
from timberline.operators.encode import class_counts, class_mapping, encode, joined
from timberline.operators.grow import fit, grow, tiles_of
from timberline.operators.model import Tree
from timberline.operators.predict import evaluate, predict
from timberline.operators.prune import prune
from timberline.operators.render import Box, layout, parse_text, tree_text
from timberline.operators.scan import tile_candidates
from timberline.operators.select import best_per_feature, best_split, mean_gain_filter
from timberline.operators.sweep import boundaries, partition_measures, value_histogram
from timberline.options import C45, CART, Impurity, Options, Pruning
from timberline.plans import sql
from timberline.plans.data import DATA, Data
from timberline.sources import dataset_summary, load_inferred, load_positional
from timberline.tables import keep, new_place

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, spark_query: Query, oracle: str | None) -> None:
    QUERIES[name] = spark_query
    if oracle:
        SQL[name] = oracle


def _labels(df: DataFrame) -> list[str]:
    return [r[0] for r in class_mapping(df).orderBy("class_id").collect()]


def _rows(data: Data, spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    df = data.load(spark, sf_dir)
    labels = _labels(df)
    return encode(df, labels).withColumn("node_id", F.lit(0).cast("long")), labels


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Class dictionaries, histograms, impurities.


def _mapping(table: str, column: str) -> None:
    _add(
        f"class_mapping_{column}",
        lambda s, d: class_mapping(_table(s, d, table), column),
        f"SELECT {column} AS label, (row_number() OVER (ORDER BY {column}) - 1)::INT AS class_id FROM (SELECT DISTINCT {column} FROM {table})",
    )


for _t, _c in (("lineitem", "l_returnflag"), ("customer", "c_mktsegment"), ("orders", "o_orderpriority")):
    _mapping(_t, _c)


def _counted(spark: SparkSession, sf_dir: str, table: str, group: str, label: str) -> tuple[DataFrame, int]:
    df = _table(spark, sf_dir, table)
    labels = [r[0] for r in class_mapping(df, label).orderBy("class_id").collect()]
    ids = F.create_map(*[x for i, v in enumerate(labels) for x in (F.lit(v), F.lit(i))])
    return df.withColumn("class_id", ids[F.col(label)]).groupBy(F.col(group).alias("grp")).agg(F.min("class_id").alias("lo"), F.max("class_id").alias("hi"), F.min(label).alias("least"), *class_counts(len(labels))), len(labels)


def class_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(spark, sf_dir, "orders", "o_orderpriority", "o_orderstatus")[0].drop("lo", "hi", "least")


_add("class_counts", class_counts_query, "SELECT o_orderpriority AS grp, " + ", ".join(f"count(*) FILTER (k = {i}) AS c{i}" for i in range(3)) + " FROM (SELECT *, dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS k FROM orders) GROUP BY 1")


def purity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(spark, sf_dir, "events", "user_id", "event_type")[0].select("grp", (F.col("lo") == F.col("hi")).alias("pure"))


_add("purity_check", purity_check, "SELECT user_id AS grp, min(event_type) = max(event_type) AS pure FROM events GROUP BY 1")


def majority_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("grp"), F.col("event_type").alias("label")).count()
    return counts.groupBy("grp").agg(F.min(F.struct((-F.col("count")).alias("n"), "label")).alias("m")).select("grp", "m.label", (-F.col("m.n")).alias("n"))


_add("majority_label", majority_label, "SELECT user_id AS grp, label, n FROM (SELECT user_id, event_type AS label, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS k FROM events GROUP BY 1, 2) WHERE k = 1")


def _impurity_by_group(kind: Impurity) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _table(spark, sf_dir, "lineitem").withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
        labels = [r[0] for r in class_mapping(df, "l_returnflag").orderBy("class_id").collect()]
        ids = F.create_map(*[x for i, v in enumerate(labels) for x in (F.lit(v), F.lit(i))])
        counts = df.withColumn("class_id", ids[F.col("l_returnflag")]).groupBy("month", "l_linestatus").agg(*class_counts(len(labels)))
        cs = [F.col(f"c{i}") for i in range(len(labels))]
        return counts.select("month", "l_linestatus", total(cs).alias("n"), F.round(impurity(cs, kind), 9).alias("impurity"))

    return run


for _k in Impurity:
    _add(
        f"{_k.value.lower()}_by_group",
        _impurity_by_group(_k),
        f"SELECT month, l_linestatus, c0 + c1 + c2 AS n, round({sql.impurity(['c0', 'c1', 'c2'], _k)}, 9) AS impurity FROM (SELECT strftime(l_shipdate, '%Y-%m') AS month, l_linestatus, "
        + ", ".join(f"count(*) FILTER (k = {i}) AS c{i}" for i in range(3))
        + " FROM (SELECT *, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS k FROM lineitem) GROUP BY 1, 2)",
    )


def _measures(part: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _table(spark, sf_dir, "lineitem")
        if part.startswith("o_"):
            df = df.join(_table(spark, sf_dir, "orders").select("o_orderkey", part), F.col("l_orderkey") == F.col("o_orderkey"))
        labels = [r[0] for r in class_mapping(df, "l_returnflag").orderBy("class_id").collect()]
        out = [partition_measures(df, part, labels, "l_returnflag", k) for k in (Impurity.Entropy, Impurity.Gini)]
        return out[0].select("parts", "n", F.round("gain", 9).alias("entropy_gain"), F.round("split_info", 9).alias("split_info")).join(out[1].select("parts", F.round("gain", 9).alias("gini_gain")), "parts")

    return run


for _name, _part, _from in (("two_way", "l_linestatus", "lineitem"), ("five_way", "o_orderpriority", "lineitem JOIN orders ON l_orderkey = o_orderkey")):
    _g, _a = ["g.c0", "g.c1", "g.c2"], ["a.c0", "a.c1", "a.c2"]
    _add(
        f"partition_gain_{_name}",
        _measures(_part),
        "WITH t AS (SELECT *, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS k FROM " + _from + "), "
        + f"g AS (SELECT {_part} AS p, count(*) AS n, " + ", ".join(f"count(*) FILTER (k = {i}) AS c{i}" for i in range(3)) + " FROM t GROUP BY 1), "
        + "a AS (SELECT count(*) AS parts, sum(n)::BIGINT AS n, sum(c0)::BIGINT AS c0, sum(c1)::BIGINT AS c1, sum(c2)::BIGINT AS c2 FROM g) "
        + f"SELECT parts, a.n AS n, round({sql.impurity(_a, Impurity.Entropy)} - (SELECT sum(g.n::DOUBLE / a.n * {sql.impurity(_g, Impurity.Entropy)}) FROM g), 9) AS entropy_gain, "
        + f"round({sql.impurity(_a, Impurity.Gini)} - (SELECT sum(g.n::DOUBLE / a.n * {sql.impurity(_g, Impurity.Gini)}) FROM g), 9) AS gini_gain, "
        + "round((SELECT -sum(g.n::DOUBLE / a.n * log2(g.n::DOUBLE / a.n)) FROM g), 9) AS split_info FROM a",
    )

# Sweeps.


def _histogram(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, labels = _rows(DATA[name], spark, sf_dir)
        return value_histogram(rows, len(labels)).drop("node_id")

    return run


def _bounds(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, labels = _rows(DATA[name], spark, sf_dir)
        k = len(labels)
        found = boundaries(value_histogram(rows, k), k)
        found = found.filter((F.abs(F.col("before") - F.col("value")) >= 1e-9) & (F.col("before_class") != F.col("min_class")))
        return found.select("feature_index", ((F.col("before") + F.col("value")).cast("double") / 2.0).alias("threshold"), "before", "value", *[f"l{i}" for i in range(k)])

    return run


def _sql_bounds(name: str) -> str:
    data = DATA[name]
    below = ", ".join(f"l{i}" for i in range(data.classes))
    return sql.query([*sql.rows(data), *sql.histogram(data, 0), *sql.sweep(data, 0, CART)], f"SELECT fi AS feature_index, (pv + v)::DOUBLE / 2.0 AS threshold, pv AS before, v AS value, {below} FROM w0 WHERE abs(pv - v) >= 1e-9 AND pmx <> mn")


for _n in ("part", "events", "lineitem"):
    _cs = ", ".join(f"c{i}" for i in range(DATA[_n].classes))
    _add(f"value_histogram_{_n}", _histogram(_n), sql.query([*sql.rows(DATA[_n]), *sql.histogram(DATA[_n], 0)], f"SELECT fi AS feature_index, v AS value, mn AS min_class, mx AS max_class, {_cs} FROM h0"))
    _add(f"threshold_candidates_{_n}", _bounds(_n), _sql_bounds(_n))


def tiled_prefix_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts below each value, from its tile and the totals that the tile was handed, with the tile's number."""
    rows, labels = _rows(DATA["lineitem"], spark, sf_dir)
    k = len(labels)
    found = boundaries(value_histogram(rows, k), k)
    return found.select("feature_index", "tile", "before", "value", *[f"l{i}" for i in range(k)], *[f"t{i}" for i in range(k)])


_TILE = "(CASE WHEN v < 0 THEN -1 ELSE 1 END * CASE WHEN v = 0 THEN 0 ELSE (floor(log2(abs(v::DOUBLE))) + 200) * 128 + floor((abs(v::DOUBLE) / power(2.0::DOUBLE, floor(log2(abs(v::DOUBLE)))) - 1) * 128) END)::INT"
_add("tiled_prefix_histogram", tiled_prefix_histogram, sql.query([*sql.rows(DATA["lineitem"]), *sql.histogram(DATA["lineitem"], 0), *sql.sweep(DATA["lineitem"], 0, CART)], f"SELECT fi AS feature_index, {_TILE} AS tile, pv AS before, v AS value, l0, l1, l2, t0, t1, t2 FROM w0 WHERE pv IS NOT NULL"))

_OPTIONS = {"cart": CART, "c45": C45}
_MEASURES = ("gain", "split_info", "gain_ratio")


def _scored(name: str, o: Options, spark: SparkSession, sf_dir: str, every: bool = False) -> DataFrame:
    """Candidates of the whole table: all, or those that may be chosen."""
    df = DATA[name].load(spark, sf_dir)
    rows = joined(df, keep(class_mapping(df))).withColumn("node_id", F.lit(0).cast("long"))
    return tile_candidates(tiles_of(rows, df.count() * len(DATA[name].features)), o, every)


def _shown(df: DataFrame) -> DataFrame:
    return df.select("feature_index", "threshold", "n_left", "n_right", *[F.round(m, 9).alias(m) for m in _MEASURES])


def _sql_shown(name: str, o: Options, table: str) -> str:
    return sql.query([*sql.rows(DATA[name]), *sql.level(DATA[name], o)], f"SELECT fi AS feature_index, threshold, nl AS n_left, nr AS n_right, round(gain, 9) AS gain, round(si, 9) AS split_info, round(gr, 9) AS gain_ratio FROM {table}")


def _sweep_queries(name: str, mode: str, o: Options) -> None:
    _add(f"score_candidates_{name}_{mode}", lambda s, d: _shown(_scored(name, o, s, d, True)), _sql_shown(name, o, "s0"))
    _add(f"best_threshold_per_feature_{name}_{mode}", lambda s, d: _shown(best_per_feature(_scored(name, o, s, d), o)), _sql_shown(name, o, "pf0"))
    _add(f"best_split_root_{name}_{mode}", lambda s, d: _shown(best_split(best_per_feature(_scored(name, o, s, d), o), o)), _sql_shown(name, o, "b0"))


for _n in ("lineitem", "part", "embeddings", "quality", "orders"):
    for _m, _o in _OPTIONS.items():
        _sweep_queries(_n, _m, _o)

_add("mean_gain_filter", lambda s, d: _shown(mean_gain_filter(best_per_feature(_scored("embeddings", C45, s, d), C45), C45)), _sql_shown("embeddings", C45, "mg0"))
_LEAF = replace(CART, min_samples_per_leaf=200)
_add("min_samples_per_leaf_split", lambda s, d: _shown(best_split(best_per_feature(_scored("events", _LEAF, s, d), _LEAF), _LEAF)), _sql_shown("events", _LEAF, "b0"))
_ALL = replace(CART, candidates="all")
_add("best_split_all_boundaries", lambda s, d: _shown(best_split(best_per_feature(_scored("band", _ALL, s, d), _ALL), _ALL)), _sql_shown("band", _ALL, "b0"))
_ENTROPY_MAX, _GINI_RATIO = replace(CART, impurity=Impurity.Entropy), replace(C45, impurity=Impurity.Gini)
_add("best_split_entropy_max_gain", lambda s, d: _shown(best_split(best_per_feature(_scored("band", _ENTROPY_MAX, s, d), _ENTROPY_MAX), _ENTROPY_MAX)), _sql_shown("band", _ENTROPY_MAX, "b0"))
_add("best_split_gini_gain_ratio", lambda s, d: _shown(best_split(best_per_feature(_scored("band", _GINI_RATIO, s, d), _GINI_RATIO), _GINI_RATIO)), _sql_shown("band", _GINI_RATIO, "b0"))

# Growth, prediction, pruning.


def _tree(name: str, o: Options, spark: SparkSession, sf_dir: str) -> Tree:
    """Grown by levels to the end, whatever the size of the table."""
    return fit(DATA[name].load(spark, sf_dir), replace(o, finish_rows=0))


def _nodes(tree: Tree, spark: SparkSession) -> DataFrame:
    return tree.to_df(spark).select("path", "depth", "is_leaf", "feature_index", "threshold", "leaf_label", "sample_count")


def _sql_nodes(source: str, cuts: bool = False) -> str:
    leaf = "is_leaf" if cuts else "fi IS NULL"
    return f"SELECT path, depth, {leaf} AS is_leaf, fi AS feature_index, threshold, CASE WHEN {leaf} THEN label END AS leaf_label, n AS sample_count FROM {source} JOIN classes ON class_id = major"


for _n in ("band", "embeddings"):
    for _m, _o in _OPTIONS.items():
        _deep = replace(_o, max_depth=3 if _n == "band" else 2)
        _add(f"tree_nodes_{_n}_{_m}", lambda s, d, n=_n, o=_deep: _nodes(_tree(n, o, s, d), s), sql.query(sql.grown(DATA[_n], _deep), _sql_nodes("nodes")))

_FINISHED = replace(CART, max_depth=3, finish_rows=20_000)
_add("tree_nodes_band_finished_in_tasks", lambda s, d: _nodes(fit(DATA["band"].load(s, d), _FINISHED), s), SQL["tree_nodes_band_cart"])


def _many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three levels of a tree on as many classes as there are customers with orders."""
    table = grow(DATA["customers"].load(spark, sf_dir), replace(CART, max_depth=2, finish_rows=0))
    of = F.array_min(F.zip_with("n", "class_id", lambda n, c: F.struct((-n).alias("n"), c.alias("c"))))["c"]
    leaves = table.nodes.withColumn("class_id_of", of).join(table.labels.select(F.col("class_id").alias("class_id_of"), "label"), "class_id_of")
    rows = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)
    return leaves.select("path", "depth", F.col("feature_index").isNull().alias("is_leaf"), "feature_index", "threshold", F.when(F.col("feature_index").isNull(), F.col("label")).alias("leaf_label"), rows.alias("sample_count"), F.size("class_id").alias("classes"))


_add("tree_nodes_many_classes", _many, sql.many_classes(DATA["customers"], 2))

_D1, _D3 = replace(CART, max_depth=1), replace(CART, max_depth=3)
_add("grow_level1", lambda s, d: _nodes(_tree("lineitem", _D1, s, d), s), sql.query(sql.grown(DATA["lineitem"], _D1), _sql_nodes("nodes")))


def partition_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = DATA["band"]
    split = best_split(best_per_feature(_scored("band", CART, spark, sf_dir), CART), CART).first()  # one row
    value = F.col(data.features[split["feature_index"]])
    return data.load(spark, sf_dir).groupBy(F.when(value <= F.lit(split["threshold"]), "yes").otherwise("no").alias("side"), "label").agg(F.count("*").alias("n"))


_band = DATA["band"]
_value = "CASE b.fi " + " ".join(f"WHEN {f} THEN f{f}" for f in range(4)) + " END"
_add("partition_rows", partition_rows, sql.query([*sql.rows(_band), *sql.level(_band, CART)], f"SELECT CASE WHEN {_value} <= b.threshold THEN 'yes' ELSE 'no' END AS side, label, count(*) AS n FROM r0 JOIN classes USING (class_id), b0 b GROUP BY 1, 2"))


def predict_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _tree("band", _D3, spark, sf_dir)
    return predict(_band.load(spark, sf_dir), tree).groupBy("label", "prediction").agg(F.count("*").alias("n"))


_ROUTED = [*sql.grown(_band, _D3), *sql.routed(_band, _D3)]
_add("predict_confusion", predict_query, sql.query(_ROUTED, "SELECT a.label, p.label AS prediction, count(*) AS n FROM routed r JOIN nodes ON nodes.path = r.path JOIN classes a ON a.class_id = r.class_id JOIN classes p ON p.class_id = nodes.major GROUP BY 1, 2"))


def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(_band.load(spark, sf_dir), _tree("band", _D3, spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 6))


_add("accuracy", accuracy, sql.query(_ROUTED, "SELECT count(*) AS checked, count(*) FILTER (r.class_id = major) AS correct, round(100.0 * count(*) FILTER (r.class_id = major) / count(*)::DOUBLE, 6) AS accuracy, (SELECT max(depth) FROM nodes)::INT AS depth, (SELECT count(*) FROM nodes)::INT AS node_count, (SELECT count(*) FROM nodes WHERE fi IS NULL)::INT AS leaf_count FROM routed r JOIN nodes USING (path)"))


def pessimistic_error_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count(F.when(F.col("o_orderstatus") != "F", 1)).alias("e"))
    grid = orders.select("n", "e").distinct().withColumn("factor", F.explode(F.array(*map(F.lit, (0.0005, 0.1, 0.25, 0.5)))))
    return grid.withColumn("errors", F.round(pessimistic_errors(F.col("n"), F.col("e"), F.col("factor")), 4))


_add(
    "pessimistic_error_grid",
    pessimistic_error_grid,
    "WITH g AS (SELECT DISTINCT n, e FROM (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus <> 'F') AS e FROM orders GROUP BY 1)) "
    + " UNION ALL ".join(f"SELECT n, e, {f}::DOUBLE AS factor, round({sql.pessimistic('n', 'e', f)}, 4) AS errors FROM g" for f in (0.0005, 0.1, 0.25, 0.5)),
)

_PRUNED = {"pessimistic": replace(_D3, pruning=Pruning.PessimisticError), "cost_complexity": replace(_D3, pruning=Pruning.CostComplexity, ccp_alpha=300.0)}
for _m, _o in _PRUNED.items():
    _add(f"prune_{_m}", lambda s, d, o=_o: _nodes(_tree("band", o, s, d), s), sql.query([*_ROUTED, *sql.pruned(_band, _o, _m)], _sql_nodes("kept", True)))
_P1 = replace(CART, max_depth=2, pruning=Pruning.PessimisticError)
_add("prune_pessimistic_noise", lambda s, d: _nodes(_tree("orders", _P1, s, d), s), sql.query([*sql.grown(DATA["orders"], _P1), *sql.routed(DATA["orders"], _P1), *sql.pruned(DATA["orders"], _P1, "pessimistic")], _sql_nodes("kept", True)))


def prune_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grown tree pruned afterwards, by the public call."""
    return _nodes(prune(_tree("band", _D3, spark, sf_dir), _band.load(spark, sf_dir), _PRUNED["cost_complexity"]), spark)


_add("prune_after_fit", prune_again, SQL["prune_cost_complexity"])

# Text and layout.


def tree_text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tree_text(_tree("band", _D3, spark, sf_dir)).split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "line int, text string")


_EDGE = "CASE WHEN path = '' THEN 'ROOT' WHEN right(path, 1) = 'L' THEN 'yes' ELSE 'no' END"
_NAME = "CASE fi " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(_band.features)) + " END"
_ORDER = "row_number() OVER (ORDER BY path)"
_add(
    "tree_text",
    tree_text_query,
    sql.query(sql.grown(_band, _D3), f"SELECT ({_ORDER} - 1)::INT AS line, repeat('  ', depth::INT) || {_EDGE} || ' [n=' || n || ']: ' || CASE WHEN fi IS NULL THEN 'Leaf -> ' || label ELSE 'if ' || {_NAME} || ' <= ' || printf('%.3f', threshold) END AS text FROM nodes JOIN classes ON class_id = major"),
)


def tree_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes: list[Box] = layout(parse_text(tree_text(_tree("band", _D3, spark, sf_dir)).split("\n")))
    return spark.createDataFrame([(b.path, b.depth, b.edge, b.title, b.count, b.is_leaf, float(b.x), float(b.y)) for b in boxes], "path string, depth int, edge string, title string, n long, is_leaf boolean, x double, y double")


_add(
    "tree_layout",
    tree_layout,
    sql.query(
        [
            *sql.grown(_band, _D3),
            f"leaf AS (SELECT path, 40 + 190.0::DOUBLE * ({_ORDER} - 1) AS x FROM nodes WHERE fi IS NULL)",
            *[f"x{d} AS (SELECT * FROM leaf WHERE length(path) = {d}" + (f" UNION ALL SELECT n.path, (l.x + r.x) / 2 FROM nodes n JOIN x{d + 1} l ON l.path = n.path || 'L' JOIN x{d + 1} r ON r.path = n.path || 'R' WHERE n.depth = {d})" if d < 3 else ")") for d in (3, 2, 1, 0)],
            "xs AS (" + " UNION ALL ".join(f"SELECT * FROM x{d}" for d in range(4)) + ")",
        ],
        f"SELECT path, depth, {_EDGE} AS edge, CASE WHEN fi IS NULL THEN 'Leaf: ' || label ELSE {_NAME} || ' <= ' || printf('%.3f', threshold) END AS title, n, fi IS NULL AS is_leaf, x, (40 + 130 * depth)::DOUBLE AS y FROM nodes JOIN classes ON class_id = major JOIN xs USING (path)",
    ),
)


def tree_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _tree("band", _D3, spark, sf_dir).to_df(spark)
    parents = nodes.select(F.col("node_id").alias("parent_id"), F.col("path").alias("parent"))
    return nodes.join(parents, "parent_id").select("parent", F.col("path").alias("child"), "edge")


_add("tree_edges", tree_edges, sql.query(sql.grown(_band, _D3), f"SELECT path[:-2] AS parent, path AS child, {_EDGE} AS edge FROM nodes WHERE depth > 0"))

# Sources: the given tables written as CSV and read again.


def _as_csv(df: DataFrame) -> str:
    path = new_place(df.sparkSession, "csv-")
    df.write.option("header", True).csv(path)
    return path


def csv_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", F.regexp_replace("p_type", ",", " ").alias("p_type"))
    return load_positional(spark, _as_csv(part))


_add("csv_positional", csv_positional, "SELECT p_size::FLOAT AS p_size, p_retailprice::FLOAT AS p_retailprice, replace(p_type, ',', ' ') AS label FROM part")


def csv_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("Id"), "o_totalprice", "o_custkey", F.when(F.col("o_custkey") % 7 == 0, "NA").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"), F.col("o_orderstatus").alias("Outcome"))
    return load_inferred(spark, _as_csv(orders))


_add("csv_inferred", csv_inferred, "SELECT o_totalprice, o_custkey::DOUBLE AS o_custkey, o_orderstatus AS label FROM orders WHERE o_custkey % 7 <> 0")


def summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset_summary(_table(spark, sf_dir, "part").select("p_partkey", "p_size", F.col("p_type").alias("label")), ["p_partkey"])


_add("dataset_summary", summary_query, "SELECT count(*) AS n_rows, 'p_size' AS features, arg_min('p_size=' || p_size || ' label=' || p_type, p_partkey) AS first_row FROM part")


def class_rank_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of each group by how often they occur."""
    counts = _table(spark, sf_dir, "lineitem").groupBy("l_linestatus", "l_returnflag").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("l_linestatus").orderBy(F.desc("n"), "l_returnflag")))


_add("class_rank", class_rank_window, "SELECT l_linestatus, l_returnflag, n, row_number() OVER (PARTITION BY l_linestatus ORDER BY n DESC, l_returnflag)::INT AS place FROM (SELECT l_linestatus, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2)")
