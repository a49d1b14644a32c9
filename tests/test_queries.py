"""Registered queries against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = Path("/root/testdata/sf0.001")
SOME = ["tree_nodes_many_classes", "tree_nodes_band_finished_in_tasks", "score_candidates_part_c45", "class_mapping_l_returnflag", "entropy_by_group", "partition_gain_five_way", "threshold_candidates_part", "best_split_root_embeddings_c45", "min_samples_per_leaf_split", "prune_cost_complexity", "prune_pessimistic", "tree_text", "tree_layout", "csv_positional", "csv_inferred"]


def plain(value):
    return round(float(value), 6) if isinstance(value, float) else value


def compare(spark, name):
    con = duckdb.connect()
    for path in TABLES.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    result = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    df = entry.queries()[name](spark, str(TABLES))
    order = sorted(df.columns)
    assert order == sorted(columns)
    ours = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in result.fetchall()), key=repr)
    assert ours == theirs


@pytest.mark.skipif(not TABLES.exists(), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_same_as_sql(spark, name):
    compare(spark, name)


@pytest.mark.skipif(not TABLES.exists(), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
