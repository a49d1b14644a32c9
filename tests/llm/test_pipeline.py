"""The pipeline's stages, and its result against the same steps in plain Python."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from timberline.llm.common import keep
from timberline.llm.packing import pieces

from tests.llm.test_dedup import plain_groups
from tests.test_queries import TABLES as SMALL

TABLES = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="no test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, str(TABLES)))
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    good = seen["quality"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{TABLES}/labels.parquet").collect()}
    kept = {r.doc_id for r in good}
    assert sum(i in kept for i, q in labels.items() if q) >= 0.95 * sum(labels.values())
    first = {}
    for r in sorted(good, key=lambda r: r.doc_id):
        first.setdefault(" ".join((r.text or "").encode().decode().split()), r.doc_id)
    assert {r.doc_id for r in seen["exact_dedup"]} == set(first.values())
    groups = plain_groups([(r.doc_id, r.text) for r in seen["exact_dedup"]], 5, 80)
    assert {r.doc_id for r in seen["near_dedup"]} == {i for i, (_, c) in groups.items() if i == c}
    assert {r.doc_id for r in seen["mixture"]} <= {r.doc_id for r in seen["near_dedup"]}
    assert max(sum(1 for r in seen["mixture"] if r.doc_id == i) for i in {r.doc_id for r in seen["mixture"]}) <= 3
    mixed = spark.createDataFrame(seen["mixture"], docs.sparkSession.read.parquet(f"{TABLES}/documents.parquet").schema)
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, seen["packing"])) == sorted(map(key, pieces(mixed).collect()))
    assert entry.queries()["pipeline"](spark, str(TABLES)).count() == len(seen["packing"])


@pytest.mark.parametrize("name", ["op5_exact_dedup", "op8_chat_snapshots", "op10_curriculum_mix"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    df = entry.queries()[name](spark, str(SMALL))
    order = sorted(df.columns)
    result = con.execute(f"SELECT {', '.join(order)} FROM ({entry.oracle_sql()[name].strip()})").fetchall()
    plain = lambda rows: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    assert plain(map(tuple, df.select(order).collect())) == plain(result)
