"""Exact deduplication with a heavy-hitter split.

Texts are equal when they are identical after each run of ASCII white space
became one space. A Misra-Gries summary finds frequent digests; their groups
are counted with map-side aggregation and the winners, at most ``heavy`` rows,
are broadcast, so a hot digest is never shuffled. Other digests are grouped by
an ordinary shuffle, where no group holds more than about 1/heavy of all rows.

Defined cases: a null text is an empty text. Of equal rows the smallest id
stays; null ids come last; of rows repeated with the same id exactly one stays.
An empty table gives an empty result. In :func:`exact_groups` input columns
named like an output are replaced; :func:`exact_dedup` keeps all columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import GAP, fresh, keep, text_of

#: Frequent digests that are broadcast at most.
HEAVY = 256


def digest(text: str) -> Column:
    return F.unhex(F.sha2(F.regexp_replace(text_of(text), GAP, " "), 256))


def misra_gries(counts: dict, more: dict, counters: int) -> dict:
    """Merge two summaries; a value with over 1/(counters+1) of all items remains."""
    for k, v in more.items():
        counts[k] = counts.get(k, 0) + v
    if len(counts) > counters:
        cut = sorted(counts.values(), reverse=True)[counters]
        counts = {k: v - cut for k, v in counts.items() if v > cut}
    return counts


def frequent(df: DataFrame, value: str, heavy: int = HEAVY) -> DataFrame:
    """At most ``heavy`` values; each value with more than 2/heavy of all rows is among them."""
    counters = 4 * heavy

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        for b in batches:
            got = b.column(0).value_counts()
            counts = misra_gries(counts, dict(zip(got.field(0).to_pylist(), got.field(1).to_pylist())), counters)
        yield pa.RecordBatch.from_arrays([pa.array(counts, pa.binary()), pa.array(counts.values(), pa.int64())], ["value", "n"])

    parts = df.select(value).mapInArrow(summarise, "value binary, n long")
    return parts.groupBy("value").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "value").limit(heavy).select("value")


def grouped(keyed: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """keyed(__row, __id, __digest) with keep_id, group_size and kept."""
    spark = keyed.sparkSession
    hot = spark.createDataFrame(frequent(keyed, "__digest", heavy).collect(), "__digest binary")  # at most `heavy` rows
    group = lambda df: df.groupBy("__digest").agg(
        F.min(F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__row").alias("row"))).alias("__first"), F.count("*").alias("group_size")
    )
    winners = group(keyed.join(F.broadcast(hot), "__digest", "left_semi"))
    rest = keyed.join(F.broadcast(hot), "__digest", "left_anti")
    both = keyed.join(F.broadcast(winners), "__digest").unionByName(rest.join(group(rest), "__digest"))
    return both.select("__row", "__id", "__digest", F.col("__first.id").alias("keep_id"), "group_size", (F.col("__first.row") == F.col("__row")).alias("kept"))


def exact_groups(df: DataFrame, id: str = "doc_id", text: str = "text", heavy: int = HEAVY) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 of the normalised text."""
    keyed = keep(df.select(F.monotonically_increasing_id().alias("__row"), F.col(id).alias("__id"), digest(text).alias("__digest")))
    return grouped(keyed, heavy).select(F.col("__id").alias(id), "keep_id", "group_size", "kept", F.lower(F.hex("__digest")).alias("text_sha256"))


def exact_dedup(df: DataFrame, id: str = "doc_id", text: str = "text", heavy: int = HEAVY) -> DataFrame:
    """The rows that stay, with all their columns."""
    row, key = fresh(df, "row", "digest")
    numbered = keep(df.withColumns({row: F.monotonically_increasing_id(), key: digest(text)}))
    keyed = numbered.select(F.col(row).alias("__row"), F.col(id).alias("__id"), F.col(key).alias("__digest"))
    dropped = grouped(keyed, heavy).filter(~F.col("kept")).select(F.col("__row").alias(row))
    return numbered.join(dropped, row, "left_anti").drop(row, key)
