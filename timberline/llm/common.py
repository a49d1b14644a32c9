"""Helpers shared by the corpus operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.tables import keep as keep

#: A word, and a run of the white space that separates words (ASCII only).
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def text_of(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def n_words(col: str) -> Column:
    return F.regexp_count(text_of(col), F.lit(WORD)).cast("long")


def id_crc(col: str) -> Column:
    """crc32 of the id written as text, a stable split into folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns that an output of the same name replaces."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def fresh(df: DataFrame, *names: str) -> str | list[str]:
    """Names for helper columns that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"__{name}"
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out[0] if len(out) == 1 else out


def running(df: DataFrame, key: str, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Add for each ``value: before`` of ``sums`` the sum of ``value`` over the rows of the same ``key`` that come earlier in ``order``.

    Rows are dealt by ranges of (key, order), so a key of any size spans many
    tasks. The ranges are written down with their number; sums of each range
    give every range the total that precedes it. A range has at most one key
    that began in an earlier range, so the broadcast table has no more rows
    than there are ranges. ``key`` must not be null.
    """
    ranged = keep(df.repartitionByRange(key, *order).withColumn("__range", F.spark_partition_id()))
    totals = ranged.groupBy(key, "__range").agg(*[F.sum(v).alias(f"__sum_{b}") for v, b in sums.items()])
    earlier = Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(key, "__range", F.row_number().over(Window.partitionBy(key).orderBy("__range")).alias("__nth"), *[F.sum(f"__sum_{b}").over(earlier).alias(f"__carried_{b}") for b in sums.values()])
    carried = carried.filter("__nth > 1").drop("__nth")
    within = Window.partitionBy(key, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    kinds = dict(df.dtypes)
    out = ranged.join(F.broadcast(carried), [key, "__range"], "left")
    for v, b in sums.items():
        zero = F.lit(0).cast(kinds[v])
        out = out.withColumn(b, F.coalesce(F.sum(v).over(within), zero) + F.coalesce(F.col(f"__carried_{b}"), zero))
    return out.drop("__range", *[f"__carried_{b}" for b in sums.values()])


def hot_join(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", hot: int = 256) -> DataFrame:
    """Join rows with a table of at most one small row a key, also where a few keys have most of the rows.

    The keys with the most rows, ``hot`` of them, are joined by a broadcast of as
    many rows at most; of the other keys none has more than 1/hot of all rows.
    Rows with a null key match nothing.
    """
    often = rows.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1").orderBy(F.desc("count"), key).limit(hot).select(key)
    top = rows.sparkSession.createDataFrame(often.collect(), often.schema)  # at most `hot` rows
    few = table.join(F.broadcast(top), key, "left_semi")
    out = rows.join(F.broadcast(top), key, "left_semi").join(F.broadcast(few), key, how)
    out = out.unionByName(rows.filter(F.col(key).isNotNull()).join(F.broadcast(top), key, "left_anti").join(table, key, how))
    if how == "left":
        empty = [F.lit(None).cast(t).alias(c) for c, t in table.dtypes if c != key]
        out = out.unionByName(rows.filter(F.col(key).isNull()).select("*", *empty))
    return out


def in_worker(name: str, make: Callable[[], object]) -> object:
    """An object that a Python worker makes once and uses again in its later tasks; another name takes its place."""
    held = sys.modules.setdefault("timberline_worker", types.ModuleType("timberline_worker")).__dict__
    if held.get("name") != name:
        held.pop("made", None)
        held.update(name=name, made=make())
    return held["made"]
