"""Chat formatting after cumulative snapshots were collapsed.

Logs often hold a conversation several times, each time with more turns. The
rolling hash of a turn is the sum of a hash of position and content over all
turns up to it, so it names the whole prefix, and it is a running sum that
Spark can spread over tasks. A conversation whose last hash is an earlier hash
of a longer one is a snapshot of it; an anti-join removes it. Of equal
conversations the one with the smallest id stays. What stays is rendered, in
parts of at most ``PART`` turns, so no row grows with a conversation's length.

Defined cases: turns are ordered by turn, null first, then by a hash of role and
text; null roles and texts are empty; rows with a null conversation id form one
conversation; repeated rows are repeated turns; an empty table gives an empty
result; other columns are not read. Prefix hashes have 120 bits beside the
number of turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import keep, running

PART = 512
_NULL = -(2**63)
_KEYS = ["n", "s0", "s1", "s2"]


def _contents(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    own = df.select(F.coalesce(F.col(conv).cast("long"), F.lit(_NULL)).alias("conv"), F.coalesce(F.col(turn).cast("long"), F.lit(_NULL)).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return own.withColumns({"c0": F.xxhash64("role", "text"), "c1": F.xxhash64(F.lit("second"), "text", "role")})


def prefixes(contents: DataFrame) -> DataFrame:
    """conv, turn, c0, c1 of each turn with its position n and the rolling hashes s0, s1, s2 of the turns up to it."""
    rows = contents.select("conv", "turn", "c0", "c1", F.lit(1).cast("long").alias("one"))
    rows = running(rows, "conv", ["turn", "c0", "c1"], {"one": "n"}).withColumn("n", F.col("n") + 1)
    # 40 bits of each hash, so that sums of 2^23 turns fit.
    for i in range(3):
        rows = rows.withColumn(f"h{i}", F.shiftrightunsigned(F.xxhash64(F.lit(i), "n", "c0", "c1"), 24))
    rows = running(rows, "conv", ["n"], {f"h{i}": f"s{i}" for i in range(3)}).withColumns({f"s{i}": F.col(f"s{i}") + F.col(f"h{i}") for i in range(3)})
    return keep(rows.select("conv", "turn", "c0", "c1", *_KEYS))


def maximal(rolled: DataFrame) -> DataFrame:
    """conv, n_turns, snapshots (equal conversations, itself included) of the conversations that stay."""
    ends = rolled.join(rolled.groupBy("conv").agg(F.max("n").alias("n")), ["conv", "n"]).select("conv", *_KEYS)
    inner = rolled.join(ends.select("conv", "n"), ["conv", "n"], "left_anti").select(*_KEYS).distinct()
    equal = ends.groupBy(*_KEYS).agg(F.min("conv").alias("conv"), F.count("*").alias("snapshots"))
    return equal.join(inner, _KEYS, "left_anti").select("conv", F.col("n").alias("n_turns"), "snapshots")


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per part of a conversation that stays: conv id, part, n_turns, snapshots, rendered."""
    contents = _contents(df, conv, turn, role, text)
    rolled = prefixes(contents)
    stays = keep(maximal(rolled))
    places = rolled.select("conv", "turn", "c0", "c1", "n").join(stays, "conv")
    words = contents.join(stays.select("conv"), "conv", "left_semi").groupBy("conv", "turn", "c0", "c1").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    said = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("<|end|>\n"))
    turns = places.join(words, ["conv", "turn", "c0", "c1"]).select("conv", "n_turns", "snapshots", "n", F.floor((F.col("n") - 1) / PART).cast("int").alias("part"), said.alias("said"))
    parts = turns.groupBy("conv", "part", "n_turns", "snapshots").agg(F.sort_array(F.collect_list(F.struct("n", "said"))).alias("turns"))
    id = F.when(F.col("conv") != _NULL, F.col("conv"))
    return parts.select(id.alias(conv), "part", "n_turns", "snapshots", F.array_join(F.col("turns.said"), "").alias("rendered"))
