"""A Bloom filter of fixed size that spares most rows of a large table the shuffle of a semi- or anti-join.

The filter has ``WORDS`` words of 64 bits however many ids there are, so the
broadcast is bounded. An id has two bits of one word. The filter never misses
an id; rows that it lets through are joined exactly. With very many ids it lets
every row through, and the join does all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import fresh

WORDS = 1 << 16


def _parts(name: str, size: int = WORDS) -> tuple:
    """The word of an id, and its bits there."""
    h = F.xxhash64(F.col(name), F.lit(1))
    bit = lambda shift: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, shift).bitwiseAND(F.lit(63)).cast("int"))
    return F.pmod(h, F.lit(size)).cast("int"), bit(20).bitwiseOR(bit(40))


def _marked(df: DataFrame, ids: DataFrame, name: str, theirs: str | None = None, size: int = WORDS) -> tuple[DataFrame, str]:
    """df with a new column, and its name: false only where no row of ids has the value, there in the column ``theirs``."""
    maybe, at, bits_of = fresh(df, "maybe", "word", "bits")
    word, bits = _parts(name, size)
    their_word, their_bits = _parts(theirs or name, size)
    table = ids.select(their_word.alias(at), their_bits.alias(bits_of)).groupBy(at).agg(F.bit_or(bits_of).alias(bits_of))
    out = df.withColumn(at, word).join(F.broadcast(table), at, "left")
    return out.withColumn(maybe, F.coalesce(F.col(bits_of).bitwiseAND(bits) == bits, F.lit(False))).drop(at, bits_of), maybe


def likely(df: DataFrame, ids: DataFrame, name: str = "id", theirs: str | None = None) -> DataFrame:
    """The rows whose value may be among the ids; none that is, is missing."""
    marked, maybe = _marked(df, ids, name, theirs)
    return marked.filter(maybe).drop(maybe)


def plausible(df: DataFrame, ids: DataFrame, name: str, theirs: str, size: int = WORDS) -> DataFrame:
    """The rows whose value may be among the ids, and those without a value; ``size``: words of the filter, a bound of the broadcast."""
    marked, maybe = _marked(df, ids, name, theirs, size)
    return marked.filter(F.col(name).isNull() | F.col(maybe)).drop(maybe)


def semi(df: DataFrame, ids: DataFrame, name: str = "id") -> DataFrame:
    return likely(df, ids, name).join(ids.select(name), name, "left_semi")


def anti(df: DataFrame, ids: DataFrame, name: str = "id") -> DataFrame:
    """The rows without an equal in ids."""
    marked, maybe = _marked(df, ids, name)
    rest = marked.filter(maybe).drop(maybe).join(ids.select(name), name, "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])
    return marked.filter(~F.col(maybe)).drop(maybe).unionByName(rest)
