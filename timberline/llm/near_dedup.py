"""Near-duplicate documents by bottom-k sketches of their word shingles.

One hash function gives every shingle a value; a document's sketch retains its
``SKETCH`` smallest values, or all of up to ``WHOLE``. Documents retained whole
share exactly what their sizes ask for. Of others with similarity t the
smallest ``SKETCH`` values of both together, the union sketch, are known, and
each is in both with probability t; so linked documents share at least
``least_shared`` of them, but for one link in ``LOSS``. A document that may
have partners of either kind has its values in lists of both kinds.

Every retained value has an inverted list. A document's values are opened
rarest first, by the length of the list: if two sketches of s values share c,
they share one of the rarest s - c + 1 of either, so only these lists are
followed and no link is lost. A passage that many documents share comes last
and is opened only by documents that consist of little else. All lists, of any
length, are followed in the same way. First each list ties its documents to one
leader, the one with the smallest part of values of its own; the union-sketch
estimate filters these pairs and exact Jaccard on full sets verifies them. A
group of m near copies is so linked by about m comparisons. Then all documents
of lists that still hold several components, near copies and what only
resembles them, are sketched whole. In their exact lists a document opens only
about as many values as it may lack, so those that differ too much from the
rest of a group have no list in common with it; the others give the pairs
between components, in blocks of the list, which are estimated and verified as
well.

Lists are counted by a window that spills; values with more than about 1/512 of
all rows are counted ahead and not shuffled, and joins send their most frequent
keys by broadcasts of fixed size, so no list and no leader lands in one task.

Defined cases: null or empty texts have no shingles and are linked with
nothing; texts shorter than a shingle have one, their whole word sequence; rows
with the same id are one document where they are linked; rows with a null id
stay and have no component; an empty table gives an empty result; columns of
the input named like the outputs are replaced, other columns of any name stay
in :func:`near_dedup`. Ids are whole numbers; others are refused by the cast to
long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm.bloom import anti, likely, semi
from timberline.llm.common import fresh, hot_join, in_worker, keep, text_of
from timberline.llm.components import components
from timberline.llm.exact_dedup import grouped

WORDS, NUMERATOR, DENOMINATOR = 5, 80, 100
#: Values that a sketch retains, and of documents that are retained whole; one of so many links may be lost to an estimate.
SKETCH, WHOLE, LOSS = 128, 256, 10**9
#: Values so frequent that they are not shuffled, at most.
HOT = 512
#: Partners of one document that a task compares, and documents of one list that a task pairs with others.
BLOCK = 128
#: What tells values of lists of documents beyond ``WHOLE`` and their partners from others.
_OTHER = 0x5DEECE66D1B3F27A
REMEMBERED = 200_000
_TURN, _MIX1, _MIX2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))


class Hashes(dict):
    """Word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def _windows(h: np.ndarray, w: int) -> np.ndarray:
    """A hash of each w words in a row."""
    out = np.full(len(h) - w + 1, w, dtype=np.uint64)
    for i in range(w):
        out = out * _TURN + h[i : len(h) - w + 1 + i]
        out ^= out >> np.uint64(29)
    for m in (_MIX1, _MIX2):
        out = (out ^ (out >> np.uint64(33))) * m
    return out ^ (out >> np.uint64(33))


def shingle_sets(texts: list[bytes], words: int, known: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text in ascending order, all in a row, and where each text's begin (one more at the end)."""
    tokens = [t.lower().split() for t in texts]
    size = np.array([len(t) for t in tokens], dtype=np.int64)
    h = np.fromiter(map(known.__getitem__, chain.from_iterable(tokens)), np.uint64, int(size.sum()))
    many = np.where(size >= words, size - words + 1, np.minimum(size, 1))
    at, begin = np.cumsum(size) - size, np.concatenate([[0], np.cumsum(many)])
    out = np.zeros(begin[-1], dtype=np.uint64)
    if len(h) >= words:
        all_windows = _windows(h, words)
        inside = np.arange(len(all_windows)) + words <= np.repeat(np.cumsum(size), size)[: len(all_windows)]
        out[np.repeat(size >= words, many)] = all_windows[inside]
    for i in np.flatnonzero((size > 0) & (size < words)):
        out[begin[i]] = _windows(h[at[i] : at[i] + size[i]], int(size[i]))[0]
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
        out[a:b].sort()
    new = np.ones(len(out), dtype=bool)
    new[1:] = out[1:] != out[:-1]
    new[begin[:-1][many > 0]] = True
    return out[new], np.concatenate([[0], np.cumsum(new)])[begin]


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two ascending arrays of distinct values share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def least_shared(k: int, num: int, den: int) -> int:
    """Values of a union sketch of k that documents of similarity num/den share, but for one link in ``LOSS``."""
    below, all_ways = 0, den**k
    for c in range(k + 1):
        below += comb(k, c) * num**c * (den - num) ** (k - c)
        if below * LOSS > all_ways:
            return c
    return k


def estimate_passes(a: np.ndarray, na: int, b: np.ndarray, nb: int, num: int, den: int, least: int) -> bool:
    """Whether the similarity may be that of a link: exact if both are retained whole, else by the union sketch."""
    if na <= len(a) and nb <= len(b):
        both = shared(a, b)
        return den * both >= num * (na + nb - both)
    last = np.union1d(a, b)[:SKETCH][-1]
    return shared(a[: np.searchsorted(a, last, side="right")], b[: np.searchsorted(b, last, side="right")]) >= least


def sketches(df: DataFrame, id: str, text: str, words: int, limit: int | None = WHOLE) -> DataFrame:
    """row, id, n, digest of the full set, the retained values in ascending order (unsigned, as longs); all values up to ``limit``, if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = in_worker("hashes", Hashes)
        for b in batches:
            for lo in range(0, b.num_rows, 250):
                part = b.slice(lo, 250)
                values, begin = shingle_sets(part.column(1).to_pylist(), words, known)
                n = np.diff(begin)
                digests = [hashlib.blake2b(values[x:y].tobytes(), digest_size=16).digest() for x, y in zip(begin[:-1], begin[1:])]
                many = n if limit is None else np.where(n <= limit, n, SKETCH)
                first = np.arange(len(values)) - np.repeat(begin[:-1], n) < np.repeat(many, n)
                at = np.concatenate([[0], np.cumsum(many)])
                kept = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values[first].view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), kept], ["id", "n", "digest", "sketch"])

    return df.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("t")).mapInArrow(run, "id long, n long, digest binary, sketch array<long>").withColumn("row", F.monotonically_increasing_id())


def _hot_values(drawn: DataFrame, hot: int) -> list[tuple[int, int]]:
    """At most ``hot`` retained values and about how often each occurs: every value with over 2/hot of all rows is among them (Misra-Gries)."""
    counters = 4 * hot

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                new, often = np.unique(b.column(0).slice(lo, 2000).flatten().to_numpy(), return_counts=True)
                some = often > 1  # one occurrence in so many values is no sign of a frequent one
                v, at = np.unique(np.concatenate([v, new[some]]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n, often[some]]), len(v)).astype(np.int64)
                if len(v) > counters:
                    n = n - np.partition(n, len(n) - counters - 1)[len(n) - counters - 1]
                    v, n = v[n > 0], n[n > 0]
        yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(n)], ["v", "df"])

    found = drawn.select("sketch").mapInArrow(summarise, "v long, df long").groupBy("v").agg(F.sum("df").alias("df"))
    return [(r[0], r[1]) for r in found.orderBy(F.desc("df"), "v").limit(hot).collect()]


def _size_ok(na: Column, nb: Column, num: int, den: int) -> Column:
    return (den * na >= num * nb) & (den * nb >= num * na)


def _asked(whole: Column, both: Column, num: int, den: int) -> Column:
    """Values that two documents with ``both`` shingles in all share at least if they are linked."""
    return F.when(whole, F.ceil(both * num / F.lit(float(num + den)) - 1e-9)).otherwise(least_shared(SKETCH, num, den))


def _lists(drawn: DataFrame, reps: DataFrame, num: int, den: int, hot: int, limit: int | None = WHOLE) -> DataFrame:
    """v, df (length of its list), whole (kind of list), id, n, s (values of the document's sketch), place there by rarity, rare (part of values of its own): the rows of the lists to be followed."""
    hot_values = [(v ^ x, n) for v, n in _hot_values(drawn, hot) for x in (0, _OTHER)]
    common = drawn.sparkSession.createDataFrame(hot_values, "v long, df long")  # at most 2 * hot rows
    whole, partial = (F.lit(True), F.lit(False)) if limit is None else (F.col("n") <= limit, F.col("n") * den > num * limit)
    none = F.array().cast("array<long>")
    other = F.transform(F.slice("sketch", 1, SKETCH), lambda v: v.bitwiseXOR(F.lit(_OTHER)))
    both = F.concat(F.when(whole, F.col("sketch")).otherwise(none), F.when(partial, other).otherwise(none))
    values = reps.select("row", F.when(whole, F.col("n")).otherwise(0).alias("own"), F.posexplode(both).alias("at", "v"))
    values = values.select((F.col("row") * 2 + (F.col("at") >= F.col("own")).cast("int")).alias("entry"), "v")  # a document of each kind of list
    rest = values.join(F.broadcast(common.select("v")), "v", "left_anti")
    rest = rest.withColumn("df", F.count("*").over(Window.partitionBy("v"))).filter("df > 1")
    counted = rest.unionByName(values.join(F.broadcast(common), "v").select("entry", "v", "df"))
    of = Window.partitionBy("entry")
    placed = counted.withColumns({"nth": F.row_number().over(of.orderBy("df", "v")), "shared": F.count("*").over(of)})
    entry = F.array(F.when(whole, F.col("row") * 2), F.when(partial, F.col("row") * 2 + 1))
    sizes = reps.select(F.explode(entry).alias("entry"), "id", "n").filter("entry is not null").withColumn("whole", F.col("entry") % 2 == 0)
    s = F.when(F.col("whole"), F.col("n")).otherwise(SKETCH)
    ranked = placed.join(sizes.withColumn("s", s), "entry").withColumns({"place": F.col("s") - F.col("shared") + F.col("nth"), "rare": (F.col("s") - F.col("shared")) / F.col("s")})
    # Of all partners the smallest asks for the least.
    asked = _asked(F.col("whole"), F.col("n") + F.ceil(F.col("n") * num / F.lit(float(den)) - 1e-9), num, den)
    return ranked.filter(F.col("place") <= F.col("s") - asked + 1).select("v", "df", "whole", "id", "n", "s", "place", "rare")


def _compared(pairs: DataFrame, data: DataFrame, step: int, prepare, passes) -> DataFrame:
    """The pairs(a, b, block) that pass; data(id, more columns).

    A document ``a`` goes once to each block of its partners, so one of many
    partners takes many tasks. ``prepare`` makes a list of what is compared from
    columns of data, ``passes`` tells of two of them. Where several rows of data
    have one id, one that passes is enough.
    """
    columns = [c for c in data.columns if c != "id"]
    ours = pairs.select(F.col("a").alias("id"), "a", "block", F.lit(None).cast("long").alias("b")).distinct()
    theirs = pairs.select(F.col("b").alias("id"), "a", "block", "b")
    roles = keep(ours.unionByName(theirs))
    rows = likely(data, roles).join(roles, "id").select("a", "block", "b", *columns)
    rows = rows.repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list = []
        of = None
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                made, found = prepare([part.column(c) for c in columns]), []
                for a, block, b, x in zip(part.column("a").to_pylist(), part.column("block").to_pylist(), part.column("b").to_pylist(), made):
                    if of != (a, block):
                        of, own = (a, block), []
                    if b is None:
                        own.append(x)
                    elif any(passes(y, x) for y in own):
                        found.append((a, block, b))
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64()))], ["a", "block", "b"])

    return rows.mapInArrow(run, "a long, block int, b long").distinct()


def estimated(pairs: DataFrame, drawn: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that the sketches let pass; drawn(id, n, sketch)."""
    least = least_shared(SKETCH, num, den)

    def prepare(columns: list[pa.Array]) -> list:
        n, lists = columns[0].to_pylist(), columns[1]
        flat, at = lists.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        return [(flat[x:y], m) for x, y, m in zip(at[:-1], at[1:], n)]

    return _compared(pairs, drawn.select("id", "n", "sketch"), 500, prepare, lambda x, y: estimate_passes(*x, *y, num, den, least))


def verified(pairs: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The pairs whose full sets have the similarity; texts(id, t)."""

    def prepare(columns: list[pa.Array]) -> list:
        values, at = shingle_sets(columns[0].to_pylist(), words, in_worker("hashes", Hashes))
        return [values[x:y] for x, y in zip(at[:-1], at[1:])]

    def passes(x: np.ndarray, y: np.ndarray) -> bool:
        both = shared(x, y)
        return both > 0 and den * both >= num * (len(x) + len(y) - both)

    return _compared(pairs, texts, 200, prepare, passes)


def _leads(listed: DataFrame) -> DataFrame:
    """v, lead: the leader of each list of several rows."""
    return keep(listed.groupBy("v").agg(F.count("*").alias("many"), F.min(F.struct("rare", "id", "n")).alias("lead")).filter("many > 1").select("v", "lead"))


def _placed(rows: DataFrame, found: DataFrame, col: str = "id", to: str = "at") -> DataFrame:
    """rows with the component ``to`` of the document ``col``."""
    return hot_join(rows, found.select(F.col("node").alias(col), F.col("component").alias(to)), col, "left").withColumn(to, F.coalesce(to, col))


def _several(placed: DataFrame) -> DataFrame:
    """v: the lists that hold several components."""
    return placed.groupBy("v").agg(F.min("at").alias("one"), F.max("at").alias("other")).filter("one <> other").select("v")


def _between(listed: DataFrame, found: DataFrame, num: int, den: int) -> DataFrame:
    """a, b, block: pairs of documents of one list and different components; ``found`` gives components.

    The leader's component meets the others, and they meet each other. In the
    first list that two documents share, their places bound what they share.
    """
    placed, leads = keep(_placed(listed, found)), _leads(listed)
    several = keep(_placed(leads.join(_several(placed), "v").select("v", F.col("lead.id").alias("lead")), found, "lead", "lead_at").select("v", "lead_at"))
    blocks = F.ceil(F.col("df") / F.lit(float(BLOCK))).cast("int")
    mixed = keep(hot_join(placed, several, "v", hot=HOT).withColumn("block", F.pmod(F.hash("id"), blocks)))
    probe = mixed.filter("at <> lead_at").select("v", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.col("id").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"), F.col("place").alias("pa"), F.col("at").alias("a_at"))
    asked = _asked(F.col("whole"), F.col("n") + F.col("na"), num, den)
    room = 1 + F.least(F.col("s") - F.col("place"), F.col("sa") - F.col("pa")) >= asked
    once = (F.col("at") == F.col("lead_at")) | (F.col("id") < F.col("a"))
    pairs = mixed.join(probe, ["v", "block"]).filter((F.col("at") != F.col("a_at")) & once & _size_ok(F.col("n"), F.col("na"), num, den) & room)
    return pairs.groupBy("a", F.col("id").alias("b")).agg(F.min("block").alias("block"))


def _texts(texts: DataFrame, linkable: DataFrame) -> DataFrame:
    """texts(id, t) without repeated rows."""
    again = keep(linkable.groupBy("id").agg(F.count("*").alias("rows")).filter("rows > 1").select("id"))
    if again.isEmpty():
        return texts
    one = semi(texts, again).withColumn("h", F.xxhash64("t")).groupBy("id", "h").agg(F.first("t").alias("t"))
    return anti(texts, again, "id").unionByName(one.select("id", "t"))


def near_groups(df: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS, num: int = NUMERATOR, den: int = DENOMINATOR, hot: int = HOT) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable by links), kept."""
    drawn = keep(sketches(df, id, text, words))
    linkable = drawn.filter("n > 0 and id is not null")
    # Documents with equal sets are one from the start.
    equal = grouped(linkable.select(F.col("row").alias("__row"), F.col("id").alias("__id"), F.col("digest").alias("__digest")))
    copies = keep(equal.filter("not kept").select(F.col("__row").alias("row"), F.col("keep_id").alias("rep")))
    reps = anti(linkable, copies, "row")
    listed = keep(_lists(linkable, reps, num, den, hot))

    # Each document of a list meets the leader.
    star = hot_join(listed, _leads(listed), "v", hot=HOT).filter((F.col("id") != F.col("lead.id")) & _size_ok(F.col("n"), F.col("lead.n"), num, den))
    block = F.pmod(F.hash("id"), F.ceil(F.col("df") / F.lit(float(BLOCK))).cast("int"))
    tried = keep(star.groupBy(F.col("lead.id").alias("a"), F.col("id").alias("b")).agg(F.min(block).alias("block")))
    texts = _texts(df.select(F.col(id).cast("long").alias("id"), text_of(text).cast("binary").alias("t")), linkable)
    linked = lambda pairs: keep(verified(keep(estimated(pairs, reps, num, den)), texts, words, num, den))
    found = components(linked(tried))

    # Then documents of lists that hold several components, by their whole sets.
    placed = keep(_placed(listed, found))
    left = keep(hot_join(placed, _several(placed), "v", hot=HOT).select("id").distinct())
    if not left.isEmpty():
        whole = keep(sketches(semi(texts, left), "id", "t", words, None))
        exact = keep(_lists(whole, whole, num, den, hot, None))
        sides = lambda rows: rows.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")})
        rest = keep(sides(_between(exact, found, num, den)).join(sides(tried).select("lo", "hi"), ["lo", "hi"], "left_anti").select("a", "b", "block"))
        found = components(linked(rest).select("a", "b").union(found.select("node", "component")))

    out = drawn.join(copies, "row", "left").select("id", "n", F.coalesce("rep", "id").alias("node"))
    out = hot_join(out, found, "node", "left").withColumn("component_id", F.coalesce("component", "node"))
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def near_dedup(df: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS, num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """The documents with the smallest id of each group, with all their columns."""
    key = fresh(df, "id")
    keyed = df.withColumn(key, F.col(id).cast("long"))
    gone = keep(near_groups(df, id, text, words, num, den).filter(~F.col("kept")).select(F.col(id).cast("long").alias(key)).distinct())
    return anti(keyed, gone, key).drop(key)
