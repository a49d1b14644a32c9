"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time 0..1, linear between
knots. Its integral up to a time, scaled to the source's target, is the
source's cumulative token demand; so at any time the sources' shares are as
their weights then. Documents of a source stand in a hashed order, and a source
is passed over as often as its target asks. A document whose words begin, in
whichever pass, at demand d gets the time at which the demand reaches d as the
position of that pass, and a range sort by position gives the training order.
Integral and inverse are exact: between knots the demand is a parabola.

Targets: the sources share all words by the integrals of their schedules; no
target exceeds ``max_repeats`` times its source's size, and the excess is
reshared among the others until none is above. The last pass ends at the
target, inside a document if need be, so ``taken`` counts words exactly.

Defined cases: a null text has size 0; a null source is a source of its own,
last in order; empty documents take nothing and have no position; if all
documents are empty all targets are 0; repeated rows are separate documents.
An empty table gives an empty result. In :func:`curriculum` columns named like
outputs are replaced; :func:`mix` keeps all columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import fresh, keep, n_words, running

#: Schedules of integrals 5, 2 and 1 that repeat over the sources in order: lists of (time, weight) knots.
SCHEDULES = (((0.0, 2.5), (1.0, 7.5)), ((0.0, 3.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.5), (1.0, 0.5)))
MAX_REPEATS = 3


def _segments(schedule) -> list[tuple[float, float, float, float, float]]:
    """(begin, end, weight there, slope, integral before) of each line of a schedule, which is level before its first and after its last knot."""
    knots = [(0.0, float(schedule))] if isinstance(schedule, (int, float)) else sorted((float(t), float(w)) for t, w in schedule)
    if not knots or any(w < 0 or not 0 <= t <= 1 for t, w in knots):
        raise ValueError("A schedule needs knots of times from 0 to 1 and weights of at least 0.")
    knots = [(0.0, knots[0][1]), *knots, (1.0, knots[-1][1])]
    out, before = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        if t1 > t0:
            out.append((t0, t1, w0, (w1 - w0) / (t1 - t0), before))
            before += (w0 + w1) / 2 * (t1 - t0)
    return out


def integral(schedule) -> float:
    t0, t1, w, slope, before = _segments(schedule)[-1]
    return before + (w + slope * (t1 - t0) / 2) * (t1 - t0)


def time_of(share: Column, schedule) -> Column:
    """The time at which a schedule has reached this share, 0 to 1, of its integral."""
    segments, out = _segments(schedule), None
    reached = share * F.lit(integral(schedule))
    for t0, _, w, slope, before in reversed(segments):
        left = F.greatest(F.lit(0.0), reached - F.lit(before))
        speed = F.lit(w) + F.sqrt(F.greatest(F.lit(0.0), F.lit(w * w) + F.lit(2 * slope) * left))
        here = F.least(F.lit(1.0), F.lit(t0) + F.when(speed > 0, 2 * left / speed).otherwise(0.0))
        out = here if out is None else F.when(reached < F.lit(after), here).otherwise(out)
        after = before
    return out


def targets(sources: DataFrame, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """sources(weight double, source_size long) with target: one aggregated row a round reaches the driver."""
    limit = F.lit(float(max_repeats)) * F.col("source_size")
    words, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    words = float(words or 0)
    level = words / weights if weights else 0.0
    while True:
        above = limit < F.col("weight") * F.lit(level)
        full, left, n = sources.agg(F.sum(F.when(above, limit)), F.sum(F.when(~above, F.col("weight"))), F.count(F.when(above, 1))).first()
        new = (words - (full or 0.0)) / left if left else level
        if new <= level or not n:
            break
        level = new
    return sources.withColumn("target", F.least(limit, F.col("weight") * F.lit(level)))


def _planned(df: DataFrame, id: str, text: str, source: str, schedules, max_repeats: float, order: str | None) -> tuple[DataFrame, list]:
    """__id, size, source_size, target, taken, passes (whole ones), begin (words of the source before it), curve; and the schedules."""
    schedules = list(schedules or SCHEDULES)
    sized = keep(df.select(F.col(id).alias("__id"), F.md5(F.coalesce(F.col(order or id).cast("string"), F.lit(""))).alias("__mix"), F.col(source).cast("string").alias("__source"), n_words(text).alias("size")))
    sources = sized.groupBy("__source").agg(F.sum("size").alias("source_size")).withColumns({"__one": F.lit(1).cast("long"), "__all": F.lit(0), "__none": F.col("__source").isNull()})
    ranked = running(sources, "__all", ["__none", "__source"], {"__one": "rank"}).withColumn("curve", (F.col("rank") % len(schedules)).cast("int"))
    weights = F.array(*[F.lit(integral(s)) for s in schedules])
    weighted = keep(ranked.drop("__one", "__all", "__none").withColumn("weight", F.element_at(weights, F.col("curve") + 1)))
    aimed = keep(targets(weighted, max_repeats)).drop("weight")

    # Sources are few as a rule, and AQE then broadcasts them; it splits a hot source if it has to shuffle.
    placed = sized.join(aimed.withColumnRenamed("__source", "__s"), F.col("__source").eqNullSafe(F.col("__s"))).drop("__s", "__source")
    placed = running(placed, "rank", ["__mix", "__id", "size"], {"size": "begin"})
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long")
    part = F.greatest(F.lit(0), F.least("size", rest - F.col("begin")))
    placed = placed.withColumn("passes", whole).withColumn("taken", (F.col("passes") * F.col("size") + part).cast("long"))
    return placed, schedules


def _position(nth: Column, schedules: list) -> Column:
    """The position of a document's nth pass, from 0."""
    share = F.least(F.lit(1.0), (nth * F.col("source_size") + F.col("begin")) / F.col("target"))
    out = F.lit(None).cast("double")
    for i, s in enumerate(schedules):
        out = F.when(F.col("curve") == i, time_of(share, s)).otherwise(out)
    return F.when(F.col("target") > 0, out)


def curriculum(df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", schedules=None, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, position (of the first pass; null where nothing is taken), passes, begin, curve.

    ``schedules`` repeat over the sources in code-point order; a number is a
    level schedule. Documents of a source stand in the order of a hash of the id.
    """
    placed, schedules = _planned(df, id, text, source, schedules, max_repeats, None)
    placed = placed.withColumn("position", F.when(F.col("taken") > 0, _position(F.lit(0), schedules)))
    out = placed.select(F.col("__id").alias(id), "size", "source_size", "target", "taken", "position", "passes", "begin", "curve")
    return out.repartitionByRange("position", id).sortWithinPartitions("position", id)


def mix(df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", schedules=None, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The mixed corpus of whole documents in training order, with the columns of the input.

    A document comes once for each pass that takes at least half of its words,
    each at its own position, so each source ends within half a document of its
    target. Documents without words are left out. Where ids repeat or are null,
    rows are numbered and written once; unique ids need no second copy.
    """
    key, place, nth, again = fresh(df, "row", "place", "pass", "again")
    repeated = df.groupBy(id).count().filter((F.col("count") > 1) | F.col(id).isNull())
    if repeated.isEmpty():
        keyed = df.withColumn(key, F.col(id))
    else:
        keyed = keep(df.withColumn(key, F.monotonically_increasing_id()))
    plan, schedules = _planned(keyed, key, text, source, schedules, max_repeats, id)
    copies = F.round(F.col("taken") / F.col("size")).cast("int")
    chosen = plan.filter("taken > 0").withColumn("copies", copies).filter("copies > 0").withColumn(nth, F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    chosen = chosen.select(F.col("__id").alias(again), nth, _position(F.col(nth), schedules).alias(place))
    out = keyed.join(chosen, F.col(key) == F.col(again))
    out = out.repartitionByRange(place, nth, key).sortWithinPartitions(place, nth, key)
    return out.drop(key, place, nth, again)
