"""Impurity, gain and pruning formulas as column expressions over class counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from timberline.options import Impurity


def total(counts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, counts)


def _sized(c: Column, kind: Impurity) -> Column:
    """The term of a count whose sum gives n times the impurity: c log2 c, or c squared."""
    c = c.cast("double")
    return c * c if kind is Impurity.Gini else F.when(c > 0, c * F.log2(c)).otherwise(0.0)


def _weighted(counts: list[Column], kind: Impurity) -> Column:
    """Rows times impurity, null for no rows; each count appears once, which keeps generated code short."""
    n = F.when(total(counts) > 0, total(counts)).cast("double")
    terms = total([_sized(c, kind) for c in counts])
    return n - terms / n if kind is Impurity.Gini else n * F.log2(n) - terms


def impurity(counts: list[Column], kind: Impurity) -> Column:
    """Entropy in bits, or Gini; 0 for no rows. Classes add up in the order of their ids."""
    n = F.when(total(counts) > 0, total(counts))
    return F.greatest(F.lit(0.0), F.coalesce(_weighted(counts, kind) / n, F.lit(0.0))) + 0.0


def gain(parent: list[Column], parts: list[list[Column]], kind: Impurity) -> Column:
    """Impurity of the parent less that of its parts, weighted by rows."""
    n = F.when(total(parent) > 0, total(parent))
    left = total([F.coalesce(_weighted(p, kind), F.lit(0.0)) for p in parts])
    return F.coalesce((_weighted(parent, kind) - left) / n, F.lit(0.0))


def split_information(sizes: list[Column]) -> Column:
    return impurity(sizes, Impurity.Entropy)


#: Numerators and denominators of a rational approximation of the
#: normal quantile, for the middle and for both tails, highest power first.
MIDDLE_TOP = (-39.6968302866538, 220.946098424521, -275.928510446969, 138.357751867269, -30.6647980661472, 2.50662827745924)
MIDDLE_BOTTOM = (-54.4760987982241, 161.585836858041, -155.698979859887, 66.8013118877197, -13.2806815528857, 1.0)
TAIL_TOP = (-0.00778489400243029, -0.322396458041136, -2.40075827716184, -2.54973253934373, 4.37466414146497, 2.93816398269878)
TAIL_BOTTOM = (0.00778469570904146, 0.32246712907004, 2.445134137143, 3.75440866190742, 1.0)
TAIL = 0.02425


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile; infinite at and beyond 0 and 1."""
    poly = lambda k, x: reduce(lambda acc, c: acc * x + F.lit(c), k[1:], F.lit(k[0]))
    lower = F.least(p, 1.0 - p)
    far = F.sqrt(-2.0 * F.log(F.greatest(lower, F.lit(1e-300))))
    tail = poly(TAIL_TOP, far) / poly(TAIL_BOTTOM, far)
    near = p - 0.5
    middle = poly(MIDDLE_TOP, near * near) * near / poly(MIDDLE_BOTTOM, near * near)
    inf = F.lit(float("inf"))
    return F.when(p <= 0, -inf).when(p >= 1, inf).when(p < TAIL, tail).when(p > 1 - TAIL, -tail).otherwise(middle)


def extra_errors(n: Column, errors: Column, factor: float | Column) -> Column:
    """Errors that a leaf of n rows is charged beside those it makes, at a confidence factor within 0 to 0.5."""
    factor = F.least(F.greatest(F.lit(factor) if isinstance(factor, float) else factor, F.lit(0.0)), F.lit(0.5))
    n, errors = F.when(n > 0, n.cast("double")), errors.cast("double")
    none = n * (1.0 - F.pow(factor, 1.0 / n))

    def bound(e: Column) -> Column:
        z = normal_quantile(1.0 - factor)
        rate = (e + 0.5) / n
        square = z * z
        upper = (rate + square / (2.0 * n) + z * F.sqrt(rate / n - rate * rate / n + square / (4.0 * n * n))) / (1.0 + square / n)
        return F.when(e + 0.5 >= n, F.greatest(n - e, F.lit(0.0))).otherwise(F.greatest(upper * n - e, F.lit(0.0)))

    few = none + errors * (bound(F.lit(1.0)) - none)
    return F.when(errors == 0, none).when(errors < 1, few).otherwise(bound(errors))


def pessimistic_errors(n: Column, errors: Column, factor: float | Column) -> Column:
    return F.when(n > 0, errors + extra_errors(n, errors, factor)).otherwise(0.0)
