"""Intervals and order statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96


def wilson(hits: Column, total: Column) -> tuple[Column, Column]:
    """The Wilson interval of a rate: exactly 0 below without hits, exactly 1 above without misses, (0, 0) without cases."""
    n, p = total.cast("double"), hits / total
    middle = (p + Z * Z / (2 * n)) / (1 + Z * Z / n)
    half = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n)) / (1 + Z * Z / n)
    low = F.when(total == 0, 0.0).when(hits == 0, 0.0).otherwise(F.greatest(F.lit(0.0), middle - half))
    high = F.when(total == 0, 0.0).when(hits == total, 1.0).otherwise(F.least(F.lit(1.0), middle + half))
    return low, high


def newcombe(h1: Column, n1: Column, h2: Column, n2: Column) -> tuple[Column, Column, Column]:
    """The difference of two independent rates, and its interval from theirs."""
    p1, p2 = h1 / n1, h2 / n2
    (l1, u1), (l2, u2) = wilson(h1, n1), wilson(h2, n2)
    d = p1 - p2
    return d, d - F.sqrt((p1 - l1) ** 2 + (u2 - p2) ** 2), d + F.sqrt((u1 - p1) ** 2 + (p2 - l2) ** 2)


def newcombe_paired(both: Column, first: Column, second: Column, neither: Column) -> tuple[Column, Column, Column]:
    """The difference (second less first) of two rates over the same cases, corrected for their correlation."""
    n = both + first + second + neither
    p1, p2 = (both + first) / n, (both + second) / n
    (l1, u1), (l2, u2) = wilson(both + first, n), wilson(both + second, n)
    under = F.sqrt(((both + first) * (second + neither) * (both + second) * (first + neither)).cast("double"))
    phi = F.when(under == 0, 0.0).otherwise((both * neither - first * second) / under)
    d = p2 - p1

    def reach(a: Column, b: Column) -> Column:
        return F.sqrt(F.greatest(F.lit(0.0), a * a - 2 * phi * a * b + b * b))

    return d, d - reach(p2 - l2, u1 - p1), d + reach(u2 - p2, p1 - l1)


def nearest_rank(values: Column, q: float) -> Column:
    """The value at index round-half-even(q * (n - 1)) of those in order; null if there are none. An aggregate over one
    group's values: use it for groups of bounded size, and ``ranked_quantile`` in operators.reports for any other."""
    held = F.sort_array(F.collect_list(values))
    return F.try_element_at(held, (F.bround(q * (F.size(held) - 1), 0) + 1).cast("int"))
