"""Column functions of single rows, and the two-proportion test."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

THRESHOLD, NEAR = 10_000.0, 0.90


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is null or 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def near_threshold(amount: Column) -> Column:
    return ((amount >= NEAR * THRESHOLD) & (amount < THRESHOLD)).cast("int")


def above_threshold(amount: Column) -> Column:
    return (amount >= THRESHOLD).cast("int")


def is_round(amount: Column, unit: int) -> Column:
    return (F.round(amount, 2) % unit == 0).cast("int")


def same_category(a: Column, b: Column) -> Column:
    """Null equals null."""
    return a.eqNullSafe(b)


def bucketize(x: Column, edges: list[float], labels: list[str]) -> Column:
    """The label of [edge, next edge); null outside and at infinity."""
    out = F.lit(None).cast("string")
    for lo, hi, label in reversed(list(zip(edges, edges[1:], labels, strict=False))):
        inside = (x >= lo) & ((x < hi) if math.isfinite(hi) else (x < F.lit(float("inf"))))
        out = F.when(inside, F.lit(label)).otherwise(out)
    return out


def quantile_bin(x: Column, edges: list[float]) -> Column:
    """1, 2, ... for (edge, next edge], the first closed on both sides; null outside."""
    out = F.lit(None).cast("int")
    for i, (lo, hi) in reversed(list(enumerate(zip(edges, edges[1:], strict=False)))):
        out = F.when(((x >= lo) if i == 0 else (x > lo)) & (x <= hi), F.lit(i + 1)).otherwise(out)
    return out


def ztest_column(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    """Pooled z of two proportions; null if a side is empty or the pooled error 0."""
    pool = ratio(x1 + x2, n1 + n2)
    se = F.sqrt(pool * (1 - pool) * (ratio(F.lit(1), n1) + ratio(F.lit(1), n2)))
    return ratio(ratio(x1, n1) - ratio(x2, n2), se)


def two_proportion_ztest(x1: int, n1: int, x2: int, n2: int) -> tuple[float, float]:
    """(z, two-sided p); NaN if a side is empty or the pooled error 0."""
    sizes = (n1, n2)
    if 0 in sizes:
        return math.nan, math.nan
    shared = (x1 + x2) / sum(sizes)
    spread = math.sqrt(shared * (1 - shared) * sum(1 / n for n in sizes))
    z = (x1 / n1 - x2 / n2) / spread if spread else math.nan
    return z, math.erfc(abs(z) / math.sqrt(2))


def verdict(lift: Column, p: Column) -> Column:
    return F.when(p.isNull() | (p >= 0.05), "no effect").when(lift >= 1.5, "confirmed").when(lift >= 1.2, "weak").otherwise("not confirmed")
