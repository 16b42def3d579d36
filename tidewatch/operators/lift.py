"""Rates, lifts and tables of the exploration."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.scalar import quantile_bin, ratio, two_proportion_ztest, ztest_column

Y = "is_laundering"


def base_rate(df: DataFrame, target: str = Y) -> tuple[int, int]:
    n, x = df.agg(F.count(F.lit(1)), F.sum(target)).first()
    return n, int(x or 0)


def rate_by_group(df: DataFrame, by: list[str], target: str = Y, min_support: int = 1) -> DataFrame:
    """n, n_laundering, rate_pct, lift over the rate of all rows, share_pct of all positives; groups of min_support rows at least."""
    n, x = base_rate(df, target)
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(target).cast("long").alias("n_laundering")).where(F.col("n") >= min_support)
    rate = ratio(F.col("n_laundering"), F.col("n"))
    return out.withColumns({"rate_pct": rate * 100, "lift": ratio(rate, F.lit(x / n if n else None)), "share_pct": ratio(F.col("n_laundering") * 100.0, F.lit(x))})


def rate_by_bucket(df: DataFrame, bucket: Column, target: str = Y) -> DataFrame:
    return rate_by_group(df.withColumn("bucket", bucket).where("bucket is not null"), ["bucket"], target).drop("share_pct")


def compare_band(df: DataFrame, mask: Column, target: str = Y) -> DataFrame:
    """Two rows, inside and outside: n, n_laundering, rate_pct, lift_vs_other (1 outside), z."""
    m = F.coalesce(mask, F.lit(False))
    row = df.agg(F.count_if(m), F.sum(F.when(m, F.col(target))), F.count_if(~m), F.sum(F.when(~m, F.col(target)))).toDF("n1", "x1", "n2", "x2").na.fill(0)
    z = ztest_column(F.col("x1"), F.col("n1"), F.col("x2"), F.col("n2"))
    r1, r2 = ratio(F.col("x1"), F.col("n1")), ratio(F.col("x2"), F.col("n2"))
    sides = F.array(
        F.struct(F.lit("inside").alias("side"), F.col("n1").alias("n"), F.col("x1").cast("long").alias("n_laundering"), (r1 * 100).alias("rate_pct"), ratio(r1, r2).alias("lift_vs_other"), z.alias("z")),
        F.struct(F.lit("outside").alias("side"), F.col("n2").alias("n"), F.col("x2").cast("long").alias("n_laundering"), (r2 * 100).alias("rate_pct"), F.lit(1.0).alias("lift_vs_other"), z.alias("z")),
    )
    return row.select(F.inline(sides))


def lift_and_p(x_in: int, n_in: int, x_all: int, n_all: int) -> tuple[float | None, float | None]:
    """A group's lift over the rate of all rows, and p against the other rows; null where a side is empty."""
    _, p = two_proportion_ztest(x_in, n_in, x_all - x_in, n_all - n_in)
    return (x_in / n_in) / (x_all / n_all) if n_in and x_all else None, None if math.isnan(p) else p


def flag_checks(df: DataFrame, flags: dict[str, Column], target: str = Y) -> DataFrame:
    """A row per flag in one pass: n, share_pct, rate_in_pct, rate_out_pct, lift, z."""
    y, f = F.col(target), {k: F.coalesce(v, F.lit(False)) for k, v in flags.items()}
    aggs = [a for k, m in f.items() for a in (F.count_if(m).alias(f"{k}__n"), F.coalesce(F.sum(F.when(m, y)), F.lit(0)).alias(f"{k}__x"))]
    row = df.agg(F.count(F.lit(1)).alias("all_n"), F.coalesce(F.sum(y), F.lit(0)).alias("all_x"), *aggs)
    out = []
    for k in f:
        n1, x1 = F.col(f"{k}__n"), F.col(f"{k}__x")
        n2, x2 = F.col("all_n") - n1, F.col("all_x") - x1
        out.append(F.struct(F.lit(k).alias("flag"), n1.alias("n"), (ratio(n1, F.col("all_n")) * 100).alias("share_pct"), (ratio(x1, n1) * 100).alias("rate_in_pct"), (ratio(x2, n2) * 100).alias("rate_out_pct"), ratio(ratio(x1, n1), ratio(x2, n2)).alias("lift"), ztest_column(x1, n1, x2, n2).alias("z")))
    return row.select(F.inline(F.array(*out)))


def missing_report(df: DataFrame) -> DataFrame:
    """(column, n_missing, pct) of columns with nulls, one pass."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"m_{c}") for c in df.columns])
    out = row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m_{c}").alias("n_missing"), F.round(ratio(F.col(f"m_{c}") * 100.0, F.col("n")), 4).alias("pct")) for c in df.columns])))
    return out.where("n_missing > 0")


def describe(df: DataFrame, by: list[str], column: str) -> DataFrame:
    p = F.percentile(column, F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75, 0.95, 0.99)]))
    out = df.groupBy(*by).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), p.alias("p"), F.max(column).alias("max"))
    return out.select(*by, "n", "mean", "std", "min", *[F.get("p", i).alias(q) for i, q in enumerate(("p25", "p50", "p75", "p95", "p99"))], "max")


def correlations(df: DataFrame, columns: list[str], fill: float | None = None) -> DataFrame:
    """(a, b, corr) of every pair of columns in one pass; rows with a null in the pair are left out unless filled."""
    c = lambda x: F.col(x).cast("double") if fill is None else F.coalesce(F.col(x).cast("double"), F.lit(float(fill)))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[F.corr(c(a), c(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.nanvl(F.col(f"c{i}"), F.lit(None)).alias("corr")) for i, (a, b) in enumerate(pairs)])))


def feature_leakage(df: DataFrame, columns: list[str], target: str = Y, threshold: float = 0.9, top: int = 10) -> DataFrame:
    """The features most correlated with the target (100 values and 2 distinct ones at least), and whether they pass the threshold."""
    aggs = [a for c in columns for a in (F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(f"r_{c}"), F.count(c).alias(f"n_{c}"), (F.min(c) < F.max(c)).alias(f"d_{c}"))]
    row = df.agg(*aggs)
    out = row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.abs(F.col(f"r_{c}")).alias("abs_corr"), F.col(f"n_{c}").alias("n"), F.col(f"d_{c}").alias("varies")) for c in columns])))
    out = out.where("n >= 100 and varies and abs_corr is not null").orderBy(F.desc("abs_corr"), "feature").limit(top)
    return out.select("feature", "abs_corr", (F.col("abs_corr") > threshold).alias("leaks"))


def lift_table(df: DataFrame, columns: list[str], bins: int = 5, min_n: int = 200, target: str = Y) -> DataFrame:
    """Best and worst bin of each feature by quantile bins: feature, n_bins, max_lift, min_lift, best_bin."""
    marks = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    first = df.agg(*[a for c in columns for a in (F.percentile(F.col(c).cast("double"), marks).alias(f"e_{c}"), F.countDistinct(c).alias(f"d_{c}"))]).first()
    n, x = base_rate(df, target)
    edges = {c: sorted(set(first[f"e_{c}"])) for c in columns if first[f"e_{c}"] and first[f"d_{c}"] >= bins}
    kept = {c: e for c, e in edges.items() if len(e) >= 3}
    if not kept or not n:
        return df.sparkSession.createDataFrame([], "feature string, n_bins long, max_lift double, min_lift double, best_bin int")
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), quantile_bin(F.col(c).cast("double"), e).alias("bin")) for c, e in kept.items()])
    each = df.select(F.col(target).alias("y"), F.inline(cells)).where("bin is not null")
    by = each.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("rate")).where(F.col("n") >= min_n)
    by = by.withColumn("lift", ratio(F.col("rate"), F.lit(x / n)))
    return by.groupBy("feature").agg(F.count(F.lit(1)).alias("n_bins"), F.max("lift").alias("max_lift"), F.min("lift").alias("min_lift"), F.max_by("bin", F.struct("lift", -F.col("bin"))).alias("best_bin"))


def log_histogram(df: DataFrame, column: str, by: list[str], least: float = 0.01, per_decade: int = 10) -> DataFrame:
    """Counts by group and bin of log10 of a column, clipped from below; nulls are left out."""
    bin_ = F.floor(F.log10(F.greatest(F.col(column), F.lit(least))) * per_decade)
    return df.where(F.col(column).isNotNull()).groupBy(*by, bin_.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
