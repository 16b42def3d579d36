"""Features: rulers fitted on the training period, and their application."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.scalar import above_threshold, is_round, near_threshold, ratio, same_category
from tidewatch.sources.shared import small_side, stored

WINDOWS = (1, 6, 24, 168)
CODED = {"payment_type_code": "payment_type", "pay_currency_code": "pay_currency", "rec_currency_code": "rec_currency", "sender_loc_code": "sender_loc", "receiver_loc_code": "receiver_loc"}
#: A sender with more rows than this is cut into spans of the longest window.
HOT_ROWS = 1_000_000


def maybe_broadcast(df: DataFrame) -> DataFrame:
    """A ruler table, broadcast if its rows and bytes are within the limits of the shared folder's module."""
    return small_side(df)


def time_split(df: DataFrame, train: float = 0.70, val: float = 0.15) -> DataFrame:
    """df with period: train up to the interpolated time quantile, val up to the next, then test. epoch: seconds."""
    row = df.agg(F.percentile("epoch", F.array(F.lit(train), F.lit(train + val)))).first()[0] or [0.0, 0.0]
    return df.withColumn("period", F.when(F.col("epoch") <= row[0], "train").when(F.col("epoch") <= row[1], "val").otherwise("test"))


def assert_no_leakage(df: DataFrame) -> tuple[int, int]:
    row = df.agg(F.max(F.when(F.col("period") == "train", F.col("epoch"))), F.min(F.when(F.col("period") == "test", F.col("epoch")))).first()
    if row[0] is not None and row[1] is not None and row[0] > row[1]:
        raise AssertionError(f"train ends at {row[0]}, after test begins at {row[1]}")
    return row[0], row[1]


def amount_flags(df: DataFrame) -> DataFrame:
    a = F.col("amount")
    return df.withColumns({"amount_log": F.log1p(a), "amount_near_threshold": near_threshold(a), "amount_above_threshold": above_threshold(a), "is_round_100": is_round(a, 100), "is_round_1000": is_round(a, 1000)})


def border_flags(df: DataFrame) -> DataFrame:
    return df.withColumns({"is_cross_border": (~same_category(F.col("sender_loc"), F.col("receiver_loc"))).cast("int"), "is_currency_mismatch": (~same_category(F.col("pay_currency"), F.col("rec_currency"))).cast("int")})


def fit_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): the distinct values in order, from 0."""
    return df.select(F.col(column).alias("value")).where("value is not null").distinct().withColumn("code", F.row_number().over(Window.orderBy("value")) - 1)


def apply_codes(df: DataFrame, codes: dict[str, DataFrame]) -> DataFrame:
    for name, table in codes.items():
        t = maybe_broadcast(table.select(F.col("value").alias(f"{name}__v"), F.col("code").alias(name)))
        df = df.join(t, F.col(CODED.get(name, name)) == F.col(f"{name}__v"), "left").drop(f"{name}__v").withColumn(name, F.coalesce(name, F.lit(-1)))
    return df


def velocity(df: DataFrame, windows: tuple[int, ...] = WINDOWS, hot: int = HOT_ROWS) -> DataFrame:
    """Counts and sums of the sender's transfers in (t - W, t], rows of the same second included.

    A window's figure is the running one up to t less the one up to t - W. Both frames only grow, so each row is added once to each, however many rows a window
    holds; all frames share one shuffle and one sort. A sender with over `hot` rows is cut into spans of the longest window, each beside a copy of the
    span before it, so that many tasks share the sender's rows. Rows without a time are in no window.
    """
    span = max(windows) * 3600
    busy = df.groupBy(F.col("sender").alias("__busy")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("__busy")
    some = df.limit(hot + 1).count() > hot and not busy.isEmpty()
    if some:
        spans = F.floor(F.col("epoch") / span)
        cuts = F.array(F.struct(spans.alias("at"), F.lit(False).alias("copy")), F.struct((spans + 1).alias("at"), F.lit(True).alias("copy")))
        whole = F.array(F.struct(F.lit(-1).cast("long").alias("at"), F.lit(False).alias("copy")))
        df = df.join(small_side(busy), F.col("sender").eqNullSafe(F.col("__busy")), "left").withColumn("__span", F.explode(F.when(F.col("__busy").isNotNull(), cuts).otherwise(whole))).drop("__busy")
        w = Window.partitionBy("sender", "__span.at").orderBy("epoch")
    else:
        w = Window.partitionBy("sender").orderBy("epoch")
    near, known = near_threshold(F.col("amount")), F.col("amount").isNotNull().cast("int")
    till = w.rangeBetween(Window.unboundedPreceding, 0)
    cols = {}
    for h in windows:
        before = w.rangeBetween(Window.unboundedPreceding, -h * 3600)
        less = lambda x, before=before: F.sum(x).over(till) - F.coalesce(F.sum(x).over(before), F.lit(0))
        cols |= {f"vel_count_{h}h": F.count(F.lit(1)).over(till) - F.count(F.lit(1)).over(before), f"vel_amount_sum_{h}h": F.when(less(known) > 0, less(F.col("amount")))}
        if h in (24, 168):
            cols[f"vel_near_threshold_count_{h}h"] = F.when(less(known) > 0, less(near))
    out = df.withColumns(cols)
    return out.where("not __span.copy").drop("__span") if some else out


#: Steps of the logarithm by which amounts are cut for ranking: 200 to a factor of e.
_CUTS = 200


def running_counts(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, c, before, n): how often each value occurs for its key, how many rows of the key have a smaller one, and how many the key has.

    Null values are left out. Values are cut by their logarithm, and the counts run within a cut and over the cuts, so that no task holds all values of a key.
    """
    v = F.col(value).cast("double")
    cut = F.when(F.isnan(v), F.lit(1 << 40)).otherwise(F.signum(v) * F.floor(F.log1p(F.least(F.abs(v), F.lit(1e300))) * _CUTS)).cast("long")
    per = df.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("key"), F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("c"), F.min(cut).alias("cut"))
    per = stored(per, "value-counts")
    cuts = per.groupBy("key", "cut").agg(F.sum("c").alias("k"))
    over = Window.partitionBy("key").orderBy("cut")
    cuts = cuts.select(F.col("key").alias("k2"), F.col("cut").alias("cut2"), (F.sum("k").over(over) - F.col("k")).alias("base"), F.sum("k").over(Window.partitionBy("key")).alias("n"))
    within = Window.partitionBy("key", "cut").orderBy("value")
    ran = per.withColumn("run", F.sum("c").over(within) - F.col("c"))
    out = ran.join(small_side(cuts), F.col("key").eqNullSafe(F.col("k2")) & (F.col("cut") == F.col("cut2")))
    return out.select("key", "value", "c", (F.col("base") + F.col("run")).alias("before"), "n")


def fit_percentiles(train: DataFrame, n: int = 1000) -> DataFrame:
    """(pay_currency, grid): distinct interior quantiles of the amount, by linear interpolation between the two rows that a quantile lies between."""
    ranks = running_counts(train.where("pay_currency is not null"), "pay_currency", "amount")
    # The marks whose lower or upper row is one of a value's: a mark k lies at (n - 1) * k / marks.
    last = F.col("n") - 1
    near = lambda rank: F.least(F.lit(n - 1), F.greatest(F.lit(1), F.floor(F.try_divide(rank * F.lit(float(n)), last)).cast("int")))
    marks = F.when(last == 0, F.sequence(F.lit(1), F.lit(n - 1))).otherwise(F.sequence(F.greatest(F.lit(1), near(F.col("before") - 1) - 1), F.least(F.lit(n - 1), near(F.col("before") + F.col("c")) + 1)))
    each = ranks.withColumn("k", F.explode(marks)).withColumn("at", (F.col("k") / F.lit(float(n))) * last)
    lower, upper = F.floor("at"), F.ceil("at")
    holds = lambda rank: (rank >= F.col("before")) & (rank < F.col("before") + F.col("c"))
    each = each.where(holds(lower) | holds(upper))
    found = each.groupBy("key", "k").agg(F.max(F.when(holds(lower), F.col("value"))).alias("lo"), F.max(F.when(holds(upper), F.col("value"))).alias("hi"), F.max(F.col("at") - lower).alias("part"))
    value = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part"))
    return found.groupBy(F.col("key").alias("pay_currency")).agg(F.array_sort(F.collect_set(value)).alias("grid"))


def below(grid, x, steps: int = 10):
    """How many of the sorted values of an array of under 2^steps are less than x, by halving."""
    halves = F.array(*[F.lit(1 << k) for k in reversed(range(steps))])
    return F.aggregate(halves, F.lit(0), lambda at, half: F.when((at + half <= F.size(grid)) & (F.get(grid, at + half - 1) < x), at + half).otherwise(at))


def apply_percentiles(df: DataFrame, grid: DataFrame) -> DataFrame:
    """Share of the grid below the amount, in percent; null for a currency without one, 0 for a null amount."""
    g = maybe_broadcast(grid.select(F.col("pay_currency").alias("__c"), "grid"))
    df = df.join(g, F.col("pay_currency") == F.col("__c"), "left")
    return df.withColumn("amount_pct_in_currency", ratio(below(F.col("grid"), F.col("amount")) * 100.0, F.size("grid"))).drop("__c", "grid")


def fit_profiles(train: DataFrame) -> DataFrame:
    """A row per account that sent or received in training."""
    s = train.where("sender is not null").groupBy(F.col("sender").alias("account")).agg(
        F.count("amount").alias("sender_txn_count"), F.median("amount").alias("sender_median_amount"), F.avg("amount").alias("sender_mean_amount"), F.stddev_samp("amount").alias("sender_std_amount"),
        F.max("amount").alias("sender_max_amount"), F.sum("amount").alias("sender_amount_sum"), F.countDistinct("receiver").alias("sender_n_receivers"), F.countDistinct("date").alias("sender_active_days"),
    )
    r = train.where("receiver is not null").groupBy(F.col("receiver").alias("account")).agg(
        F.count("amount").alias("receiver_txn_count"), F.median("amount").alias("receiver_median_amount"), F.avg("amount").alias("receiver_mean_amount"), F.countDistinct("sender").alias("receiver_n_senders"), F.sum("amount").alias("receiver_amount_sum"),
    )
    both = s.join(r, "account", "full")
    # The reference figure named "share" is the largest amount over the median.
    return both.withColumns({"sender_txn_per_active_day": ratio(F.col("sender_txn_count"), F.col("sender_active_days")), "sender_share_above_threshold": ratio(F.col("sender_max_amount"), F.col("sender_median_amount"))})


def apply_profiles(df: DataFrame, profiles: DataFrame) -> DataFrame:
    s = profiles.select("account", *[c for c in profiles.columns if c.startswith("sender_")]).withColumnRenamed("account", "__s")
    r = profiles.select("account", *[c for c in profiles.columns if c.startswith("receiver_")]).withColumnRenamed("account", "__r")
    df = df.join(s, F.col("sender") == F.col("__s"), "left").join(r, F.col("receiver") == F.col("__r"), "left").drop("__s", "__r")
    a = F.col("amount")
    return df.withColumns({
        "amount_to_sender_median": ratio(a, F.col("sender_median_amount")), "amount_to_receiver_median": ratio(a, F.col("receiver_median_amount")),
        "amount_zscore_sender": ratio(a - F.col("sender_mean_amount"), F.col("sender_std_amount")), "amount_to_sender_max": ratio(a, F.col("sender_max_amount")),
    })


def fit_pairs(train: DataFrame) -> DataFrame:
    return train.where("sender is not null and receiver is not null").groupBy("sender", "receiver").agg(F.count("amount").alias("pair_count"), F.sum("amount").alias("pair_amount_sum"), F.avg("amount").alias("pair_amount_mean"), F.max("epoch").alias("pair_last_ts"))


def apply_pairs(df: DataFrame, pairs: DataFrame) -> DataFrame:
    p = pairs.select(F.col("sender").alias("__s"), F.col("receiver").alias("__r"), "pair_count", "pair_amount_sum", "pair_amount_mean")
    df = df.join(p, (F.col("sender") == F.col("__s")) & (F.col("receiver") == F.col("__r")), "left").withColumn("is_new_pair", F.col("__s").isNull().cast("int")).drop("__s", "__r")
    return df.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("pair_count", "pair_amount_sum", "pair_amount_mean")})
