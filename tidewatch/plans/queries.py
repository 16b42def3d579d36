"""Queries over the driver's tables, each with the DuckDB SQL of the same result where SQL can express it."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions import calendar
from tidewatch.functions.scalar import bucketize, ratio, two_proportion_ztest, verdict, ztest_column
from tidewatch.operators import features as f
from tidewatch.operators import graph, lift, rules
from tidewatch.plans import matrix as mx
from tidewatch.sources.generator import N_TOTAL, TYPOLOGIES, generate
from tidewatch.sources.shared import exists, new_path, scratch, shared_dir, state, stored
from tidewatch.sources.transactions import NAMES, RAW, append_csv, load_dataset, load_periods, sample_rows, save_table, txn, txn_large, write_report
from tidewatch.streaming import alerts

INF = math.inf
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_CUR = "['Dollar','Euro','Pound','Yen','Franc']"
TXN = f"""u as (select coalesce(max(user_id), 0) + 1 as users from events),
e0 as (select event_id, user_id, cast(regexp_extract(props, '"k": *([0-9]+)', 1) as integer) as k, round(value * 150, 2) as amount, date_trunc('minute', ts) as ts, event_type from events),
e1 as (select event_id as txn_id, 'ACC_' || lpad(cast(user_id as varchar), 7, '0') as sender, 'ACC_' || lpad(cast(k % users as varchar), 7, '0') as receiver, amount, ts, event_type as payment_type,
  {_CUR}[cast(user_id % 5 + 1 as integer)] as pay_currency, {_CUR}[cast(k % 5 + 1 as integer)] as rec_currency, a.n_name as sender_loc, b.n_name as receiver_loc,
  cast((amount >= 9000 and amount < 10000 and event_id % 2 = 0) or event_id % 211 = 0 as integer) as is_laundering
  from e0 cross join u left join nation a on a.n_nationkey = user_id % 25 left join nation b on b.n_nationkey = k % 25),
txn as (select *, case when is_laundering = 1 then case when amount between 9000 and 9999.99 then 'Structuring' else 'Type_' || payment_type end end as laundering_type,
  cast(ts as date) as date, cast(month(ts) as integer) as month, cast(day(ts) as integer) as day, cast(hour(ts) as integer) as hour, cast(minute(ts) as integer) as minute, cast(isodow(ts) - 1 as integer) as day_of_week,
  cast(isodow(ts) >= 6 as integer) as is_weekend, cast(hour(ts) between 0 and 5 as integer) as is_night, cast(epoch(ts) as bigint) as epoch from e1)"""
LARGE = """nc as (select count(*) as n from customer),
big as (select l_orderkey, l_linenumber, 'C' || lpad(cast(o_custkey as varchar), 7, '0') as sender, 'C' || lpad(cast(l_partkey % n as varchar), 7, '0') as receiver, l_extendedprice as amount, cast(l_shipdate as date) as date,
  'L' || cast(o_custkey % 25 as varchar) as sender_loc, 'L' || cast(l_partkey % 25 as varchar) as receiver_loc, l_returnflag as payment_type, cast(l_quantity > 48 and l_returnflag = 'R' as integer) as is_laundering
  from lineitem join orders on l_orderkey = o_orderkey cross join nc)"""
SPLIT = "q as (select quantile_cont(epoch, 0.70) as q1, quantile_cont(epoch, 0.85) as q2 from txn), sp as (select txn.*, case when epoch <= q1 then 'train' when epoch <= q2 then 'val' else 'test' end as period from txn, q)"
EDGES = "edges as (select sender, receiver, count(*) as n_txn, sum(amount) as amount_sum, avg(amount) as amount_mean, max(amount) as amount_max, max({t}) as last_ts from {v} group by 1, 2)"


def neat(df: DataFrame) -> DataFrame:
    """Doubles to four decimals, dates as text, so that results compare by value."""
    out = []
    for n, t in df.dtypes:
        c = F.round(F.col(n), 4) if t in ("double", "float") else F.col(n).cast("string") if t.startswith(("date", "timestamp")) else F.col(n).cast("long") if t in ("int", "tinyint", "smallint", "bigint") else F.col(n)
        out.append(c.alias(n))
    return df.select(*out)


def neat_sql(sql: str, doubles: str = "", longs: str = "") -> str:
    """The same for DuckDB: names of double and integer columns of the final SELECT `x`."""
    rep = [f"round({c}, 4) as {c}" for c in doubles.split()] + [f"cast({c} as bigint) as {c}" for c in longs.split()]
    return sql.replace("select_x", f"select * replace ({', '.join(rep)}) from x" if rep else "select * from x")


def query(name: str, sql: str | None = None, doubles: str = "", longs: str = ""):
    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: neat(fn(spark, sf_dir))
        QUERIES[name].__doc__ = fn.__doc__
        if sql is not None:
            SQL[name] = neat_sql("with " + sql.replace("@txn", TXN).replace("@big", LARGE).replace("@split", SPLIT) + " select_x", doubles, longs)
        return fn

    return wrap


# --- rows ---------------------------------------------------------------------------------------------------------------

@query("tx_amount_flags", "@txn, x as (select txn_id, ln(1 + amount) as amount_log, cast(amount >= 9000 and amount < 10000 as integer) as amount_near_threshold, cast(amount >= 10000 as integer) as amount_above_threshold, cast(round(amount, 2) % 100 = 0 as integer) as is_round_100, cast(round(amount, 2) % 1000 = 0 as integer) as is_round_1000 from txn)", "amount_log", "amount_near_threshold amount_above_threshold is_round_100 is_round_1000")
def _(s, d):
    return f.amount_flags(txn(s, d)).select("txn_id", "amount_log", "amount_near_threshold", "amount_above_threshold", "is_round_100", "is_round_1000")


@query("tx_border_currency", "@txn, x as (select txn_id, cast(sender_loc is distinct from receiver_loc as integer) as is_cross_border, cast(pay_currency is distinct from rec_currency as integer) as is_currency_mismatch from txn)", "", "is_cross_border is_currency_mismatch")
def _(s, d):
    return f.border_flags(txn(s, d)).select("txn_id", "is_cross_border", "is_currency_mismatch")


@query("tx_calendar", "@txn, x as (select txn_id, cast(date as varchar) as date, month, day, hour, minute, day_of_week, is_weekend, is_night, epoch from txn)", "", "month day hour minute day_of_week is_weekend is_night")
def _(s, d):
    return txn(s, d).select("txn_id", "date", "month", "day", "hour", "minute", "day_of_week", "is_weekend", "is_night", "epoch")


_CODES = ", ".join(f"(select count(distinct {c}) from txn y where y.{c} < txn.{c}) as {k}" for k, c in f.CODED.items())


@query("tx_category_codes", "@txn, " + ", ".join(f"v{i} as (select {c} as v, row_number() over (order by {c}) - 1 as code from (select distinct {c} from txn where {c} is not null))" for i, c in enumerate(f.CODED.values()))
       + ", x as (select txn_id, " + ", ".join(f"coalesce(v{i}.code, -1) as {k}" for i, k in enumerate(f.CODED)) + " from txn " + " ".join(f"left join v{i} on v{i}.v = txn.{c}" for i, c in enumerate(f.CODED.values())) + ")", "", " ".join(f.CODED))
def _(s, d):
    t = txn(s, d)
    return f.apply_codes(t, {k: f.fit_codes(t, c) for k, c in f.CODED.items()}).select("txn_id", *f.CODED)


_FORMATS = " union all ".join(f"select {i} as i, '{a}' as name, avg(cast(try_strptime(s, '{b}') is not null as integer)) as score, count(try_strptime(s, '{b}')) as ok, count(*) as n from o" for i, (a, b) in enumerate(zip(calendar.DATE_FORMATS, ("%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%Y/%m/%d", "%d-%m-%Y", "%m-%d-%Y", "%d.%m.%Y", "%Y%m%d"), strict=True)))


@query("date_format_inference", f"o as (select strftime(o_orderdate, '%d/%m/%Y') as s from orders), sc as ({_FORMATS}), x as (select n, ok as n_parsed, name as format, score from sc order by score desc, i limit 1)", "score")
def _(s, d):
    o = s.read.parquet(f"{d}/orders.parquet").select(F.date_format("o_orderdate", "dd/MM/yyyy").alias("Date"))
    fmt, score = calendar.infer_date_format(o, "Date")
    parsed = F.to_date(F.try_to_timestamp("Date", F.lit(fmt))) if fmt else calendar.parse_mixed(F.col("Date"))
    return o.agg(F.count(F.lit(1)).alias("n"), F.count(parsed).alias("n_parsed")).withColumns({"format": F.lit(fmt), "score": F.lit(score)})


# --- split, balance, quality --------------------------------------------------------------------------------------------

@query("time_split_counts", "@txn, @split, x as (select period, count(*) as n, sum(is_laundering) as n_laundering from sp group by period)", "", "n_laundering")
def _(s, d):
    return f.time_split(txn(s, d)).groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.sum("is_laundering").alias("n_laundering"))


@query("split_leak_check", "@txn, @split, x as (select max(epoch) filter (period = 'train') as train_end, min(epoch) filter (period = 'test') as test_start, max(epoch) filter (period = 'train') <= min(epoch) filter (period = 'test') as ok from sp)")
def _(s, d):
    a, b = f.assert_no_leakage(f.time_split(txn(s, d)))
    return s.range(1).select(F.lit(a).cast("long").alias("train_end"), F.lit(b).cast("long").alias("test_start"), F.lit(True if a is None or b is None else a <= b).alias("ok"))


@query("class_balance", "@txn, x as (select count(*) as n, sum(is_laundering) as positives, count(*) - sum(is_laundering) as negatives, avg(is_laundering) as base_rate, (count(*) - sum(is_laundering)) / nullif(cast(sum(is_laundering) as double), 0) as imbalance_ratio from txn)", "base_rate imbalance_ratio", "positives negatives")
def _(s, d):
    t = txn(s, d).agg(F.count(F.lit(1)).alias("n"), F.sum("is_laundering").alias("positives"))
    return t.withColumns({"negatives": F.col("n") - F.col("positives"), "base_rate": ratio(F.col("positives"), F.col("n")), "imbalance_ratio": ratio(F.col("n") - F.col("positives"), F.col("positives"))})


_COLS = ["txn_id", "sender", "receiver", "amount", "payment_type", "pay_currency", "rec_currency", "sender_loc", "receiver_loc", "is_laundering", "laundering_type"]


@query("missing_report", "@txn, " + "m as (" + " union all ".join(f"select '{c}' as \"column\", count(*) filter ({c} is null) as n_missing, count(*) as n from txn" for c in _COLS) + "), x as (select \"column\", n_missing, n_missing * 100.0 / n as pct from m where n_missing > 0)", "pct")
def _(s, d):
    return lift.missing_report(txn(s, d).select(*_COLS))


@query("quality_checks", "@big, x as (select count(*) as n, count(*) - (select count(*) from (select distinct * from big)) as full_duplicates, count(*) - (select count(*) from (select distinct sender, receiver, amount, date from big)) as key_duplicates, count(*) filter (sender = receiver) as self_transfers, count(*) filter (amount <= 0) as not_positive, count(*) filter (amount = 0) as zero, count(*) filter (amount is null) as null_amount from big)")
def _(s, d):
    t = stored(txn_large(s, d), "large")
    n = t.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("sender") == F.col("receiver")).alias("self_transfers"), F.count_if(F.col("amount") <= 0).alias("not_positive"), F.count_if(F.col("amount") == 0).alias("zero"), F.count_if(F.col("amount").isNull()).alias("null_amount"))
    full, key = t.distinct().count(), t.select("sender", "receiver", "amount", "date").distinct().count()
    return n.withColumns({"full_duplicates": F.col("n") - full, "key_duplicates": F.col("n") - key})


_MATRIX_CORR = ["amount", "amount_log", "hour", "day_of_week", "is_night", "amount_near_threshold", "vel_count_24h", "vel_amount_sum_24h"]
_FLAGGED = "fl as (select *, ln(1 + amount) as amount_log, cast(amount >= 9000 and amount < 10000 as integer) as amount_near_threshold, cast(amount >= 10000 as integer) as amount_above_threshold from txn)"
_NEAR = "cast(amount >= 9000 and amount < 10000 as integer)"
_VEL = "vel as (select *, " + ", ".join(f"count(*) over w{h} as vel_count_{h}h, sum(amount) over w{h} as vel_amount_sum_{h}h" + (f", sum({_NEAR}) over w{h} as vel_near_threshold_count_{h}h" if h >= 24 else "") for h in f.WINDOWS) + " from {v} window " + ", ".join(f"w{h} as (partition by sender order by epoch range between {h * 3600 - 1} preceding and current row)" for h in f.WINDOWS) + ")"
_VTXN, _VSP = _VEL.replace("{v}", "txn"), _VEL.replace("{v}", "sp")


def _corr_rows(view: str, cols: list[str]) -> str:
    return " union all ".join(f"select '{a}' as a, '{b}' as b, corr({a}, {b}) as corr from {view}" for i, a in enumerate(cols) for b in cols[i + 1 :])


def _vel_frame(s, d):
    return f.amount_flags(f.velocity(txn(s, d)))


@query("corr_matrix", "@txn, " + _VTXN + ", " + _FLAGGED.replace("from txn", "from vel") + ", x0 as (" + _corr_rows("fl", _MATRIX_CORR) + "), x as (select a, b, case when isnan(corr) then null else corr end as corr from x0)", "corr")
def _(s, d):
    return lift.correlations(_vel_frame(s, d), _MATRIX_CORR)


@query("leakage_corr", "@txn, " + _VTXN + ", " + _FLAGGED.replace("from txn", "from vel") + ", c0 as (" + " union all ".join(f"select '{c}' as feature, abs(corr({c}, is_laundering)) as abs_corr, count({c}) as n, min({c}) < max({c}) as v from fl" for c in _MATRIX_CORR) + "), x as (select feature, abs_corr, abs_corr > 0.9 as leaks from c0 where n >= 100 and v order by abs_corr desc, feature limit 10)", "abs_corr")
def _(s, d):
    return lift.feature_leakage(_vel_frame(s, d), _MATRIX_CORR)


@query("max_corr_filled", "@txn, @split, " + _VSP + ", pr as (select sender as account, median(amount) as med from sp where period = 'train' group by sender), z as (select coalesce(vel_amount_sum_24h / nullif(med, 0), 0) as a, amount as b, is_laundering as y from vel left join pr on account = sender), x as (select greatest(abs(corr(a, y)), abs(corr(b, y))) as max_corr from z)", "max_corr")
def _(s, d):
    t = _behaved(s, d)
    c = lift.correlations(t.select("is_laundering", "vel_amount_24h_to_median", "amount"), ["is_laundering", "vel_amount_24h_to_median", "amount"], 0.0)
    return c.where("a = 'is_laundering'").agg(F.max(F.abs("corr")).alias("max_corr"))


# --- description --------------------------------------------------------------------------------------------------------

def _describe_sql(view: str, by: str, col: str) -> str:
    return f"x as (select {by}, count({col}) as n, avg({col}) as mean, stddev_samp({col}) as std, min({col}) as min, " + ", ".join(f"quantile_cont({col}, {q}) as {n}" for q, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.95, "p95"), (0.99, "p99"))) + f", max({col}) as max from {view} group by {by})"


_DESC = "mean std min p25 p50 p75 p95 p99 max"


@query("amount_describe_by_class", "@txn, " + _describe_sql("txn", "is_laundering", "amount"), _DESC, "is_laundering")
def _(s, d):
    return lift.describe(txn(s, d), ["is_laundering"], "amount")


@query("degree_describe", "@big, " + EDGES.replace("{v}", "big").replace("{t}", "date") + ", dg as (select sender as account, count(*) as deg from edges group by 1), pos as (select sender as account, max(is_laundering) as cls from big group by 1), j as (select cls, cast(deg as double) as deg from dg join pos using (account)), " + _describe_sql("j", "cls", "deg"), _DESC, "cls")
def _(s, d):
    t = txn_large(s, d)
    one = t.groupBy("sender").agg(F.countDistinct("receiver").cast("double").alias("deg"), F.max("is_laundering").alias("cls"))
    return lift.describe(one, ["cls"], "deg")


@query("typology_summary", "@txn, x as (select laundering_type, count(*) as n, count(*) * 100.0 / sum(count(*)) over () as pct, count(distinct sender) as n_senders, median(amount) as median_amount, max(amount) as max_amount from txn where is_laundering = 1 group by laundering_type)", "pct median_amount max_amount")
def _(s, d):
    t = txn(s, d).where("is_laundering = 1").groupBy("laundering_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sender").alias("n_senders"), F.median("amount").alias("median_amount"), F.max("amount").alias("max_amount"))
    return t.withColumn("pct", ratio(F.col("n") * 100.0, F.sum("n").over(Window.partitionBy(F.lit(0)))))


# --- rates --------------------------------------------------------------------------------------------------------------

def _rate_sql(view: str, by: str, names: str, least: int = 1, where: str = "true", share: bool = True) -> str:
    sh = ", sum(is_laundering) * 100.0 / nullif((select sum(is_laundering) from {v}), 0) as share_pct".replace("{v}", view) if share else ""
    return f"x as (select {by}, count(*) as n, sum(is_laundering) as n_laundering, avg(is_laundering) * 100 as rate_pct, avg(is_laundering) / nullif((select avg(is_laundering) from {view} where {where if not share else 'true'}), 0) as lift{sh} from {view} where {where} group by {names} having count(*) >= {least})"


_RATE, _BUCKET = "rate_pct lift share_pct", "rate_pct lift"
for _name, _view, _by, _least in (("rate_by_payment_type", "txn", ["payment_type"], 1), ("rate_by_corridor", "big", ["sender_loc", "receiver_loc"], 20), ("rate_by_currency_pair", "txn", ["pay_currency", "rec_currency"], 1), ("rate_by_hour", "txn", ["hour"], 1), ("rate_by_dow", "txn", ["day_of_week"], 1)):

    @query(_name, ("@txn, " if _view == "txn" else "@big, ") + _rate_sql(_view, ", ".join(_by), ", ".join(_by), _least), _RATE, "n_laundering" + "".join(f" {c}" for c in _by if c in ("hour", "day_of_week")))
    def _(s, d, view=_view, by=_by, least=_least):
        return lift.rate_by_group((txn if view == "txn" else txn_large)(s, d), by, min_support=least)


@query("rate_by_location_topn", "@big, " + _rate_sql("big", "sender_loc", "sender_loc").replace("x as", "y as") + ", x as (select * from y order by lift desc, sender_loc limit 10)", _RATE, "n_laundering")
def _(s, d):
    return lift.rate_by_group(txn_large(s, d), ["sender_loc"]).orderBy(F.desc("lift"), "sender_loc").limit(10)


def _bucket_sql(expr: str, edges: list[float], labels: list[str]) -> str:
    return "case " + " ".join(f"when {expr} >= {lo} and {expr} < {'1e308' if hi == INF else hi} then '{lb}'" for lo, hi, lb in zip(edges, edges[1:], labels, strict=False)) + " end"


RATIO_BINS = ([0, 0.5, 0.9, 1.1, 2, 5, 10, 50, INF], ["<0.5x", "0.5-0.9x", "0.9-1.1x", "1.1-2x", "2-5x", "5-10x", "10-50x", ">50x"])
DAY_BINS = ([1, 2, 3, 4, 5, 10, 20, 50, INF], ["1", "2", "3", "4", "5-9", "10-19", "20-49", "50+"])
GAP_BINS = ([0, 1, 5, 30, 120, 720, 1440, 10080, INF], ["<1 min", "1-5 min", "5-30 min", "0.5-2 h", "2-12 h", "12-24 h", "1-7 days", ">7 days"])
BURST_BINS = ([1, 2, 3, 5, 10, 20, INF], ["1", "2", "3-4", "5-9", "10-19", "20+"])
DEGREE_BINS = ([1, 2, 5, 10, 25, 50, 100, 500, INF], ["1", "2-4", "5-9", "10-24", "25-49", "50-99", "100-499", "500+"])
PAIR_BINS = ([1, 2, 3, 5, 10, 25, INF], ["1", "2", "3-4", "5-9", "10-24", "25+"])


@query("amount_bins_lift", "@txn, b as (select *, floor(amount / 1000) * 1000 + 500 as bin_mid from txn where amount >= 0 and amount < 20000), x as (select bin_mid, count(*) as n, sum(is_laundering) as n_laundering, avg(is_laundering) * 100 as rate_pct, avg(is_laundering) / (select avg(is_laundering) from b) as lift from b group by bin_mid)", "bin_mid rate_pct lift", "n_laundering")
def _(s, d):
    t = txn(s, d).where("amount >= 0 and amount < 20000").withColumn("bin_mid", F.floor(F.col("amount") / 1000) * 1000.0 + 500)
    return lift.rate_by_group(t, ["bin_mid"]).drop("share_pct")


@query("behaviour_ratio_lift", "@txn, m as (select *, amount / nullif(median(amount) over (partition by sender), 0) as r from txn), b as (select *, " + _bucket_sql("r", *RATIO_BINS) + " as bucket from m), " + _rate_sql("b", "bucket", "bucket", 1, "bucket is not null", False), _BUCKET, "n_laundering")
def _(s, d):
    t = txn(s, d)
    med = t.groupBy(F.col("sender").alias("__s")).agg(F.median("amount").alias("med"))
    t = t.join(med, F.col("sender") == F.col("__s"))
    return lift.rate_by_bucket(t, bucketize(ratio(F.col("amount"), F.col("med")), *RATIO_BINS))


@query("pct_rank_in_currency", "@txn, x as (select txn_id, (rank() over (partition by pay_currency order by amount) + (count(*) over (partition by pay_currency, amount) - 1) / 2.0) * 100.0 / count(*) over (partition by pay_currency) as pct_rank from txn)", "pct_rank")
def _(s, d):
    t = txn(s, d)
    # Ranks come from the counts of distinct amounts, so a currency's window holds amounts, not rows.
    per = t.groupBy("pay_currency", "amount").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("pay_currency").orderBy("amount")
    per = per.select(F.col("pay_currency").alias("pc"), F.col("amount").alias("am"), ((F.sum("c").over(w) - F.col("c") + 1 + (F.col("c") - 1) / 2) * 100.0 / F.sum("c").over(Window.partitionBy("pay_currency"))).alias("pct_rank"))
    return t.join(per, F.col("pay_currency").eqNullSafe(F.col("pc")) & (F.col("amount") == F.col("am"))).select("txn_id", "pct_rank")


@query("daily_trend", "@txn, x as (select cast(date as varchar) as date, count(*) as n, sum(is_laundering) as n_laundering, avg(is_laundering) * 100 as rate_pct from txn group by date)", "rate_pct", "n_laundering")
def _(s, d):
    return txn(s, d).groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum("is_laundering").alias("n_laundering"), (F.avg("is_laundering") * 100).alias("rate_pct"))


def _two_level_sql(keys: str, bins) -> str:
    return f"g as (select {keys}, count(*) as c, sum(is_laundering) as l from txn group by {keys}), b as (select *, {_bucket_sql('c', *bins)} as bucket from g), x as (select bucket, count(*) as n_groups, sum(c) as n, sum(l) as n_laundering, sum(l) * 100.0 / sum(c) as rate_pct, sum(l) / cast(sum(c) as double) / (select avg(is_laundering) from txn) as lift from b group by bucket)"


def _two_level(t: DataFrame, keys: list[str], bins) -> DataFrame:
    n, x = lift.base_rate(t)
    g = t.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"), F.sum("is_laundering").alias("l"))
    g = g.groupBy(bucketize(F.col("c"), *bins).alias("bucket")).agg(F.count(F.lit(1)).alias("n_groups"), F.sum("c").alias("n"), F.sum("l").alias("n_laundering"))
    rate = ratio(F.col("n_laundering"), F.col("n"))
    return g.withColumns({"rate_pct": rate * 100, "lift": ratio(rate, F.lit(x / n if n else None))})


@query("velocity_per_day_buckets", "@txn, " + _two_level_sql("sender, date", DAY_BINS), _BUCKET, "n n_laundering")
def _(s, d):
    return _two_level(txn(s, d), ["sender", "date"], DAY_BINS)


@query("hourly_burst_buckets", "@txn, " + _two_level_sql("sender, date, hour", BURST_BINS), _BUCKET, "n n_laundering")
def _(s, d):
    return _two_level(txn(s, d), ["sender", "date", "hour"], BURST_BINS)


_ORD = "case bucket " + " ".join(f"when '{b}' then {i}" for i, b in enumerate(DAY_BINS[1])) + " end"


@query("velocity_threshold_bucket", "@txn, " + _two_level_sql("sender, date", DAY_BINS).replace("x as", "y as") + f", x as (select min_by(bucket, {_ORD}) as bucket from y where lift >= 3)")
def _(s, d):
    y = _two_level(txn(s, d), ["sender", "date"], DAY_BINS).where("lift >= 3")
    return y.agg(F.min_by("bucket", F.array_position(F.array(*[F.lit(b) for b in DAY_BINS[1]]), F.col("bucket"))).alias("bucket"))


@query("inter_arrival_buckets", "@txn, g as (select *, (epoch - lag(epoch) over (partition by sender order by epoch, txn_id)) / 60.0 as gap from txn), b as (select *, " + _bucket_sql("gap", *GAP_BINS) + " as bucket from g where gap is not null), " + _rate_sql("b", "bucket", "bucket", 1, "bucket is not null", False), _BUCKET, "n_laundering")
def _(s, d):
    t = txn(s, d).withColumn("gap", (F.col("epoch") - F.lag("epoch").over(Window.partitionBy("sender").orderBy("epoch", "txn_id"))) / 60).where("gap is not null")
    return lift.rate_by_bucket(t, bucketize(F.col("gap"), *GAP_BINS))


def _z_sql(x1: str, n1: str, x2: str, n2: str) -> str:
    p = f"(({x1} + {x2}) / nullif(cast({n1} + {n2} as double), 0))"
    return f"({x1} / nullif(cast({n1} as double), 0) - {x2} / nullif(cast({n2} as double), 0)) / nullif(sqrt({p} * (1 - {p}) * (1.0 / nullif({n1}, 0) + 1.0 / nullif({n2}, 0))), 0)"


def _band_sql(view: str, cond: str, out: str = "x") -> str:
    z = _z_sql("x1", "n1", "x2", "n2")
    return f"c0 as (select count(*) filter ({cond}) as n1, coalesce(sum(is_laundering) filter ({cond}), 0) as x1, count(*) filter (not ({cond})) as n2, coalesce(sum(is_laundering) filter (not ({cond})), 0) as x2 from {view}), {out} as (select 'inside' as side, n1 as n, x1 as n_laundering, x1 * 100.0 / nullif(n1, 0) as rate_pct, (x1 / nullif(cast(n1 as double), 0)) / nullif(x2 / nullif(cast(n2 as double), 0), 0) as lift_vs_other, {z} as z from c0 union all select 'outside', n2, x2, x2 * 100.0 / nullif(n2, 0), 1.0, {z} from c0)"


_BAND = "rate_pct lift_vs_other z"


@query("structuring_band_compare", "@txn, " + _band_sql("txn", "amount >= 9000 and amount < 10000"), _BAND, "n_laundering")
def _(s, d):
    return lift.compare_band(txn(s, d), (F.col("amount") >= 9000) & (F.col("amount") < 10000))


@query("below_above_band_ztest", "@txn, c as (select count(*) filter (amount >= 9000 and amount < 10000) as n1, coalesce(sum(is_laundering) filter (amount >= 9000 and amount < 10000), 0) as x1, count(*) filter (amount >= 10000 and amount < 11000) as n2, coalesce(sum(is_laundering) filter (amount >= 10000 and amount < 11000), 0) as x2 from txn), x as (select n1, x1, n2, x2, " + _z_sql("x1", "n1", "x2", "n2") + " as z from c)", "z", "x1 x2")
def _(s, d):
    a, y = F.col("amount"), F.col("is_laundering")
    lo, hi = (a >= 9000) & (a < 10000), (a >= 10000) & (a < 11000)
    t = txn(s, d).agg(F.count_if(lo).alias("n1"), F.coalesce(F.sum(F.when(lo, y)), F.lit(0)).alias("x1"), F.count_if(hi).alias("n2"), F.coalesce(F.sum(F.when(hi, y)), F.lit(0)).alias("x2"))
    return t.withColumn("z", ztest_column(F.col("x1"), F.col("n1"), F.col("x2"), F.col("n2")))


def _p_sql(z: str) -> str:
    """erfc(|z| / sqrt 2), which DuckDB lacks, by the series of erf; beyond 4 it is under 2e-8."""
    x = f"greatest(1e-12, least(4.0, abs({z}) / sqrt(2.0)))"
    term = f"(case when n % 2 = 0 then 1.0 else -1.0 end) * exp((2 * n + 1) * ln({x}) - lgamma(n + 1.0)) / (2 * n + 1)"
    return f"1.0 - 2.0 / sqrt(pi()) * list_sum(list_transform(range(0, 90), lambda n: {term}))"


@query("ztest_p_value", "@txn, c as (select count(*) filter (amount >= 9000 and amount < 10000) as n1, coalesce(sum(is_laundering) filter (amount >= 9000 and amount < 10000), 0) as x1, count(*) filter (amount >= 10000 and amount < 11000) as n2, coalesce(sum(is_laundering) filter (amount >= 10000 and amount < 11000), 0) as x2 from txn), z0 as (select " + _z_sql("x1", "n1", "x2", "n2") + " as z from c), x as (select z, " + _p_sql("z") + " as p from z0)", "z p")
def _(s, d):
    """p by erfc on the four counts; Spark has no erfc."""
    r = QUERIES["below_above_band_ztest"](s, d).first()
    z, p = two_proportion_ztest(r["x1"], r["n1"], r["x2"], r["n2"])
    return s.range(1).select(F.lit(z).alias("z"), F.lit(p).alias("p"))


def _flags_sql(view: str, flags: dict[str, str]) -> str:
    one = lambda k, c: f"select '{k}' as flag, count(*) filter ({c}) as n1, coalesce(sum(is_laundering) filter ({c}), 0) as x1, count(*) filter (not ({c})) as n2, coalesce(sum(is_laundering) filter (not ({c})), 0) as x2 from {view}"
    return "c as (" + " union all ".join(one(k, c) for k, c in flags.items()) + "), x as (select flag, n1 as n, n1 * 100.0 / (n1 + n2) as share_pct, x1 * 100.0 / nullif(n1, 0) as rate_in_pct, x2 * 100.0 / nullif(n2, 0) as rate_out_pct, (x1 / nullif(cast(n1 as double), 0)) / nullif(x2 / nullif(cast(n2 as double), 0), 0) as lift, " + _z_sql("x1", "n1", "x2", "n2") + " as z from c)"


_CHECK = "share_pct rate_in_pct rate_out_pct lift z"


@query("round_amount_checks", "@txn, " + _flags_sql("txn", {f"round_{u}": f"round(amount, 0) % {u} = 0" for u in (10, 100, 1000, 10000)}), _CHECK)
def _(s, d):
    return lift.flag_checks(txn(s, d), {f"round_{u}": F.round("amount", 0) % u == 0 for u in (10, 100, 1000, 10000)})


@query("border_flag_checks", "@txn, " + _flags_sql("txn", {"cross_border": "sender_loc is distinct from receiver_loc", "currency_mismatch": "pay_currency is distinct from rec_currency"}), _CHECK)
def _(s, d):
    return lift.flag_checks(txn(s, d), {"cross_border": ~F.col("sender_loc").eqNullSafe(F.col("receiver_loc")), "currency_mismatch": ~F.col("pay_currency").eqNullSafe(F.col("rec_currency"))})


@query("near_threshold_rule_preview", "@txn, nd as (select sender, date, sum(" + _NEAR + ") as c from txn group by 1, 2), mx as (select sender as s, max(c) as m from nd group by 1), j as (select * from txn join mx on s = sender), " + ", ".join(f"s{k} as (select {k} as k, count(*) filter (m >= {k}) as n1, coalesce(sum(is_laundering) filter (m >= {k}), 0) as x1, count(*) filter (m < {k}) as n2, coalesce(sum(is_laundering) filter (m < {k}), 0) as x2, count(distinct sender) filter (m >= {k}) as n_senders from j)" for k in (2, 3, 5)) + ", c as (select * from s2 union all select * from s3 union all select * from s5), x as (select k, n_senders, n1 as n, x1 as n_laundering, (x1 / nullif(cast(n1 as double), 0)) / nullif(x2 / nullif(cast(n2 as double), 0), 0) as lift_vs_other, " + _z_sql("x1", "n1", "x2", "n2") + " as z from c)", "lift_vs_other z", "k n_laundering")
def _(s, d):
    t = f.amount_flags(txn(s, d))
    per = t.groupBy("sender", "date").agg(F.sum("amount_near_threshold").alias("c"), F.count(F.lit(1)).alias("n"), F.sum("is_laundering").alias("x"))
    per = per.groupBy("sender").agg(F.max("c").alias("m"), F.sum("n").alias("n"), F.sum("x").alias("x"))
    out = None
    for k in (2, 3, 5):
        m = F.col("m") >= k
        r = per.agg(F.lit(k).alias("k"), F.count_if(m).alias("n_senders"), F.coalesce(F.sum(F.when(m, F.col("n"))), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(m, F.col("x"))), F.lit(0)).alias("n_laundering"), F.coalesce(F.sum(F.when(~m, F.col("n"))), F.lit(0)).alias("n2"), F.coalesce(F.sum(F.when(~m, F.col("x"))), F.lit(0)).alias("x2"))
        out = r if out is None else out.unionAll(r)
    c = F.col
    return out.select("k", "n_senders", "n", "n_laundering", ratio(ratio(c("n_laundering"), c("n")), ratio(c("x2"), c("n2"))).alias("lift_vs_other"), ztest_column(c("n_laundering"), c("n"), c("x2"), c("n2")).alias("z"))


@query("corridor_pivot", "@big, ts as (select sender_loc from big where sender_loc is not null group by 1 order by count(*) desc, sender_loc limit 12), tr as (select receiver_loc from big where receiver_loc is not null group by 1 order by count(*) desc, receiver_loc limit 12), x as (select sender_loc, receiver_loc, avg(is_laundering) * 100 as rate_pct from big where sender_loc in (select sender_loc from ts) and receiver_loc in (select receiver_loc from tr) group by 1, 2)", "rate_pct")
def _(s, d):
    """The pivot's cells as rows: its columns are named by the data."""
    wide = corridor_pivot(txn_large(s, d))
    return wide.unpivot("sender_loc", [c for c in wide.columns if c != "sender_loc"], "receiver_loc", "rate_pct").where("rate_pct is not null")


def corridor_pivot(t: DataFrame, n: int = 12) -> DataFrame:
    """Rates of the n busiest sender by the n busiest receiver locations, by rows of the whole table, ties by name."""
    senders, receivers = ([r[0] for r in t.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(n).collect()] for c in ("sender_loc", "receiver_loc"))
    t = t.where(F.col("sender_loc").isin(senders) & F.col("receiver_loc").isin(receivers))
    return t.groupBy("sender_loc").pivot("receiver_loc", sorted(receivers)).agg(F.avg("is_laundering") * 100)


@query("degree_bucket_lift", "@txn, g as (select *, count(*) over (partition by sender) as o, count(*) over (partition by receiver) as i from txn), b as (select 'fan_out' as side, " + _bucket_sql("o", *DEGREE_BINS) + " as bucket, is_laundering from g union all select 'fan_in', " + _bucket_sql("i", *DEGREE_BINS) + ", is_laundering from g), x as (select side, bucket, count(*) as n, sum(is_laundering) as n_laundering, avg(is_laundering) * 100 as rate_pct, avg(is_laundering) / (select avg(is_laundering) from txn) as lift from b group by 1, 2)", _BUCKET, "n_laundering")
def _(s, d):
    t = txn(s, d)
    n, x = lift.base_rate(t)
    out = None
    for side, key in (("fan_out", "sender"), ("fan_in", "receiver")):
        g = t.groupBy(key).agg(F.count(F.lit(1)).alias("c"), F.sum("is_laundering").alias("l")).select(F.lit(side).alias("side"), bucketize(F.col("c"), *DEGREE_BINS).alias("bucket"), "c", "l")
        out = g if out is None else out.unionAll(g)
    out = out.groupBy("side", "bucket").agg(F.sum("c").alias("n"), F.sum("l").alias("n_laundering"))
    rate = ratio(F.col("n_laundering"), F.col("n"))
    return out.withColumns({"rate_pct": rate * 100, "lift": ratio(rate, F.lit(x / n if n else None))})


@query("pair_frequency_lift", "@txn, " + _two_level_sql("sender, receiver", PAIR_BINS), _BUCKET, "n n_laundering")
def _(s, d):
    return _two_level(txn(s, d), ["sender", "receiver"], PAIR_BINS)


@query("pass_through_accounts", "@txn, both_sides as (select sender as a from txn intersect select receiver from txn), j as (select txn.*, a is not null as through from txn left join both_sides on a = sender), " + _band_sql("j", "through", "y") + ", x as (select y.*, (select count(*) from both_sides) as n_accounts from y)", _BAND, "n_laundering n_accounts")
def _(s, d):
    t = txn(s, d)
    both = t.select(F.col("sender").alias("a")).intersect(t.select(F.col("receiver").alias("a")))
    n = both.count()
    j = t.join(both, F.col("sender") == F.col("a"), "left")
    return lift.compare_band(j, F.col("a").isNotNull()).withColumn("n_accounts", F.lit(n))


@query("mutual_pairs_eda", "@big, pr as (select distinct sender as s, receiver as r from big), mu as (select a.s, a.r from pr a join pr b on a.s = b.r and a.r = b.s where a.s <> a.r), j as (select big.*, mu.s is not null as m from big left join mu on mu.s = sender and mu.r = receiver), " + _band_sql("j", "m"), _BAND, "n_laundering")
def _(s, d):
    t = txn_large(s, d)
    mu = graph.mutual_pairs(t.select("sender", "receiver").distinct().where("sender <> receiver")).select(F.col("sender").alias("s"), F.col("receiver").alias("r"))
    return lift.compare_band(t.join(mu, (F.col("sender") == F.col("s")) & (F.col("receiver") == F.col("r")), "left"), F.col("s").isNotNull())


@query("turnover_concentration", "@big, a as (select sender, sum(amount) as s from big group by 1), r as (select s, row_number() over (order by s desc, sender) as rn, count(*) over () as n, sum(s) over () as tot from a), x as (select sum(s) filter (rn <= greatest(1, cast(floor(n * 0.01) as bigint))) * 100 / max(tot) as top1_pct, sum(s) filter (rn <= greatest(1, cast(floor(n * 0.05) as bigint))) * 100 / max(tot) as top5_pct from r)", "top1_pct top5_pct")
def _(s, d):
    a = stored(txn_large(s, d).groupBy("sender").agg(F.sum("amount").alias("s")), "turnover")
    n, total = a.agg(F.count(F.lit(1)), F.sum("s")).first()
    top = lambda p: a.orderBy(F.desc("s"), "sender").limit(max(1, int(n * p))).agg(F.sum("s")).first()[0]
    return s.range(1).select(F.lit(top(0.01) * 100 / total).alias("top1_pct"), F.lit(top(0.05) * 100 / total).alias("top5_pct"))


@query("top_illicit_senders", "@txn, x as (select sender, count(*) as n from txn where is_laundering = 1 group by sender order by n desc, sender limit 10)")
def _(s, d):
    return txn(s, d).where("is_laundering = 1").groupBy("sender").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "sender").limit(10)


@query("illicit_sender_share", "@txn, g as (select sender, count(*) as n from txn where is_laundering = 1 group by sender), r as (select n, row_number() over (order by n desc, sender) as rn, count(*) over () as k from g), x as (select max(k) as n_senders, sum(n) filter (rn <= greatest(1, k // 100)) * 100.0 / sum(n) as top1_pct from r)", "top1_pct")
def _(s, d):
    """Share of the positive rows that the top 1 % of their senders have, one sender at least."""
    a = stored(txn(s, d).where("is_laundering = 1").groupBy("sender").agg(F.count(F.lit(1)).alias("n")), "illicit")
    n, total = a.agg(F.count(F.lit(1)), F.sum("n")).first()
    return a.orderBy(F.desc("n"), "sender").limit(max(1, n // 100)).agg(F.lit(n).alias("n_senders"), (F.sum("n") * 100.0 / F.lit(total)).alias("top1_pct"))


_TOP1 = " union all ".join(f"(select '{k}' as kind, {g} as grp, count(*) as n, sum(is_laundering) as n_laundering, (sum(is_laundering) / cast(count(*) as double)) / (select avg(is_laundering) from txn) as lift from txn group by 2 having count(*) >= 20 order by lift desc, grp limit 1)" for k, g in (("corridor", "sender_loc || ' > ' || receiver_loc"), ("channel", "payment_type")))


@query("top_groups", "@txn, t as (" + _TOP1 + "), a as (select count(*) as all_n, sum(is_laundering) as all_x from txn), z0 as (select kind, grp, n, n_laundering, lift, " + _z_sql("n_laundering", "n", "(all_x - n_laundering)", "(all_n - n)") + " as z from t, a), x as (select kind, grp, n, n_laundering, lift, " + _p_sql("z") + " as p from z0)", "lift p", "n_laundering")
def _(s, d):
    """The corridor and the channel with the highest lift over the base rate among those with 20 rows, and p against all other rows."""
    t = txn(s, d)
    all_n, all_x = lift.base_rate(t)
    out = []
    for kind, group in (("corridor", F.concat_ws(" > ", "sender_loc", "receiver_loc")), ("channel", F.col("payment_type"))):
        for r in lift.rate_by_group(t.withColumn("grp", group), ["grp"], min_support=20).orderBy(F.desc("lift"), "grp").limit(1).collect():
            out.append((kind, r["grp"], r["n"], r["n_laundering"], *lift.lift_and_p(r["n_laundering"], r["n"], all_x, all_n)))
    return s.createDataFrame(out, "kind string, grp string, n long, n_laundering long, lift double, p double")


@query("eda_summary", "@txn, x as (select count(*) as n, sum(is_laundering) as n_laundering, count(distinct sender) as n_senders, count(distinct receiver) as n_receivers, (select count(*) from (select sender from txn union select receiver from txn)) as n_accounts, avg(amount) as mean_amount, avg(cast(sender_loc is distinct from receiver_loc as integer)) * 100 as cross_border_pct from txn)", "mean_amount cross_border_pct", "n_laundering")
def _(s, d):
    t = txn(s, d)
    n = t.select(F.col("sender").alias("a")).union(t.select(F.col("receiver").alias("a"))).distinct().count()
    t = f.border_flags(t)
    return t.agg(F.count(F.lit(1)).alias("n"), F.sum("is_laundering").alias("n_laundering"), F.countDistinct("sender").alias("n_senders"), F.countDistinct("receiver").alias("n_receivers"), F.avg("amount").alias("mean_amount"), (F.avg("is_cross_border") * 100).alias("cross_border_pct")).withColumn("n_accounts", F.lit(n))


_HYPOTHESES = {"structuring": "amount >= 9000 and amount < 10000", "large": "amount >= 10000", "night": "is_night = 1", "weekend": "is_weekend = 1", "cross_border": "sender_loc is distinct from receiver_loc", "currency_mismatch": "pay_currency is distinct from rec_currency"}
_HYPS = " union all ".join(f"select '{k}' as hypothesis, count(*) filter ({c}) as n1, coalesce(sum(is_laundering) filter ({c}), 0) as x1, count(*) as n, sum(is_laundering) as x from txn" for k, c in _HYPOTHESES.items())


@query("verdicts", "@txn, h as (" + _HYPS + "), z0 as (select hypothesis, n1 as n, (x1 / nullif(cast(n1 as double), 0)) / nullif(x / cast(n as double), 0) as lift, " + _z_sql("x1", "n1", "(x - x1)", "(n - n1)") + " as z from h), p0 as (select hypothesis, n, lift, " + _p_sql("z") + " as p from z0), x as (select *, case when p is null or p >= 0.05 then 'no effect' when lift >= 1.5 then 'confirmed' when lift >= 1.2 then 'weak' else 'not confirmed' end as verdict from p0)", "lift p")
def _(s, d):
    """Hypotheses by their lift over the base rate and the p-value against the rest."""
    t = f.border_flags(f.amount_flags(txn(s, d)))
    flags = {"structuring": "amount_near_threshold", "large": "amount_above_threshold", "night": "is_night", "weekend": "is_weekend", "cross_border": "is_cross_border", "currency_mismatch": "is_currency_mismatch"}
    row = t.agg(F.count(F.lit(1)).alias("n"), F.sum("is_laundering").alias("x"), *[a for k, c in flags.items() for a in (F.sum(c).alias(f"n_{k}"), F.sum(F.col(c) * F.col("is_laundering")).alias(f"x_{k}"))]).first()
    out = [(k, row[f"n_{k}"] or 0, *lift.lift_and_p(row[f"x_{k}"] or 0, row[f"n_{k}"] or 0, row["x"] or 0, row["n"])) for k in flags]
    return s.createDataFrame(out, "hypothesis string, n long, lift double, p double").withColumn("verdict", verdict(F.col("lift"), F.col("p")))


# --- features -----------------------------------------------------------------------------------------------------------

_VCOLS = [c for h in f.WINDOWS for c in (f"vel_count_{h}h", f"vel_amount_sum_{h}h")] + ["vel_near_threshold_count_24h", "vel_near_threshold_count_168h"]


@query("velocity_features", "@txn, " + _VTXN + ", x as (select txn_id, " + ", ".join(_VCOLS) + " from vel)", " ".join(c for c in _VCOLS if "sum" in c), " ".join(c for c in _VCOLS if "near" in c))
def _(s, d):
    return f.velocity(txn(s, d)).select("txn_id", *_VCOLS)


_PROF = """ps as (select sender as account, count(amount) as sender_txn_count, median(amount) as sender_median_amount, avg(amount) as sender_mean_amount, stddev_samp(amount) as sender_std_amount, max(amount) as sender_max_amount, sum(amount) as sender_amount_sum, count(distinct receiver) as sender_n_receivers, count(distinct date) as sender_active_days from sp where period = 'train' group by 1),
pr as (select receiver as account, count(amount) as receiver_txn_count, median(amount) as receiver_median_amount, avg(amount) as receiver_mean_amount, count(distinct sender) as receiver_n_senders, sum(amount) as receiver_amount_sum from sp where period = 'train' group by 1),
prof as (select *, sender_txn_count / nullif(cast(sender_active_days as double), 0) as sender_txn_per_active_day, sender_max_amount / nullif(sender_median_amount, 0) as sender_share_above_threshold from ps full join pr using (account))"""
_PD = "sender_median_amount sender_mean_amount sender_std_amount sender_max_amount sender_amount_sum receiver_median_amount receiver_mean_amount receiver_amount_sum sender_txn_per_active_day sender_share_above_threshold"


@query("account_profiles", "@txn, @split, " + _PROF + ", x as (select * from prof)", _PD)
def _(s, d):
    return f.fit_profiles(f.time_split(txn(s, d)).where("period = 'train'"))


@query("behavioural_features", "@txn, @split, " + _PROF + ", x as (select txn_id, amount / nullif(a.sender_median_amount, 0) as amount_to_sender_median, amount / nullif(b.receiver_median_amount, 0) as amount_to_receiver_median, (amount - a.sender_mean_amount) / nullif(a.sender_std_amount, 0) as amount_zscore_sender, amount / nullif(a.sender_max_amount, 0) as amount_to_sender_max from sp left join prof a on a.account = sender left join prof b on b.account = receiver)", "amount_to_sender_median amount_to_receiver_median amount_zscore_sender amount_to_sender_max")
def _(s, d):
    t = f.time_split(txn(s, d))
    return f.apply_profiles(t, f.fit_profiles(t.where("period = 'train'"))).select("txn_id", "amount_to_sender_median", "amount_to_receiver_median", "amount_zscore_sender", "amount_to_sender_max")


def _behaved(s, d) -> DataFrame:
    t = f.time_split(txn(s, d))
    t = f.apply_profiles(f.velocity(t), f.fit_profiles(t.where("period = 'train'")))
    return t.withColumn("vel_amount_24h_to_median", ratio(F.col("vel_amount_sum_24h"), F.col("sender_median_amount")))


@query("velocity_to_median", "@txn, @split, " + _VSP + ", " + _PROF + ", x as (select txn_id, vel_amount_sum_24h / nullif(sender_median_amount, 0) as vel_amount_24h_to_median from vel left join prof on account = sender)", "vel_amount_24h_to_median")
def _(s, d):
    return _behaved(s, d).select("txn_id", "vel_amount_24h_to_median")


_GRID = "gr as (select pay_currency as c, list_sort(list_distinct(quantile_cont(amount, [" + ", ".join(f"{k}/1000.0::double" for k in range(1, 1000)) + "]))) as grid from sp where period = 'train' group by 1)"


@query("amount_percentile_grid", "@txn, @split, " + _GRID + ", x as (select c as pay_currency, i as position, grid[i] as value from gr, unnest(range(1, len(grid) + 1)) y(i))", "value")
def _(s, d):
    g = f.fit_percentiles(f.time_split(txn(s, d)).where("period = 'train'"))
    return g.select("pay_currency", F.posexplode("grid").alias("position", "value")).withColumn("position", F.col("position") + 1)


@query("amount_percentile_apply", "@txn, @split, " + _GRID + ", x as (select txn_id, len(list_filter(grid, lambda v: v < amount)) * 100.0 / len(grid) as amount_pct_in_currency from sp left join gr on c = pay_currency)", "amount_pct_in_currency")
def _(s, d):
    t = f.time_split(txn(s, d))
    return f.apply_percentiles(t, f.fit_percentiles(t.where("period = 'train'"))).select("txn_id", "amount_pct_in_currency")


_PAIRS = "pairs as (select sender as s, receiver as r, count(amount) as pair_count, sum(amount) as pair_amount_sum, avg(amount) as pair_amount_mean, max(epoch) as pair_last_ts from sp where period = 'train' group by 1, 2)"


@query("pair_stats", "@txn, @split, " + _PAIRS + ", x as (select s as sender, r as receiver, pair_count, pair_amount_sum, pair_amount_mean, pair_last_ts from pairs)", "pair_amount_sum pair_amount_mean")
def _(s, d):
    return f.fit_pairs(f.time_split(txn(s, d)).where("period = 'train'"))


@query("pair_features", "@txn, @split, " + _PAIRS + ", x as (select txn_id, coalesce(pair_count, 0) as pair_count, coalesce(pair_amount_sum, 0) as pair_amount_sum, coalesce(pair_amount_mean, 0) as pair_amount_mean, cast(s is null as integer) as is_new_pair from sp left join pairs on s = sender and r = receiver)", "pair_amount_sum pair_amount_mean", "is_new_pair")
def _(s, d):
    t = f.time_split(txn(s, d))
    return f.apply_pairs(t, f.fit_pairs(t.where("period = 'train'"))).select("txn_id", "pair_count", "pair_amount_sum", "pair_amount_mean", "is_new_pair")


@query("profile_drift", "@txn, @split, a as (select sender, median(amount) as m1 from sp where period = 'train' group by 1), b as (select sender, median(amount) as m2 from sp group by 1), j as (select abs(m2 - m1) / nullif(m1, 0) as drift from a join b using (sender)), x as (select count(*) as n, avg(cast(drift > 0.01 as integer)) * 100 as over_1_pct, avg(cast(drift > 0.10 as integer)) * 100 as over_10_pct from j)", "over_1_pct over_10_pct")
def _(s, d):
    t = f.time_split(txn(s, d))
    m = t.groupBy("sender").agg(F.median(F.when(F.col("period") == "train", F.col("amount"))).alias("m1"), F.median("amount").alias("m2")).where("m1 is not null")
    drift = ratio(F.abs(F.col("m2") - F.col("m1")), F.col("m1"))
    return m.agg(F.count(F.lit(1)).alias("n"), (F.avg((drift > 0.01).cast("int")) * 100).alias("over_1_pct"), (F.avg((drift > 0.10).cast("int")) * 100).alias("over_10_pct"))


_LIFTED = ["amount", "hour", "vel_amount_sum_24h", "vel_count_168h"]


def _lift_sql(c: str) -> str:
    e = ", ".join(f"quantile_cont({c}, {i / 5})" for i in range(6))
    return f"select '{c}' as feature, list_sort(list_distinct([{e}])) as e, count(distinct {c}) as nd from vel"


@query("feature_lift_table", "@txn, " + _VTXN.replace("vel as (select *", "vel0 as (select *") + ", vel as (select is_laundering, " + ", ".join(f"cast({c} as double) as {c}" for c in _LIFTED) + " from vel0), ed as (" + " union all ".join(map(_lift_sql, _LIFTED)) + "), lg as (" + " union all ".join(f"select '{c}' as feature, {c} as v, is_laundering as y from vel" for c in _LIFTED) + "), bn as (select feature, y, len(list_filter(e[2:len(e) - 1], lambda t: v > t)) + 1 as bin from lg join ed using (feature) where nd >= 5 and len(e) >= 3 and v is not null), g as (select feature, bin, count(*) as n, avg(y) / (select avg(is_laundering) from vel) as lift from bn group by 1, 2 having count(*) >= 200), x as (select feature, count(*) as n_bins, max(lift) as max_lift, min(lift) as min_lift, arg_max(bin, lift * 1e6 - bin) as best_bin from g group by feature)", "max_lift min_lift", "best_bin")
def _(s, d):
    return lift.lift_table(f.velocity(txn(s, d)), _LIFTED)


@query("feature_nulls_constants", "@txn, @split, " + _VSP + ", " + _PAIRS + ", m as (select vel.*, coalesce(pair_count, 0) as pair_count, r as known from vel left join pairs on s = sender and r = receiver), x as (" + " union all ".join(f"select '{c}' as feature, avg(cast({c} is null as integer)) as null_share, count(distinct {c}) as n_distinct, count(distinct {c}) <= 1 as is_constant from m" for c in ("amount", "hour", "vel_count_1h", "pair_count", "laundering_type")) + ")", "null_share")
def _(s, d):
    t = f.time_split(txn(s, d))
    t = f.apply_pairs(f.velocity(t), f.fit_pairs(t.where("period = 'train'")))
    cols = ("amount", "hour", "vel_count_1h", "pair_count", "laundering_type")
    row = t.agg(*[a for c in cols for a in (F.avg(F.col(c).isNull().cast("int")).alias(f"n_{c}"), F.countDistinct(c).alias(f"d_{c}"))])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"n_{c}").alias("null_share"), F.col(f"d_{c}").alias("n_distinct"), (F.col(f"d_{c}") <= 1).alias("is_constant")) for c in cols])))


#: Two of these say the same here: the day of the month and the time.
_REDUNDANT = [*_MATRIX_CORR, "epoch", "day"]


@query("corr_pairs_over_090", "@txn, " + _VTXN + ", " + _FLAGGED.replace("from txn", "from vel") + ", y as (" + _corr_rows("fl", _REDUNDANT) + "), x as (select a, b, corr from y where abs(corr) > 0.9)", "corr")
def _(s, d):
    return lift.correlations(_vel_frame(s, d), _REDUNDANT).where(F.abs("corr") > 0.9)


# --- graph --------------------------------------------------------------------------------------------------------------

_EL, _ET = EDGES.replace("{v}", "big").replace("{t}", "date"), EDGES.replace("{v}", "(select * from sp where period = 'train')").replace("{t}", "epoch")


def _train_edges(s, d) -> DataFrame:
    return graph.edge_list(f.time_split(txn(s, d)).where("period = 'train'"))


@query("graph_edges", "@big, " + _EL + ", x as (select * replace (cast(last_ts as varchar) as last_ts) from edges)", "amount_sum amount_mean amount_max")
def _(s, d):
    return graph.edge_list(txn_large(s, d))


_DEG = "ends as (select sender as account, 1 as o, 0 as i, n_txn, amount_sum from edges union all select receiver, 0, 1, n_txn, amount_sum from edges), deg as (select account, sum(o) as g_out_degree, sum(i) as g_in_degree, sum(n_txn * o) as g_out_txn, sum(n_txn * i) as g_in_txn, sum(amount_sum * o) as g_out_amount_sum, sum(amount_sum * i) as g_in_amount_sum, sum(o) + sum(i) as g_total_degree, sum(i) / nullif(cast(sum(o) as double), 0) as g_degree_ratio from ends group by 1)"
_DEGD, _DEGL = "g_out_amount_sum g_in_amount_sum g_degree_ratio", "g_out_degree g_in_degree g_out_txn g_in_txn g_total_degree"


@query("graph_degrees", "@big, " + _EL + ", " + _DEG + ", x as (select * from deg)", _DEGD, _DEGL)
def _(s, d):
    return graph.degrees(graph.edge_list(txn_large(s, d)))


@query("graph_mutual_pairs", "@big, " + _EL + ", x as (select a.sender, a.receiver, 1 as g_is_mutual_pair from edges a join edges b on a.sender = b.receiver and a.receiver = b.sender)", "", "g_is_mutual_pair")
def _(s, d):
    return graph.mutual_pairs(graph.edge_list(txn_large(s, d)))


@query("graph_top_edges", "@big, " + _EL + ", x as (select * replace (cast(last_ts as varchar) as last_ts) from edges order by amount_sum desc, sender, receiver limit 1000)", "amount_sum amount_mean amount_max")
def _(s, d):
    return graph.top_edges(graph.edge_list(txn_large(s, d)), 1000)


def _core_sql(e: str, p: str = "") -> str:
    """{p}core: the edges of e within cycles and between them; the names of all its parts begin with p."""
    fwd = f"(select a from {p}cyc union select x1.b from {p}reach x1 join {p}cyc on {p}cyc.a = x1.a)"
    bwd = f"(select a from {p}cyc union select x2.a from {p}reach x2 join {p}cyc c2 on c2.a = x2.b)"
    return f"{p}reach as (select sender as a, receiver as b from {e} union select r.a, e.receiver from {p}reach r join {e} e on e.sender = r.b), {p}cyc as (select distinct a from {p}reach where a = b), {p}cn as ({fwd} intersect {bwd}), {p}core as (select sender, receiver from {e} where sender in (select a from {p}cn) and receiver in (select a from {p}cn))"


_REC = "recursive "


@query("graph_cyclic_core", _REC + "@txn, @split, " + _ET + ", " + _core_sql("edges") + ", x as (select * from core)")
def _(s, d):
    return graph.cyclic_core(_train_edges(s, d))


_REP = ", rep as (select * from edges where n_txn >= 2), "


@query("graph_repeat_core", _REC + "@txn, @split, " + _ET + _REP + _core_sql("rep") + ", x as (select * from core)")
def _(s, d):
    return graph.cyclic_core(_train_edges(s, d).where("n_txn >= 2"))


def _wcc_sql(e: str, out: str = "x") -> str:
    p = f"{out}_"
    return f"{p}und as (select sender as a, receiver as b from {e} union select receiver, sender from {e}), {p}wr as (select a, b from {p}und union select {p}wr.a, {p}und.b from {p}wr join {p}und on {p}und.a = {p}wr.b), {p}wc as (select a as account, least(a, min(b)) as component from {p}wr group by a), {out} as (select account, component, count(*) over (partition by component) as size from {p}wc)"


@query("graph_components", _REC + "@txn, @split, " + _ET + ", " + _wcc_sql("edges"))
def _(s, d):
    return graph.component_sizes(_train_edges(s, d))


@query("graph_core_components", _REC + "@txn, @split, " + _ET + ", " + _core_sql("edges") + ", " + _wcc_sql("core"))
def _(s, d):
    return graph.component_sizes(graph.cyclic_core(_train_edges(s, d)))


_PR = (
    "w as (select sender, receiver, n_txn / cast(sum(n_txn) over (partition by sender) as double) as share from edges), nd as (select sender as account from edges union select receiver from edges), "
    "na as (select account, (select count(*) from nd) as n, account not in (select sender from edges) as dang from nd), "
    "pk as (select 0 as it, account, n, dang, 1.0::double / n as rank, 1.0::double as moved from na union all select it + 1, account, n, dang, rank, sum(abs(rank - was)) over () as moved from ("
    "select p.it, q.account, q.n, q.dang, max(p.rank) filter (p.account = q.account) as was, 0.15 / q.n + 0.85 * (coalesce(sum(p.rank * w.share), 0) + max(p.lost) / q.n) as rank "
    "from (select *, coalesce(sum(case when dang then rank end) over (), 0) as lost from pk where it < 60 and moved >= 1e-8) p cross join na q left join w on w.sender = p.account and w.receiver = q.account group by p.it, q.account, q.n, q.dang)), "
    "pr as (select account, rank * 1000 as g_pagerank_x1000 from pk where it = (select max(it) from pk))"
)


@query("graph_pagerank", _REC + "@txn, @split, " + _ET + ", " + _PR + ", x as (select * from pr)", "g_pagerank_x1000")
def _(s, d):
    return graph.pagerank(_train_edges(s, d)).select("account", (F.col("g_pagerank") * 1000).alias("g_pagerank_x1000"))


_SCC = "mu as (select f.a, f.b from reach f join reach g on f.a = g.b and f.b = g.a where f.a <> f.b), scc as (select nd.account, 1 + count(mu.b) as scc_size, cast(count(mu.b) > 0 as integer) as in_cycle from nd left join mu on mu.a = nd.account group by nd.account)"


@query("graph_scc", _REC + "@txn, @split, " + _ET + ", reach as (select sender as a, receiver as b from edges union select r.a, e.receiver from reach r join edges e on e.sender = r.b), nd as (select sender as account from edges union select receiver from edges), " + _SCC + ", x as (select * from scc)", "", "in_cycle")
def _(s, d):
    return graph.strong_components(_train_edges(s, d))


_MUTUAL = "mutual as (select a.sender as ms, a.receiver as mr from edges a join edges b on a.sender = b.receiver and a.receiver = b.sender)"
_ACC = (
    _ET + ", " + _DEG + ", " + _PR + ", " + _core_sql("edges") + _REP + _core_sql("rep", "r") + ", " + _wcc_sql("edges", "wcc") + ", " + _wcc_sql("core", "cwcc") + ", " + _SCC + ", " + _MUTUAL + ", "
    "acc as (select deg.*, pr.g_pagerank_x1000, wcc.size as g_component_size, cast(cn1.a is not null as integer) as g_in_cycle, coalesce(cwcc.size, 0) as g_core_component_size, scc.scc_size as g_nx_scc_size, "
    "wcc.size as g_nx_component_size, cast(cn2.a is not null as integer) as g_in_repeat_cycle from deg left join pr using (account) left join wcc using (account) left join cwcc using (account) left join scc using (account) "
    "left join (select sender as a from core union select receiver from core) cn1 on cn1.a = account left join (select sender as a from rcore union select receiver from rcore) cn2 on cn2.a = account)"
)
_ACCL = _DEGL + " g_component_size g_in_cycle g_core_component_size g_nx_scc_size g_nx_component_size g_in_repeat_cycle"


def _thousandths(df: DataFrame) -> DataFrame:
    return df.withColumn("g_pagerank", F.col("g_pagerank") * 1000).withColumnRenamed("g_pagerank", "g_pagerank_x1000")


@query("graph_account_table", _REC + "@txn, @split, " + _ACC + ", x as (select * from acc)", _DEGD + " g_pagerank_x1000", _ACCL)
def _(s, d):
    return _thousandths(graph.fit_accounts(f.time_split(txn(s, d)).where("period = 'train'"))[0])


@query("graph_meta", _REC + "@txn, @split, " + _ACC + ", x as (select (select count(*) from acc) as n_accounts, (select sum(g_in_cycle) from acc) as n_accounts_in_cycle, (select sum(g_in_repeat_cycle) from acc) as n_accounts_in_repeat_cycle, (select count(*) from edges) as n_edges_train, (select count(*) from core) as n_core_edges, (select count(*) from mutual) as n_mutual_pairs)", "", "n_accounts_in_cycle n_accounts_in_repeat_cycle")
def _(s, d):
    return graph.fit_graph(f.time_split(txn(s, d)).where("period = 'train'")).meta()


_EGO = "eg0 as (select min(sender) as a from core), ends as (select sender as a, receiver as b from core union select receiver, sender from core), h1 as (select a, min(hop) as hop from (select a, 0 as hop from eg0 union all select b, 1 from ends where a in (select a from eg0)) group by a order by min(hop), a limit 40), h2 as (select a, min(hop) as hop from (select * from h1 union all select b, 2 from ends where a in (select a from h1)) group by a order by min(hop), a limit 40), x as (select sender, receiver from core where sender in (select a from h2) and receiver in (select a from h2))"


@query("ego_network", _REC + "@txn, @split, " + _ET + ", " + _core_sql("edges") + ", " + _EGO)
def _(s, d):
    """The neighbourhood of the first account of the core, for drawing."""
    core = graph.cyclic_core(_train_edges(s, d))
    start = core.agg(F.min("sender")).first()[0]
    return graph.ego_network(core, start or "")


_GZERO = "g_in_cycle g_core_component_size g_in_repeat_cycle".split()
_GONE = "g_component_size g_nx_scc_size g_nx_component_size".split()
_APPLIED = (
    "ga as (select sp.txn_id, " + ", ".join(f"a.{c}" for c in "g_out_degree g_in_degree g_total_degree g_degree_ratio g_out_amount_sum g_in_amount_sum g_pagerank_x1000".split())
    + ", " + ", ".join([f"coalesce(a.{c}, 0) as {c}" for c in _GZERO] + [f"coalesce(a.{c}, 1) as {c}" for c in _GONE])
    + ", cast(ms is not null as integer) as g_is_mutual_pair, coalesce(b.g_in_cycle, 0) as g_receiver_in_cycle from sp left join acc a on a.account = sender left join acc b on b.account = receiver left join mutual on ms = sender and mr = receiver)"
)
_GD = "g_degree_ratio g_out_amount_sum g_in_amount_sum g_pagerank_x1000"
_GL = "g_out_degree g_in_degree g_total_degree g_in_cycle g_core_component_size g_component_size g_nx_scc_size g_nx_component_size g_in_repeat_cycle g_is_mutual_pair g_receiver_in_cycle"


@query("graph_features_apply", _REC + "@txn, @split, " + _ACC + ", " + _APPLIED + ", x as (select * from ga)", _GD, _GL)
def _(s, d):
    t = f.time_split(txn(s, d))
    return _thousandths(graph.apply_accounts(t, *graph.fit_accounts(t.where("period = 'train'"))).select("txn_id", *mx.GRAPH_FEATURES))


_CODED = ", ".join(f"v{i} as (select {c} as v, row_number() over (order by {c}) - 1 as code from (select distinct {c} from txn where {c} is not null))" for i, c in enumerate(f.CODED.values()))
#: The features that are not columns of the views, profiles or accounts by their own names.
_MADE = {
    "amount_log": "ln(1 + amount)", "amount_pct_in_currency": "len(list_filter(grid, lambda v: v < amount)) * 100.0 / len(grid)", "amount_near_threshold": "cast(amount >= 9000 and amount < 10000 as integer)",
    "amount_above_threshold": "cast(amount >= 10000 as integer)", "is_round_100": "cast(round(amount, 2) % 100 = 0 as integer)", "is_round_1000": "cast(round(amount, 2) % 1000 = 0 as integer)",
    "is_cross_border": "cast(sender_loc is distinct from receiver_loc as integer)", "is_currency_mismatch": "cast(pay_currency is distinct from rec_currency as integer)",
    "amount_to_sender_median": "amount / nullif(ps1.sender_median_amount, 0)", "amount_to_receiver_median": "amount / nullif(pr1.receiver_median_amount, 0)", "amount_zscore_sender": "(amount - ps1.sender_mean_amount) / nullif(ps1.sender_std_amount, 0)",
    "amount_to_sender_max": "amount / nullif(ps1.sender_max_amount, 0)", "vel_amount_24h_to_median": "vel_amount_sum_24h / nullif(ps1.sender_median_amount, 0)", "is_new_pair": "cast(pairs.s is null as integer)",
} | {k: f"coalesce(v{i}.code, -1)" for i, k in enumerate(f.CODED)} | {c: f"coalesce({c}, 0)" for c in ("pair_count", "pair_amount_sum", "pair_amount_mean")}


def _made(c: str) -> str:
    return _MADE.get(c) or (f"ps1.{c}" if c.startswith("sender_") else f"pr1.{c}" if c.startswith("receiver_") else f"vel.{c}")


_MXD = [c for c in mx.FEATURES if ("amount" in c and "threshold" not in c) or c in ("sender_txn_per_active_day", "sender_share_above_threshold")]
_MXL = [c for c in mx.FEATURES if c not in _MXD]
_FULL = (
    _REC + "@txn, @split, " + _VSP + ", " + _PROF.replace("pr as (", "prr as (").replace("full join pr using", "full join prr using") + ", " + _PAIRS + ", " + _GRID + ", " + _CODED + ", " + _ACC + ", " + _APPLIED
    + ", mat as (select vel.txn_id, " + ", ".join(f"{_made(c)} as {c}" for c in mx.FEATURES) + ", " + ", ".join(f"ga.{c}" for c in (_GD + " " + _GL).split()) + ", vel.is_laundering, vel.period from vel left join prof ps1 on ps1.account = sender left join prof pr1 on pr1.account = receiver left join pairs on pairs.s = sender and pairs.r = receiver left join gr on c = pay_currency "
    + " ".join(f"left join v{i} on v{i}.v = vel.{c}" for i, c in enumerate(f.CODED.values())) + " join ga on ga.txn_id = vel.txn_id)"
)


@query("feature_matrix", _FULL + ", x as (select * from mat)", " ".join(_MXD) + " " + _GD, " ".join(_MXL) + " " + _GL + " is_laundering")
def _(s, d):
    return _thousandths(mx.matrix(s, d).select("txn_id", *mx.FEATURES, *mx.GRAPH_FEATURES, "is_laundering", "period"))


@query("feature_build", _FULL + ", x as (select period, count(*) as n, sum(amount_log) as amount_log, sum(vel_count_24h) as vel_count_24h, sum(g_in_cycle) as g_in_cycle, count(amount_zscore_sender) as n_zscore, sum(is_new_pair) as n_new_pairs from mat group by period)", "amount_log", "vel_count_24h g_in_cycle n_new_pairs")
def _(s, d):
    """The job: matrix and rulers written, and the matrix read back."""
    out = new_path(s, "matrix")
    mx.build_and_save(txn(s, d), out)
    m = load_periods(s, f"{out}/matrix", ["train", "val", "test"], ["period", "amount_log", "vel_count_24h", "g_in_cycle", "amount_zscore_sender", "is_new_pair"])
    return m.groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_log").alias("amount_log"), F.sum("vel_count_24h").alias("vel_count_24h"), F.sum("g_in_cycle").alias("g_in_cycle"), F.count("amount_zscore_sender").alias("n_zscore"), F.sum("is_new_pair").alias("n_new_pairs"))


# --- rules --------------------------------------------------------------------------------------------------------------

_BOOK = rules.default_rule_book()
_NAMES = [r.name for r in _BOOK]
_RULED = _REC + """@txn, @split, """ + _VSP + ", " + _PROF + ", " + _PAIRS + ", " + _GRID + ", " + _ET + ", " + _DEG + _REP + _core_sql("rep", "r") + ", " + _MUTUAL + """,
rn0 as (select sender as ra from rcore union select receiver from rcore),
mat as (select vel.*, cast(amount >= 9000 and amount < 10000 as integer) as near, cast(amount >= 10000 as integer) as above, vel_amount_sum_24h / nullif(sender_median_amount, 0) as v24, (amount - sender_mean_amount) / nullif(sender_std_amount, 0) as zs,
  g_out_degree as od, g_in_degree as ind, g_total_degree as td, g_degree_ratio as dr, cast(ms is not null as integer) as mutual, cast(ra is not null as integer) as rep, cast(pairs.s is null as integer) as newp, len(list_filter(grid, lambda v: v < amount)) * 100.0 / len(grid) as pct
  from vel left join prof on prof.account = sender left join deg on deg.account = sender left join mutual on ms = sender and mr = receiver left join rn0 on ra = sender left join pairs on pairs.s = sender and pairs.r = receiver left join gr on c = pay_currency),
th as (select quantile_cont(v24, 0.99) as t5, quantile_cont(zs, 0.99) as t6, quantile_cont(od, 0.95) as t7, quantile_cont(ind, 0.95) as t8, quantile_cont(td, 0.95) as t9, quantile_cont(dr, 0.99) as t13 from mat where period = 'train'),
fl as (select txn_id, period, date, is_laundering, laundering_type, above = 1 as R1, near = 1 and vel_near_threshold_count_24h >= 2 as R2, vel_near_threshold_count_168h >= 3 as R3, vel_count_1h >= 3 as R4, coalesce(v24, 0) >= t5 as R5, coalesce(zs, 0) >= t6 as R6,
  coalesce(od, 0) >= t7 as R7, coalesce(ind, 0) >= t8 as R8, coalesce(rep >= 1 and td >= t9, false) as R9, mutual >= 1 as R10, newp = 1 and coalesce(pct, 0) >= 95 as R11, is_night = 1 and coalesce(pct, 0) >= 90 as R12, coalesce(dr, 1) >= t13 as R13 from mat, th),
RN as (select *, """ + " + ".join(f"cast({n} as integer)" for n in _NAMES) + """ as risk_score from fl)"""
#: By application, folder and state of its tables: where the matrix that the rules read has been stored.
_RULE_TABLES: dict[tuple, str] = {}


def _rule_matrix(s, d) -> DataFrame:
    """What the rules read, a row per transaction; made once for a folder, as long as its tables stay as they are."""
    key = (s.sparkContext.applicationId, shared_dir(s), state(s, f"{d}/events.parquet"), state(s, f"{d}/nation.parquet"))
    if key not in _RULE_TABLES or not exists(s, _RULE_TABLES[key]):
        t = f.time_split(txn(s, d))
        with scratch() as keep:
            train = stored(t.where("period = 'train'"), "train")
            df = f.amount_flags(f.apply_pairs(f.apply_percentiles(f.apply_profiles(f.velocity(t), f.fit_profiles(train)), f.fit_percentiles(train)), f.fit_pairs(train)))
            df = df.withColumn("vel_amount_24h_to_median", ratio(F.col("vel_amount_sum_24h"), F.col("sender_median_amount")))
            edges = stored(graph.edge_list(train), "edges")
            repeat = graph.core_nodes(graph.cyclic_core(edges.where("n_txn >= 2"))).select(F.col("account").alias("__c"), F.lit(1).alias("g_in_repeat_cycle"))
            deg = graph.degrees(edges).withColumnRenamed("account", "__a").join(repeat, F.col("__a") == F.col("__c"), "left").drop("__c")
            mu = graph.mutual_pairs(edges).select(F.col("sender").alias("__s"), F.col("receiver").alias("__r"), "g_is_mutual_pair")
            df = df.join(deg, F.col("sender") == F.col("__a"), "left").join(mu, (F.col("sender") == F.col("__s")) & (F.col("receiver") == F.col("__r")), "left").na.fill(0, ["g_is_mutual_pair", "g_in_repeat_cycle"])
            df = keep(stored(df.select("txn_id", "period", "date", "is_laundering", "laundering_type", *sorted({c for r in _BOOK for c in r.needs})), "rule-matrix"))
        _RULE_TABLES[key] = df._tidewatch_path
    return s.read.parquet(_RULE_TABLES[key])


def _ruled(s, d) -> tuple[DataFrame, list[rules.Rule]]:
    df = _rule_matrix(s, d)
    book = rules.fit_rules(df.where("period = 'train'"), _BOOK)
    return rules.apply_rules(df, book), book


@query("rule_thresholds", _RULED + ", x as (" + " union all ".join(f"select '{n}' as rule, t{n[1:]} as threshold from th" for n in ("R5", "R6", "R7", "R8", "R9", "R13")) + ")", "threshold")
def _(s, d):
    return s.createDataFrame([(r.name, float(r.threshold)) for r in _ruled(s, d)[1] if r.threshold is not None], "rule string, threshold double")


@query("rule_flags", _RULED + ", x as (select txn_id, " + ", ".join(_NAMES) + " from RN)")
def _(s, d):
    return _ruled(s, d)[0].select("txn_id", *_NAMES)


@query("risk_score", _RULED + ", x as (select txn_id, risk_score from RN)", "", "risk_score")
def _(s, d):
    return _ruled(s, d)[0].select("txn_id", "risk_score")


@query("any_rule", _RULED + ", x as (select txn_id, risk_score > 0 as any_rule from RN)")
def _(s, d):
    return _ruled(s, d)[0].select("txn_id", "any_rule")


_MD = "alert_rate_pct precision_pct recall_pct lift f1"


def _conf_sql(name: str, cond: str, view: str) -> str:
    return f"select '{name}' as name, count(*) filter ({cond} and is_laundering = 1) as tp, count(*) filter ({cond} and is_laundering = 0) as fp, count(*) filter (not ({cond}) and is_laundering = 1) as fn, count(*) filter (not ({cond}) and is_laundering = 0) as tn, count(*) filter ({cond}) as alerts from {view}"


_CONF = "x as (select name, tp, fp, fn, tn, alerts, alerts * 100.0 / nullif(tp + fp + fn + tn, 0) as alert_rate_pct, tp * 100.0 / nullif(alerts, 0) as precision_pct, tp * 100.0 / nullif(tp + fn, 0) as recall_pct, (tp / nullif(cast(alerts as double), 0)) / nullif((tp + fn) / cast(tp + fp + fn + tn as double), 0) as lift, 2.0 * tp / nullif(alerts + tp + fn, 0) as f1 from cf)"
_EVAL = ", ev as (select * from RN where period <> 'train')"


@query("rule_metrics", _RULED + _EVAL + ", cf as (" + " union all ".join(_conf_sql(n, n, "ev") for n in _NAMES) + "), " + _CONF, _MD)
def _(s, d):
    df, book = _ruled(s, d)
    return rules.rule_metrics(df.where("period <> 'train'"), book)


_CURVE = _RULED + _EVAL + ", cf as (" + " union all ".join(_conf_sql(str(k), f"risk_score >= {k}", "ev") for k in range(1, 14)) + "), " + _CONF.replace("x as (select name,", "x0 as (select cast(name as integer) as k,")


@query("score_curve", _CURVE + ", x as (select * from x0)", _MD, "k")
def _(s, d):
    return rules.score_curve(_ruled(s, d)[0].where("period <> 'train'"))


@query("best_k", _CURVE.replace("period <> 'train'", "period = 'val'") + ", b as (select k from x0 where f1 is not null order by f1 desc, k limit 1), tt as (select * from RN where period = 'test'), x as (select (select k from b) as k, count(*) filter (risk_score >= (select k from b)) as alerts, count(*) filter (risk_score >= (select k from b) and is_laundering = 1) as tp from tt)", "", "k")
def _(s, d):
    df, _ = _ruled(s, d)
    best = rules.score_curve(df.where("period = 'val'")).where("f1 is not null").orderBy(F.desc("f1"), "k").first()
    k = best["k"] if best else 1
    hit = F.col("risk_score") >= k
    return df.where("period = 'test'").agg(F.lit(k).alias("k"), F.count_if(hit).alias("alerts"), F.count_if(hit & (F.col("is_laundering") == 1)).alias("tp"))


@query("recall_by_typology", _RULED + _EVAL + ", x as (select laundering_type, count(*) as support, count(*) filter (risk_score > 0) as caught, count(*) filter (risk_score > 0) * 100.0 / count(*) as recall_pct from ev where is_laundering = 1 group by 1 having count(*) >= 5)", "recall_pct")
def _(s, d):
    return rules.recall_by_typology(_ruled(s, d)[0].where("period <> 'train'"), F.col("any_rule"), 5)


@query("daily_alerts", _RULED + _EVAL + ", x as (select cast(date as varchar) as date, count(*) filter (risk_score >= 2) as alerts, count(*) filter (risk_score >= 2 and is_laundering = 1) as tp from ev group by 1)")
def _(s, d):
    return rules.daily_alerts(_ruled(s, d)[0].where("period <> 'train'"), F.col("risk_score") >= 2)


@query("workload_report", _RULED + _EVAL + ", dy as (select date, count(*) filter (risk_score >= 2) as al, count(*) filter (risk_score >= 2 and is_laundering = 1) as t from ev group by 1), x as (select sum(al) as alerts, median(al) as median_per_day, max(al) as max_per_day, count(*) as n_days, sum(t) as tp, sum(al) / nullif(cast(sum(t) as double), 0) as alerts_per_tp, median(al) / 30 as analysts from dy)", "median_per_day alerts_per_tp analysts", "alerts tp")
def _(s, d):
    return rules.workload(rules.daily_alerts(_ruled(s, d)[0].where("period <> 'train'"), F.col("risk_score") >= 2))


#: Rows of a random 1 %: a hash of the row's id, the same in every run.
_LUCKY = "cast('0x' || substr(md5(cast(txn_id as varchar)), 1, 13) as bigint) < 45035996273704"
_BITS = "(values " + ", ".join(f"('{n}', {1 << i})" for i, n in enumerate(_NAMES)) + ")"
_GREEDY = (
    ", va as (select *, " + " + ".join(f"cast({n} as integer) * {1 << i}" for i, n in enumerate(_NAMES)) + " as mask from RN where period = 'val'), cube as (select mask as k, count(*) as c, sum(is_laundering) as p from va group by mask), "
    "bits as (select * from " + _BITS + " b(rule, bit)), budget as (select cast(floor(count(*) * {share}) as bigint) as most from va), "
    "gr0 as (select 0 as step, 0 as m, cast(0 as hugeint) as alerts, cast(0 as hugeint) as tp, '' as rule union all select step, m, alerts, tp, rule from ("
    "select *, row_number() over (order by gain / cost desc, gain desc, rule desc) as pick from (select g.step + 1 as step, g.m + b.bit as m, b.rule, coalesce(sum(cube.c) filter (cube.k & (g.m | b.bit) <> 0), 0) as alerts, coalesce(sum(cube.p) filter (cube.k & (g.m | b.bit) <> 0), 0) as tp, "
    "cast(coalesce(sum(cube.p) filter (cube.k & (g.m | b.bit) <> 0), 0) - any_value(g.tp) as double) as gain, greatest(coalesce(sum(cube.c) filter (cube.k & (g.m | b.bit) <> 0), 0) - any_value(g.alerts), 1) as cost "
    "from gr0 g, bits b, cube where g.m & b.bit = 0 and g.step < 6 group by g.step, g.m, b.rule, b.bit), budget where alerts <= most) where pick = 1), "
    "greedy as (select step, rule, alerts, tp from gr0 where step > 0)"
)
_SHARE = 0.05
_GREEDY = _GREEDY.replace("{share}", str(_SHARE))


def _chosen(df: DataFrame, book: list[rules.Rule]) -> list[dict]:
    return rules.greedy_select(df.where("period = 'val'"), book, _SHARE)


_BEST = ", cf0 as (" + " union all ".join(f"select {k} as k, count(*) filter (risk_score >= {k}) as a, count(*) filter (risk_score >= {k} and is_laundering = 1) as t from RN where period = 'val'" for k in range(1, 14)) + "), bk as (select coalesce((select k from cf0 where 2.0 * t / nullif(a + (select sum(is_laundering) from RN where period = 'val'), 0) is not null order by 2.0 * t / nullif(a + (select sum(is_laundering) from RN where period = 'val'), 0) desc, k limit 1), 1) as best)"
_ANY = " or ".join(f"({n} and (select count(*) from greedy where rule = '{n}') > 0)" for n in _NAMES)
_STRATEGIES = (("all", "true"), ("any_rule", "risk_score > 0"), ("threshold_only", "R1"), ("k4", "risk_score >= 4"), ("random_1_pct", _LUCKY), ("best_k", "risk_score >= (select best from bk)"), ("chosen_set", "chosen"))


@query("strategy_comparison", _RULED + _GREEDY + _BEST + ", sel as (select *, " + _ANY + " as chosen from RN), " + ", ".join(f"ev_{p} as (select * from sel where period = '{p}')" for p in ("val", "test"))
       + ", cf as (" + " union all ".join(_conf_sql(f"{p}:{n}", c, f"ev_{p}") for p in ("val", "test") for n, c in _STRATEGIES) + "), " + _CONF, _MD)
def _(s, d):
    """The strategies on val, where the best score and the set of rules were chosen, and on test."""
    df, book = _ruled(s, d)
    best = rules.score_curve(df.where("period = 'val'")).where("f1 is not null").orderBy(F.desc("f1"), "k").first()
    picked = [F.col(r["rule"]) for r in _chosen(df, book)]
    lucky = F.conv(F.substring(F.md5(F.col("txn_id").cast("string").cast("binary")), 1, 13), 16, 10).cast("long") < 45035996273704
    alerts = {"all": F.lit(True), "any_rule": F.col("any_rule"), "threshold_only": F.col("R1"), "k4": F.col("risk_score") >= 4, "random_1_pct": lucky, "best_k": F.col("risk_score") >= (best["k"] if best else 1), "chosen_set": functools.reduce(lambda a, b: a | b, picked, F.lit(False))}
    parts = [rules.metrics_of(df.where(F.col("period") == p), {f"{p}:{k}": m for k, m in alerts.items()}) for p in ("val", "test")]
    return parts[0].unionAll(parts[1])


@query("greedy_rules", _RULED + _GREEDY + ", x as (select cast(step as bigint) as step, rule, cast(alerts as bigint) as alerts, cast(tp as bigint) as tp from greedy)")
def _(s, d):
    got = _chosen(*_ruled(s, d))
    return s.createDataFrame([(r["step"], r["rule"], r["alerts"], r["tp"]) for r in got], "step int, rule string, alerts long, tp long")


# --- sources, sinks and streams -----------------------------------------------------------------------------------------

def _raw(s, d) -> DataFrame:
    """The transactions as a raw table: twelve columns, date and time as text."""
    back = {v: k for k, v in NAMES.items()}
    t = txn(s, d).withColumns({"Date": F.date_format("date", "yyyy-MM-dd"), "Time": F.concat_ws(":", *[F.lpad(F.col(c).cast("string"), 2, "0") for c in ("hour", "minute")], F.lit("00"))})
    return t.withColumnsRenamed(back).select(*[n for n, _ in RAW])


_PREPARED = "select sender, receiver, amount, pay_currency, rec_currency, sender_loc, receiver_loc, payment_type, is_laundering, laundering_type, cast(date as varchar) as date, month, day, day_of_week, is_weekend, hour, minute, is_night, epoch"


@query("raw_csv_prepared", "@txn, x as (" + _PREPARED + " from txn)", "amount", "is_laundering month day day_of_week is_weekend hour minute is_night")
def _(s, d):
    """A raw CSV found, read, typed, prepared and cached, and the cache read."""
    at = new_path(s, "raw")
    _raw(s, d).write.option("header", True).csv(f"{at}/csv")
    load_dataset(s, f"{at}/csv", f"{at}/cache")
    out = load_dataset(s, f"{at}/csv", f"{at}/cache")
    return out.select("sender", "receiver", "amount", "pay_currency", "rec_currency", "sender_loc", "receiver_loc", "payment_type", "is_laundering", "laundering_type", "date", "month", "day", "day_of_week", "is_weekend", "hour", "minute", "is_night", "epoch")


@query("mixed_calendar", "@txn, y as (select *, txn_id % 3 as m from txn), x as (select txn_id, cast(date as varchar) as date, hour, minute, is_night from y)", "", "hour minute is_night")
def _(s, d):
    """Dates in three formats and times in two, parsed row by row."""
    t = txn(s, d)
    m = F.col("txn_id") % 3
    date = F.when(m == 0, F.date_format("date", "yyyy-MM-dd")).when(m == 1, F.date_format("date", "yyyyMMdd")).otherwise(F.date_format("date", "dd.MM.yyyy"))
    two = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    t = t.select("txn_id", date.alias("Date"), F.concat_ws(":", two("hour"), two("minute"), *[F.when(m == 0, F.lit("00"))]).alias("Time"))
    return calendar.add_time_features(t).select("txn_id", "date", "hour", "minute", "is_night")


@query("periods_scan", "@txn, @split, x as (select period, count(*) as n, sum(amount) as amount from sp where period in ('val', 'test') group by period)", "amount")
def _(s, d):
    """A table saved by period, two periods and two columns of it read."""
    at = new_path(s, "periods")
    save_table(f.time_split(txn(s, d)).select("txn_id", "sender", "amount", "is_laundering", "period"), at, ["period"])
    return load_periods(s, at, ["val", "test"], ["period", "amount"]).groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))


@query("csv_append", "@txn, g as (select is_laundering, count(*) as n, max(amount) as top from txn group by 1), x as (select is_laundering, n, top, 2 as times from g)", "top", "is_laundering times")
def _(s, d):
    """The same rows appended to a CSV twice."""
    at = new_path(s, "appended")
    rows = txn(s, d).groupBy("is_laundering").agg(F.count(F.lit(1)).alias("n"), F.max("amount").alias("top"))
    for _ in range(2):
        append_csv(rows, at)
    back = s.read.schema("is_laundering int, n long, top double").option("header", True).csv(at)
    return back.groupBy("is_laundering", "n", "top").agg(F.count(F.lit(1)).alias("times"))


@query("report", "@txn, x as (select '# Summary' as line union all select '' union all select '- **rows**: ' || (select count(*) from txn) union all select '- **positive**: ' || (select sum(is_laundering) from txn))")
def _(s, d):
    """A Markdown report, written and read as text."""
    at = new_path(s, "report") + ".md"
    n, x = lift.base_rate(txn(s, d))
    write_report(s, at, "Summary", [("rows", n), ("positive", x)])
    return s.read.text(at).select(F.col("value").alias("line"))


@query("sample_rows", "@txn, x as (select txn_id, amount from txn where " + _LUCKY.replace("45035996273704", "450359962737049") + ")", "amount")
def _(s, d):
    return sample_rows(txn(s, d), "txn_id", 0.1).select("txn_id", "amount")


@query("log_histogram", "@txn, x as (select is_laundering, cast(floor(log10(greatest(amount, 0.01)) * 10) as bigint) as bin, count(*) as n from txn group by 1, 2)", "", "is_laundering")
def _(s, d):
    return lift.log_histogram(txn(s, d), "amount", ["is_laundering"])


_BY_HOUR = "select sender, cast(date_trunc('hour', ts) as varchar) as hour, count(*) as n, sum(amount) as amount_sum from txn group by 1, 2"


@query("stream_hourly_bursts", "@txn, y as (" + _BY_HOUR + "), x as (select * from y where n >= 2)", "amount_sum")
def _(s, d):
    """The transactions as a stream of files, all of them, to the end."""
    return alerts.drained(s, _timed(s, d), lambda t: alerts.hourly_bursts(t, least=2), "complete").withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:mm:ss"))


@query("stream_daily_counts", "@txn, x as (select sender, cast(cast(ts as date) as varchar) as day, count(*) as n from txn group by 1, 2)")
def _(s, d):
    return alerts.drained(s, _timed(s, d), alerts.daily_counts, "complete").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("stream_rulers", "@txn, @split, " + _PROF + ", " + _PAIRS + ", x as (select txn_id, amount / nullif(sender_median_amount, 0) as amount_to_sender_median, coalesce(pair_count, 0) as pair_count, cast(pairs.s is null as integer) as is_new_pair from sp left join prof on prof.account = sender left join pairs on pairs.s = sender and pairs.r = receiver)", "amount_to_sender_median", "is_new_pair")
def _(s, d):
    """Rulers fitted on the training period, joined to a stream of all transactions."""
    train = f.time_split(txn(s, d)).where("period = 'train'")
    profiles, pairs = stored(f.fit_profiles(train), "profiles"), stored(f.fit_pairs(train), "pairs")
    return alerts.drained(s, _timed(s, d), lambda t: alerts.apply_rulers(t, profiles, pairs), "append").select("txn_id", "amount_to_sender_median", "pair_count", "is_new_pair")


def _timed(s, d) -> DataFrame:
    return txn(s, d).withColumn("ts", F.timestamp_seconds("epoch"))


_KINDS = ", ".join(f"('{k}', {n})" for k, n in TYPOLOGIES.items())


@query("synthetic_counts", f"y as (select * from (values {_KINDS}) v(k, n)), x as (select k as Laundering_type, n, n as full_size from y union all select null, {N_TOTAL} - (select sum(n) from y), null)", "", "n full_size")
def _(s, d):
    return generate(s, seed=1).groupBy("Laundering_type").agg(F.count(F.lit(1)).alias("n")).withColumn("full_size", F.element_at(F.create_map(*[F.lit(x) for kv in TYPOLOGIES.items() for x in kv]), F.col("Laundering_type")))
