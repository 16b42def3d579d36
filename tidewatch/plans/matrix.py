"""The feature matrix: rulers fitted on train, applied to every row, and its Parquet sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.scalar import ratio
from tidewatch.operators import features as f
from tidewatch.operators import graph
from tidewatch.sources.shared import stored
from tidewatch.sources.transactions import save_table, txn

#: The features of the matrix, in this order.
FEATURES = [
    "amount_log", "amount_pct_in_currency", "amount_near_threshold", "amount_above_threshold", "is_round_100", "is_round_1000", "is_cross_border", "is_currency_mismatch", "hour", "is_night", "day_of_week", "is_weekend",
    "payment_type_code", "pay_currency_code", "rec_currency_code", "sender_loc_code", "receiver_loc_code", "sender_txn_count", "sender_median_amount", "sender_mean_amount", "sender_std_amount", "sender_max_amount",
    "sender_n_receivers", "sender_active_days", "sender_txn_per_active_day", "sender_share_above_threshold", "receiver_txn_count", "receiver_median_amount", "receiver_n_senders", "amount_to_sender_median",
    "amount_to_receiver_median", "amount_zscore_sender", "amount_to_sender_max", "vel_count_1h", "vel_count_6h", "vel_count_24h", "vel_count_168h", "vel_amount_sum_1h", "vel_amount_sum_6h", "vel_amount_sum_24h",
    "vel_amount_sum_168h", "vel_near_threshold_count_24h", "vel_near_threshold_count_168h", "vel_amount_24h_to_median", "pair_count", "pair_amount_sum", "pair_amount_mean", "is_new_pair",
]
GRAPH_FEATURES = [
    "g_out_degree", "g_in_degree", "g_total_degree", "g_degree_ratio", "g_out_amount_sum", "g_in_amount_sum", "g_pagerank", "g_in_cycle", "g_core_component_size", "g_component_size", "g_nx_scc_size",
    "g_nx_component_size", "g_in_repeat_cycle", "g_is_mutual_pair", "g_receiver_in_cycle",
]


def add_features(split: DataFrame, with_graph: bool = True, rulers_to: str | None = None, max_edges: int | None = None) -> DataFrame:
    """split (with period) -> all features. rulers_to: a folder where the fitted tables are kept for new data."""
    train = split.where("period = 'train'")
    codes = {k: stored(f.fit_codes(split, c), "codes") for k, c in f.CODED.items()}
    rulers = {"percentiles": stored(f.fit_percentiles(train), "percentiles"), "profiles": stored(f.fit_profiles(train), "profiles"), "pairs": stored(f.fit_pairs(train), "pairs")}
    df = f.border_flags(f.amount_flags(f.velocity(split)))
    df = f.apply_codes(df, codes)
    df = f.apply_percentiles(df, rulers["percentiles"])
    df = f.apply_profiles(df, rulers["profiles"])
    df = f.apply_pairs(df, rulers["pairs"])
    df = df.withColumn("vel_amount_24h_to_median", ratio(F.col("vel_amount_sum_24h"), F.col("sender_median_amount")))
    if with_graph:
        rulers["accounts"], rulers["mutual"] = graph.fit_accounts(train, max_edges)
        df = graph.apply_accounts(df, rulers["accounts"], rulers["mutual"])
    if rulers_to:
        for name, table in (rulers | {f"code_{k}": t for k, t in codes.items()}).items():
            save_table(table, f"{rulers_to}/{name}")
    return df


def build_and_save(df: DataFrame, out: str, with_graph: bool = True, limit: int | None = None, max_edges: int | None = None) -> None:
    """The build as a job: split, fit, apply, write by period with the rulers beside."""
    split = f.time_split(df if limit is None else df.limit(limit))
    done = add_features(split, with_graph, f"{out}/rulers", max_edges)
    columns = FEATURES + GRAPH_FEATURES * with_graph
    save_table(done.select("txn_id", *columns, "is_laundering", "period"), f"{out}/matrix", ["period"])


def matrix(spark: SparkSession, sf_dir: str, with_graph: bool = True) -> DataFrame:
    return add_features(f.time_split(txn(spark, sf_dir)), with_graph)
