"""Transactions: schema, readers and writers, and the views over the driver's tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.calendar import add_time_features
from tidewatch.sources.shared import exists

#: The twelve columns of a raw transaction, in this order.
RAW = [
    ("Time", T.StringType()), ("Date", T.StringType()), ("Sender_account", T.StringType()), ("Receiver_account", T.StringType()), ("Amount", T.DoubleType()), ("Payment_currency", T.StringType()),
    ("Received_currency", T.StringType()), ("Sender_bank_location", T.StringType()), ("Receiver_bank_location", T.StringType()), ("Payment_type", T.StringType()), ("Is_laundering", T.ByteType()), ("Laundering_type", T.StringType()),
]
RAW_SCHEMA = T.StructType([T.StructField(n, t) for n, t in RAW])
#: Raw names and the names used from the prepared table on.
NAMES = {"Sender_account": "sender", "Receiver_account": "receiver", "Amount": "amount", "Payment_currency": "pay_currency", "Received_currency": "rec_currency", "Sender_bank_location": "sender_loc", "Receiver_bank_location": "receiver_loc", "Payment_type": "payment_type", "Is_laundering": "is_laundering", "Laundering_type": "laundering_type"}


def find_raw_csv(folder: str, variable: str = "TRANSACTIONS_CSV") -> str:
    """The file the environment variable names, else the largest *.csv in folder."""
    named = os.environ.get(variable)
    if named:
        return named
    found = [os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(".csv")] if os.path.isdir(folder) else []
    if not found:
        raise FileNotFoundError(f"no CSV in {folder}; set {variable}")
    return max(found, key=os.path.getsize)


def read_raw_csv(spark: SparkSession, path: str, nrows: int | None = None) -> DataFrame:
    """The typed CSV; nrows: so many rows, of which Spark takes the first it reads, in the order of files for a small number."""
    df = spark.read.schema(RAW_SCHEMA).option("header", True).csv(path)
    return df if nrows is None else df.limit(nrows)


def optimize_types(df: DataFrame) -> DataFrame:
    """Casts the raw columns that are present to their types; bad values become null."""
    return df.withColumns({n: F.col(n).try_cast(t) for n, t in RAW if n in df.columns})


def prepare(raw: DataFrame) -> DataFrame:
    """Raw -> prepared: txn_id, calendar columns, short names. txn_id numbers rows as they are read, so it is fixed once the table has been saved, as load_dataset does."""
    df = add_time_features(optimize_types(raw)).withColumnsRenamed(NAMES)
    return df.withColumn("txn_id", F.monotonically_increasing_id())


def save_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def load_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def load_dataset(spark: SparkSession, csv: str, cache: str, use_cache: bool = True, force: bool = False, nrows: int | None = None) -> DataFrame:
    """The prepared table, from the cache if it is there; a run over the first rows only is not cached."""
    if use_cache and not force and nrows is None and exists(spark, cache):
        return load_table(spark, cache)
    df = prepare(read_raw_csv(spark, csv, nrows))
    if nrows is not None or not use_cache:
        return df
    save_table(df, cache)
    return load_table(spark, cache)


def load_periods(spark: SparkSession, path: str, periods: list[str], columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).where(F.col("period").isin(periods)).select(*columns)


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def write_report(spark: SparkSession, path: str, title: str, rows: list[tuple[str, object]]) -> None:
    """A short Markdown report of figures that are already on the driver, as one file in any store that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray((f"# {title}\n\n" + "".join(f"- **{k}**: {v}\n" for k, v in rows)).encode()))
    finally:
        out.close()


def sample_rows(df: DataFrame, key: str, share: float) -> DataFrame:
    """About a share of the rows, chosen by a hash of their key: the same rows in every run, and all or none of those with one key."""
    u = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 13), 16, 10).cast("long")
    return df.where(u < F.lit(int(share * (1 << 52))))


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions from `events`: a transfer per event, to the account that its properties name."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    users = (ev.agg(F.max("user_id")).first()[0] or 0) + 1
    k = F.get_json_object("props", "$.k").cast("int")
    minute = F.date_trunc("minute", "ts").cast("timestamp_ntz")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    names = F.broadcast(nation.select(F.col("n_nationkey").alias("nk"), F.col("n_name").alias("sender_loc")))  # 25 rows
    names2 = F.broadcast(nation.select(F.col("n_nationkey").alias("nk2"), F.col("n_name").alias("receiver_loc")))
    currencies = F.array(*[F.lit(c) for c in ("Dollar", "Euro", "Pound", "Yen", "Franc")])
    df = ev.select("event_id", "user_id", k.alias("k"), F.round(F.col("value") * 150, 2).alias("amount"), minute.alias("ts"), F.col("event_type").alias("payment_type"))
    df = df.join(names, F.col("nk") == F.col("user_id") % 25, "left").join(names2, F.col("nk2") == F.col("k") % 25, "left")
    name = lambda c: F.concat(F.lit("ACC_"), F.lpad(c.cast("string"), 7, "0"))
    label = (((F.col("amount") >= 9000) & (F.col("amount") < 10000) & (F.col("event_id") % 2 == 0)) | (F.col("event_id") % 211 == 0)).cast("int")
    df = df.select(
        F.col("event_id").alias("txn_id"), name(F.col("user_id")).alias("sender"), name(F.col("k") % users).alias("receiver"), "amount", "ts", "payment_type",
        F.get(currencies, (F.col("user_id") % 5).cast("int")).alias("pay_currency"), F.get(currencies, (F.col("k") % 5).cast("int")).alias("rec_currency"), "sender_loc", "receiver_loc", label.alias("is_laundering"),
    )
    df = df.withColumn("laundering_type", F.when(F.col("is_laundering") == 1, F.when(F.col("amount").between(9000, 9999.99), "Structuring").otherwise(F.concat(F.lit("Type_"), "payment_type"))))
    # The calendar by the same functions that prepare a raw table.
    text = df.withColumns({"Date": F.date_format("ts", "yyyy-MM-dd"), "Time": F.date_format("ts", "HH:mm:ss")})
    return add_time_features(text, "yyyy-MM-dd").drop("txn_ts")


def txn_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions from `lineitem` and `orders`; dates only."""
    li, o = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), spark.read.parquet(f"{sf_dir}/orders.parquet")
    n = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    df = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_returnflag", "l_quantity").join(o.select("o_orderkey", "o_custkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    name = lambda c: F.concat(F.lit("C"), F.lpad(c.cast("string"), 7, "0"))
    return df.select(
        "l_orderkey", "l_linenumber", name(F.col("o_custkey")).alias("sender"), name(F.col("l_partkey") % n).alias("receiver"), F.col("l_extendedprice").alias("amount"), F.to_date("l_shipdate").alias("date"),
        F.concat(F.lit("L"), (F.col("o_custkey") % 25).cast("string")).alias("sender_loc"), F.concat(F.lit("L"), (F.col("l_partkey") % 25).cast("string")).alias("receiver_loc"),
        F.col("l_returnflag").alias("payment_type"), ((F.col("l_quantity") > 48) & (F.col("l_returnflag") == "R")).cast("int").alias("is_laundering"),
    )
