"""Dates and times of raw transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Date formats in the order in which they are tried.
DATE_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "yyyy/MM/dd", "dd-MM-yyyy", "MM-dd-yyyy", "dd.MM.yyyy", "yyyyMMdd")


def infer_date_format(df: DataFrame, column: str, sample: int = 500) -> tuple[str | None, float]:
    """The format that parses most of the first non-null values, if over 0.8 of them; an earlier format wins a tie."""
    some = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("d")).limit(sample)
    row = some.agg(*[F.avg(F.try_to_timestamp("d", F.lit(f)).isNotNull().cast("int")).alias(str(i)) for i, f in enumerate(DATE_FORMATS)]).first()
    scores = [x or 0.0 for x in row]
    best = max(range(len(scores)), key=lambda i: (scores[i], -i))
    return (DATE_FORMATS[best], scores[best]) if scores[best] > 0.8 else (None, scores[best])


def parse_mixed(column: Column) -> Column:
    """The date by the first format that fits; null if none does."""
    return F.coalesce(*[F.to_date(F.try_to_timestamp(column, F.lit(f))) for f in DATE_FORMATS])


def add_time_features(df: DataFrame, fmt: str | None = None) -> DataFrame:
    """Date, Time -> date, month, day_of_week (0 Monday), is_weekend, day, hour, minute, is_night (0 to 5), txn_ts to the minute.

    Time may be HH:mm:ss or hours as a number. A bad date is null; a bad time counts as midnight in txn_ts and not as night. fmt: the format of Date; inferred
    if it isn't given.
    """
    fmt = fmt or infer_date_format(df, "Date")[0]
    date = F.to_date(F.try_to_timestamp(F.col("Date").cast("string"), F.lit(fmt))) if fmt else parse_mixed(F.col("Date").cast("string"))
    text = F.col("Time").cast("string")
    clock = F.coalesce(F.try_to_timestamp(text, F.lit("HH:mm:ss")), F.try_to_timestamp(text, F.lit("HH:mm")))
    number = text.try_cast("double")
    hour = F.coalesce(F.hour(clock), F.floor(number).cast("int"))
    minute = F.coalesce(F.minute(clock), F.floor((number - F.floor(number)) * 60).cast("int"), F.lit(0))
    # Names are the same to Spark whatever their case, so date takes the place of Date.
    df = df.withColumns({"date": date, "hour": hour, "minute": minute})
    return df.withColumns({
        "month": F.month("date"), "day_of_week": F.weekday("date"), "is_weekend": (F.weekday("date") >= 5).cast("int"), "day": F.day("date"),
        "is_night": F.coalesce(F.col("hour").between(0, 5), F.lit(False)).cast("int"),
        "txn_ts": F.col("date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.coalesce("hour", F.lit(0)), F.col("minute")),
        "epoch": F.datediff("date", F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.coalesce("hour", F.lit(0)) * 3600 + F.col("minute") * 60,
    }).drop("Time")
