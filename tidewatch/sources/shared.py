"""Tables in the folder all executors share, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows, and bytes of their values, of a lookup table that may be broadcast; above either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none, a local one is set, on a local master only (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or None
    if at is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='tidewatch-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tidewatch/{tag}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def state(spark: SparkSession, path: str) -> tuple:
    """(path, length, time of change) of a table's files, in any store that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return tuple((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found)


#: For each scratch() that is open, the tables stored in it.
_OPEN: list[list[DataFrame]] = []


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: its lineage ends at files that outlive executors."""
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._tidewatch_path = path
    if _OPEN:
        _OPEN[-1].append(back)
    return back


def stored_with(df: DataFrame, tag: str, **sums: Column) -> tuple[DataFrame, dict[str, object]]:
    """stored(), and aggregates of df that are taken while it is written."""
    seen = Observation()
    out = stored(df.observe(seen, *[c.alias(k) for k, c in sums.items()]), tag)
    return out, seen.get


def discard(df: DataFrame) -> None:
    """Deletes a table that stored() wrote, once nothing will read it again."""
    path = df.__dict__.get("_tidewatch_path")
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables stored inside are deleted at its end, but for those that were handed to what it gives."""
    held: list[DataFrame] = []
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    _OPEN.append(held)
    try:
        yield keep
    finally:
        _OPEN.pop()
        for df in held:
            if not any(df is k for k in kept):
                discard(df)
        if _OPEN:
            _OPEN[-1].extend(kept)


def _bytes(value: Column, kind: T.DataType) -> Column:
    """Bytes of a value as a broadcast holds it, about."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 8
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)):
            return F.coalesce(F.aggregate(value, F.lit(8).cast("long"), lambda total, x: total + _bytes(x, kind.elementType)), F.lit(8).cast("long"))
        return F.coalesce(F.size(value), F.lit(0)).cast("long") * 8 + 8
    if isinstance(kind, T.StructType):
        return sum((_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(8).cast("long"))
    return F.lit(8).cast("long")


def measured(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes of their values), in one pass."""
    each = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16).cast("long"))
    n, size = df.agg(F.count(F.lit(1)), F.sum(each)).first()
    return n, int(size or 0)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, hinted for broadcast only when its rows and their bytes have been measured and are within the limits."""
    rows, size = measured(df)
    return F.broadcast(df) if rows <= limit and size <= most else df


def partitions(rows: int, per: int, least: int = 1) -> int:
    return max(least, -(-rows // per))
