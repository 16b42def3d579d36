"""Line dedup by site-relative frequency: a line that more than a given share of a host's pages hold is boilerplate there.

Pages are counted by the hash of each line, in two sums (host and hash, then the few hashes above the ratio by their very text), so
what is shuffled is a hash a line and no line is dropped for a collision. A line that only one page of a host holds repeats nothing and is never
boilerplate, however few pages the host has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import BROADCAST_ROWS, measured, small_side, stored

#: A line is boilerplate on a host if over RATIO of the host's pages hold it, and more than one page does.
RATIO, PAGES = 0.02, 2
#: Bytes of boilerplate lines that may be broadcast.
LINE_BYTES = 16 << 20


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n")


def boilerplate(pages: DataFrame, ratio: float = RATIO, least: int = PAGES) -> DataFrame:
    """pages (host, text) -> host, line, n_pages, n_host; the lines (trimmed, not blank) above the ratio."""
    base = pages.select("host", F.array_distinct(F.transform(_lines(F.col("text")), lambda x: F.trim(x))).alias("ls"))
    totals = base.groupBy("host").agg(F.count(F.lit(1)).alias("n_host"))
    each = base.select("host", F.explode_outer("ls").alias("line")).where("line <> ''")
    often = each.groupBy("host", F.xxhash64("line").alias("h")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    totals = totals.select(F.col("host").alias("site"), "n_host")
    often = stored(often.join(totals, F.col("host").eqNullSafe(F.col("site"))).where(F.col("n") > F.lit(float(ratio)) * F.col("n_host")).select("h", F.col("host").alias("site"), "n_host"), "frequent-lines")
    exact = each.join(small_side(often), (F.xxhash64("line") == F.col("h")) & F.col("host").eqNullSafe(F.col("site"))).groupBy("host", "line", "n_host").agg(F.count(F.lit(1)).alias("n_pages"))
    return stored(exact.where((F.col("n_pages") >= least) & (F.col("n_pages") > F.lit(float(ratio)) * F.col("n_host"))).select("host", "line", "n_pages", "n_host"), "boilerplate")


def drop_boilerplate(pages: DataFrame, ratio: float = RATIO, least: int = PAGES, limit: int = BROADCAST_ROWS) -> DataFrame:
    """pages (id, host, text) -> id, host, text, n_lines, n_dropped; one row per row of pages, text without its host's boilerplate.

    The order of the other lines and their white space stay. A null text stays null with 0 lines; null hosts are one host. Repeated rows
    are pages of their own. Lines are compared trimmed and whole, however long; blank ones stay. A line at the very ratio stays. An empty table gives none;
    other columns of pages are not read, whatever their names.
    """
    bad = boilerplate(pages.select("host", "text"), ratio, least)
    base = pages.select("id", "host", "text")
    rows, size = measured(bad)
    if rows <= limit and size <= LINE_BYTES:
        by_host = bad.groupBy(F.col("host").alias("site")).agg(F.collect_set("line").alias("bad"))
        out = base.join(F.broadcast(by_host), F.col("host").eqNullSafe(F.col("site")), "left").withColumn("ls", _lines(F.col("text")))
        # Only lines that a page shares with the list are compared one by one.
        met = F.array_intersect(F.transform("ls", lambda x: F.trim(x)), F.col("bad"))
        out = out.withColumn("met", F.coalesce(met, F.array().cast("array<string>"))).drop("bad")
        out = out.withColumn("kept", F.when(F.size("met") == 0, F.col("ls")).otherwise(F.filter("ls", lambda x: ~F.array_contains(F.col("met"), F.trim(x)))))
    else:
        # Too much for one machine: the lines of each page meet their host's by a shuffle on both, and the page is put together again. Rows are numbered
        # once, in a stored table: numbers given twice could differ after a lost executor.
        numbered = stored(base.withColumn("row", F.monotonically_increasing_id()), "pages")
        flat = numbered.select("row", "host", F.posexplode_outer(_lines(F.col("text"))).alias("pos", "line"))
        hit = flat.join(bad.select(F.col("host").alias("site"), F.col("line").alias("gone")), (F.trim("line") == F.col("gone")) & F.col("host").eqNullSafe(F.col("site")))
        places = hit.groupBy(F.col("row").alias("r")).agg(F.collect_set("pos").alias("places"))
        out = numbered.join(places, F.col("row") == F.col("r"), "left").withColumn("places", F.coalesce("places", F.array().cast("array<int>")))
        out = out.withColumn("ls", _lines(F.col("text"))).withColumn("kept", F.filter("ls", lambda x, i: ~F.array_contains(F.col("places"), i)))
    null, n, m = F.col("text").isNull(), F.size("ls"), F.size("kept")
    return out.select("id", "host", F.when(~null, F.array_join("kept", "\n")).alias("text"), F.when(null, 0).otherwise(n).alias("n_lines"), F.when(null, 0).otherwise(n - m).alias("n_dropped"))


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = drop_boilerplate(docs.select(F.col("doc_id").alias("id"), F.col("source").alias("host"), "text"))
    return out.select(F.col("id").alias("doc_id"), F.col("host").alias("source"), "text", "n_lines", "n_dropped")


SQL = """
with l as (select row_id, source, pos, line from (select row_number() over () as row_id, source, string_split(text, chr(10)) as ls from documents where text is not null), unnest(ls) with ordinality as x(line, pos)),
l0 as (select row_number() over () as row_id, * from documents),
t as (select source, count(*) as n_host from documents group by source),
f as (select l.source, trim(line) as k from l join t on l.source is not distinct from t.source where trim(line) <> '' group by l.source, trim(line), n_host
      having count(distinct row_id) >= 2 and count(distinct row_id) > 0.02 * n_host)
select d.doc_id, d.source, case when d.text is null then null else coalesce(list_aggregate(kept, 'string_agg', chr(10)), '') end as text,
  case when d.text is null then 0 else len(string_split(d.text, chr(10))) end as n_lines, case when d.text is null then 0 else len(string_split(d.text, chr(10))) - len(kept) end as n_dropped
from (select d.*, list_filter(string_split(coalesce(d.text, ''), chr(10)), lambda x: not list_contains(coalesce(b.bad, []), trim(x))) as kept
      from documents d left join (select source as s, list(k) as bad from f group by source) b on b.s is not distinct from d.source) d
"""
