"""Mixing sources to target weights by Poisson replication. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import small_side, stored

#: Largest mean inverted at once; a larger mean is a sum of independent draws of equal mean, which is Poisson again.
STEP = 16.0
#: Terms of the series; beyond, the tail at STEP is under the 2^-52 steps of the uniform.
TERMS = 80


def uniform(*parts: Column | str) -> Column:
    """[0, 1) in steps of 2^-52 from the md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def poisson(mean: Column, u: Column) -> Column:
    """The least k with CDF(k) > u, for a mean up to STEP."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.lit(0).alias("k"))

    def add(acc: Column, i: Column) -> Column:
        p = acc["p"] * mean / i
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), (acc["k"] + F.when(u >= acc["c"], 1).otherwise(0)).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, add, lambda acc: acc["k"])


def rates(docs: DataFrame, weights: dict[str, float] | None, alpha: float, size: float | None) -> DataFrame:
    """(source, n_docs, rate): rate is the mean number of copies that brings each source to its share of the output."""
    found = docs.groupBy(F.col("source").alias("__tw_source")).agg(F.count(F.lit(1)).alias("__tw_n"))
    if weights is None:
        raw = F.pow(F.col("__tw_n").cast("double"), F.lit(float(alpha)))
    else:
        if any(not (w >= 0 and math.isfinite(w)) for w in weights.values()):
            raise ValueError("weights must be finite and not negative")
        table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else None
        raw = F.coalesce(F.try_element_at(table, F.col("__tw_source")), F.lit(0.0)) if weights else F.lit(0.0)
    found = stored(found.withColumn("__tw_raw", raw), "sources")  # one row a source; the documents are read once for it
    every, n = found.agg(F.sum("__tw_raw"), F.sum("__tw_n")).first()
    goal = float(n or 0) if size is None else float(size)
    rate = F.coalesce(F.try_divide(F.col("__tw_raw") * F.lit(goal), F.lit(float(every or 0)) * F.col("__tw_n")), F.lit(0.0))
    return found.select("__tw_source", rate.alias("__tw_rate"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, size: float | None = None, seed: int = 1234) -> DataFrame:
    """docs (doc_id, source, text and any more columns), each row repeated a Poisson number of times, in a random order.

    weights: source -> weight; sources it lacks (and null) get 0 and vanish. None: weight n_docs^alpha for each source, null being
    a source of its own. size: documents to expect in the output, by default as many as the input has. The rate of a source is
    size * share / n_docs; the count of a row inverts the Poisson distribution of that mean at a uniform hashed from seed and doc_id
    (for a null doc_id, from the text), so equal rows get equal counts and a rerun gives the same rows.
    Returns the columns of docs, mix_copy (1, 2, ...) and mix_key, the hashed position; rows are dealt and sorted by mix_key. Copies of rows with one doc_id have the same
    mix_keys, so rows that repeat a doc_id tie and lie side by side in any order. Texts are carried along whole, however long.
    An empty table gives none. Names of docs that start with __tw_ or equal mix_copy or mix_key are not allowed.
    """
    table = small_side(rates(docs, weights, alpha, size))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    rate, steps = F.col("__tw_rate"), F.greatest(F.lit(1), F.ceil(F.col("__tw_rate") / STEP).cast("int"))
    draws = F.transform(F.sequence(F.lit(1), steps), lambda i: poisson(rate / steps, uniform(F.lit(str(seed)), F.col("__tw_key"), i.cast("string"))))
    out = docs.withColumn("__tw_key", key).join(table, F.col("source").eqNullSafe(F.col("__tw_source")))
    out = out.withColumn("__tw_count", F.aggregate(draws, F.lit(0), lambda a, b: a + b))
    out = out.withColumn("mix_copy", F.explode_outer(F.when(F.col("__tw_count") > 0, F.sequence(F.lit(1), F.col("__tw_count"))))).where("mix_copy is not null")
    place = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"order{seed}"), "__tw_key", F.col("mix_copy").cast("string")).cast("binary")), 1, 15), 16, 10)
    out = out.withColumn("mix_key", place.cast("long")).select(*docs.columns, "mix_copy", "mix_key")
    return out.repartition("mix_key").sortWithinPartitions("mix_key")


def placed(docs: DataFrame, seed: int = 1234) -> DataFrame:
    """docs + mix_key: a hashed position for each row, apart for copies of a row. Rows are numbered as they are read, so docs must be a stored table.

    For what follows mix() when mix_key has been left out: rows sorted by it are shuffled again, copies and neighbours apart.
    """
    place = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"order{seed}"), F.monotonically_increasing_id().cast("string")).cast("binary")), 1, 15), 16, 10)
    return docs.withColumn("mix_key", place.cast("long"))


#: DuckDB: the same rates and counts by a table of CDF values for each source.
SQL = f"""
with d as (select *, coalesce(cast(doc_id as varchar), 'text:' || md5(coalesce(text, ''))) as k from documents),
s as (select source as src, count(*) as n from d group by source),
t as (select sum(sqrt(n)) as al, sum(n) as docs from s),
r as (select src, sqrt(n) * docs / (al * n) as rate from s, t),
g as (select src, rate, greatest(1, cast(ceil(rate / {STEP}) as integer)) as steps from r),
p as (select src, steps, i, exp(-rate / steps + i * ln(rate / steps) - lgamma(i + 1.0)) as pmf from g, range(0, {TERMS}) x(i)),
c as (select src, steps, i, sum(pmf) over (partition by src order by i) as cdf from p),
u as (select d.doc_id, d.source, d.k, step, cast('0x' || substr(md5('1234|' || d.k || '|' || cast(step as varchar)), 1, 13) as bigint) / 4503599627370496.0 as u
      from d join g on d.source is not distinct from g.src, unnest(range(1, g.steps + 1)) y(step)),
row_id as (select u.doc_id, u.source, u.k, count(*) filter (c.cdf <= u.u) as n from u join c on u.source is not distinct from c.src group by u.doc_id, u.source, u.k, u.step),
counts as (select doc_id, source, k, sum(n) as n from row_id group by all)
select d.doc_id, d.text, d.lang, d.source, d.n_chars, cast(copy as integer) as mix_copy,
  cast('0x' || substr(md5('order1234|' || d.k || '|' || cast(copy as varchar)), 1, 15) as bigint) as mix_key
from d join counts n on d.k = n.k and d.source is not distinct from n.source, unnest(range(1, cast(n.n as bigint) + 1)) z(copy)
"""
