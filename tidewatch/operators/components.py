"""Connected components by alternating large and small stars, edges only, one stored table a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.sources.shared import discard, stored


#: Edges from which on a hub's share of them may be too much for one task.
SPLIT_EDGES = 10_000


def _star(edges: DataFrame, large: bool, split: bool) -> DataFrame:
    """One star step over edges (u > v). Large: each node sends its larger neighbours to its least; small: its smaller ones.

    split: the least neighbours are stored before they are joined back. Both sides of that join then come from a shuffle of its own, so
    that adaptive execution can split a hub's edges among tasks; over the aggregate itself it can't.
    """
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    least = stored(least, "least") if split else least
    joined = both.join(least, F.col("u") == F.col("w"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select("v", "m").unionAll(least.select(F.col("w").alias("v"), "m"))
        out = out.select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = out.where("u <> v").distinct()
    if not split:
        return out
    out = stored(out, "star")
    discard(least)
    return out


def components(edges: DataFrame, tag: str = "components", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the least node reachable.

    Nulls and self-loops are dropped first. Nodes without an edge do not appear.
    Each round is written to the shared folder, so a lost executor costs one round at most.
    """
    now = stored(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), tag)
    mark, split = None, now.count() >= SPLIT_EDGES
    for _ in range(rounds):
        if split:
            half = _star(now, True, True)
            after = _star(half, False, True)
            discard(half)
        else:
            after = stored(_star(_star(now, True, False), False, False), tag)
        discard(now)
        now = after
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
