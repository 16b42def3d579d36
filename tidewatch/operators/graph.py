"""The graph of accounts: edges, degrees, PageRank, cyclic core, components, strongly connected components, mutual pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.scalar import ratio
from tidewatch.operators.components import components
from tidewatch.sources.shared import discard, scratch, stored, stored_with


#: A graph of so few edges, or what is left of a larger one, is finished by one task: rounds over it would cost more than they share out.
ONE_TASK = 100_000


def _numbered(df: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(accounts in order, number of each sender, number of each receiver)."""
    codes, names = pd.factorize(pd.concat([df["sender"], df["receiver"]]), sort=True)
    return np.asarray(names), codes[: len(df)], codes[len(df) :]


def _in_one_task(edges: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    def all_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if parts:
            yield run(pd.concat(parts, ignore_index=True))

    return edges.coalesce(1).mapInPandas(all_rows, schema)


def edge_list(df: DataFrame) -> DataFrame:
    """A row for each pair of sender and receiver; last_ts: the latest epoch, or date where rows have dates only."""
    last = next((c for c in ("epoch", "date") if c in df.columns), None)
    return df.where("sender is not null and receiver is not null").groupBy("sender", "receiver").agg(
        F.count(F.lit(1)).alias("n_txn"), F.sum("amount").alias("amount_sum"), F.avg("amount").alias("amount_mean"), F.max("amount").alias("amount_max"), *([F.max(last).alias("last_ts")] if last else []),
    )


def degrees(edges: DataFrame) -> DataFrame:
    """One shuffle: both ends of each edge as rows of one table."""
    out = edges.select(F.col("sender").alias("account"), F.lit(1).alias("o"), F.lit(0).alias("i"), "n_txn", "amount_sum")
    into = edges.select(F.col("receiver").alias("account"), F.lit(0).alias("o"), F.lit(1).alias("i"), "n_txn", "amount_sum")
    n = out.unionAll(into).groupBy("account").agg(
        F.sum("o").alias("g_out_degree"), F.sum("i").alias("g_in_degree"), F.sum(F.col("n_txn") * F.col("o")).alias("g_out_txn"), F.sum(F.col("n_txn") * F.col("i")).alias("g_in_txn"),
        F.sum(F.col("amount_sum") * F.col("o")).alias("g_out_amount_sum"), F.sum(F.col("amount_sum") * F.col("i")).alias("g_in_amount_sum"),
    )
    return n.withColumns({"g_total_degree": F.col("g_out_degree") + F.col("g_in_degree"), "g_degree_ratio": ratio(F.col("g_in_degree"), F.col("g_out_degree"))})


def top_edges(edges: DataFrame, n: int) -> DataFrame:
    return edges.orderBy(F.desc("amount_sum"), "sender", "receiver").limit(n)


def mutual_pairs(edges: DataFrame) -> DataFrame:
    """Edges whose reverse exists; a self-loop is its own reverse."""
    back = edges.select(F.col("receiver").alias("__s"), F.col("sender").alias("__r"))
    return edges.select("sender", "receiver").join(back, (F.col("sender") == F.col("__s")) & (F.col("receiver") == F.col("__r")), "left_semi").withColumn("g_is_mutual_pair", F.lit(1))


def pagerank(edges: DataFrame, damping: float = 0.85, iterations: int = 60, tolerance: float = 1e-8, norm: str = "out", one_task: int = ONE_TASK) -> DataFrame:
    """(account, g_pagerank), weights n_txn, uniform start, dangling mass spread evenly. tolerance 0: always `iterations` rounds.

    norm "out": a node shares its rank over what it sends. "in": each edge is divided by what its source receives, a variant kept for parity.
    """
    w = stored(edges.groupBy("sender", "receiver").agg(F.sum("n_txn").alias("w")), "pagerank-weights")
    side = "sender" if norm == "out" else "receiver"

    def rounds(df: pd.DataFrame) -> pd.DataFrame:
        names, a, b = _numbered(df)
        n, weight = len(names), df["w"].to_numpy(dtype=np.float64)
        by = a if side == "sender" else b
        total = np.bincount(by, weight, n)
        share, rank = np.divide(weight, total[a], out=np.zeros(len(a)), where=total[a] > 0), np.full(n, 1.0 / n)
        dangling = np.bincount(by, minlength=n) == 0
        for _ in range(iterations):
            new = (1 - damping) / n + damping * (np.bincount(b, share * rank[a], n) + rank[dangling].sum() / n)
            moved, rank = np.abs(new - rank).sum(), new
            if tolerance and moved < tolerance:
                break
        return pd.DataFrame({"account": names, "g_pagerank": rank})

    if w.count() <= one_task:
        return stored(_in_one_task(w, rounds, "account string, g_pagerank double"), "pagerank")
    total = w.groupBy(F.col(side).alias("t_account")).agg(F.sum("w").alias("total"))
    links = stored(w.join(total, F.col("sender") == F.col("t_account")).select("sender", "receiver", (F.col("w") / F.col("total")).alias("share")), "pagerank-links")
    nodes = w.select(F.col("sender").alias("account")).unionAll(w.select(F.col("receiver").alias("account"))).distinct()
    nodes = nodes.join(total, F.col("account") == F.col("t_account"), "left").select("account", F.col("total").isNull().alias("dangling"))
    n = nodes.count()
    if not n:
        return nodes.select("account", F.lit(0.0).alias("g_pagerank"))
    sums = lambda: {"lost": F.sum(F.when(F.col("dangling"), F.col("rank"))), "moved": F.sum(F.abs(F.col("rank") - F.col("was")))}
    now, seen = stored_with(nodes.withColumns({"rank": F.lit(1.0 / n), "was": F.lit(0.0)}), "pagerank", **sums())
    for _ in range(iterations):
        lost = seen["lost"] or 0.0
        got = links.join(now.select(F.col("account").alias("a"), "rank"), F.col("sender") == F.col("a")).groupBy(F.col("receiver").alias("to")).agg(F.sum(F.col("share") * F.col("rank")).alias("in_rank"))
        new = now.drop("was").join(got, F.col("account") == F.col("to"), "left").select("account", "dangling", F.col("rank").alias("was"), ((1 - damping) / n + damping * (F.coalesce("in_rank", F.lit(0.0)) + lost / n)).alias("rank"))
        # One job a round: what the next one needs is summed while this one is written.
        after, seen = stored_with(new, "pagerank", **sums())
        discard(now)
        now = after
        if tolerance and (seen["moved"] or 0.0) < tolerance:
            break
    return now.select("account", F.col("rank").alias("g_pagerank"))


def cyclic_core(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """Edges left when accounts without an incoming or without an outgoing edge are peeled away, round by round, until none is.

    Holds all cycles, and the paths between cycles. Self-loops stay.
    """

    def peel(df: pd.DataFrame) -> pd.DataFrame:
        names, a, b = _numbered(df)
        left = np.arange(len(a))
        while True:
            both = (np.bincount(a[left], minlength=len(names)) > 0) & (np.bincount(b[left], minlength=len(names)) > 0)
            stay = both[a[left]] & both[b[left]]
            if stay.all():
                return df.iloc[left]
            left = left[stay]

    now = stored(edges.select("sender", "receiver").distinct(), "core")
    n = now.count()
    while True:
        if n <= one_task:
            after = stored(_in_one_task(now, peel, "sender string, receiver string"), "core")
            discard(now)
            return after
        both = now.select(F.col("sender").alias("a")).intersect(now.select(F.col("receiver").alias("a")))
        left = now.join(both, F.col("sender") == F.col("a"), "left_semi").join(both, F.col("receiver") == F.col("a"), "left_semi")
        after = stored(left, "core")
        discard(now)
        now, was = after, n
        n = now.count()
        if n == was:
            return now


def core_nodes(core: DataFrame) -> DataFrame:
    return core.select(F.col("sender").alias("account")).unionAll(core.select(F.col("receiver").alias("account"))).distinct()


def component_sizes(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(account, component, size): weak components, named by their least account."""

    def spread(df: pd.DataFrame) -> pd.DataFrame:
        names, a, b = _numbered(df)
        label = np.arange(len(names))
        while True:  # names are in order, so the least number is the least name
            was, low = label.copy(), np.minimum(label[a], label[b])
            for end in (a, b):
                np.minimum.at(label, label[end], low)
                np.minimum.at(label, end, low)
            label = label[label]
            if np.array_equal(was, label):
                break
        return pd.DataFrame({"account": names, "component": names[label], "size": np.bincount(label, minlength=len(names))[label]})

    pairs = stored(edges.where("sender is not null and receiver is not null").select("sender", "receiver").distinct(), "weak-edges")
    if pairs.count() <= one_task:
        return stored(_in_one_task(pairs, spread, "account string, component string, size long"), "weak")
    ids = pairs.select(F.col("sender").alias("a"), F.col("receiver").alias("b"))
    comp = components(ids, "weak")
    lone = ids.where("a = b").select(F.col("a").alias("node")).distinct().join(comp.select("node"), "node", "left_anti")
    comp = comp.unionByName(lone.withColumn("component", F.col("node")))
    sizes = comp.groupBy(F.col("component").alias("c")).agg(F.count(F.lit(1)).alias("size"))
    return comp.join(sizes, F.col("component") == F.col("c")).select(F.col("node").alias("account"), "component", "size")


def _least_reaching(edges: DataFrame) -> DataFrame:
    """(account, mark): the least account with a path to it, or itself. One stored table a round; only marks that moved are passed on."""
    now = stored(core_nodes(edges).select("account", F.col("account").alias("mark"), F.lit(True).alias("moved")), "reach")
    while not now.where("moved").isEmpty():
        sent = now.where("moved").select(F.col("account").alias("a"), F.col("mark").alias("m"))
        got = edges.join(sent, F.col("sender") == F.col("a")).groupBy(F.col("receiver").alias("to")).agg(F.min("m").alias("got"))
        after = now.join(got, F.col("account") == F.col("to"), "left").select("account", F.least("mark", "got").alias("mark"), F.coalesce(F.col("got") < F.col("mark"), F.lit(False)).alias("moved"))
        after = stored(after, "reach")
        discard(now)
        now = after
    return now.select("account", "mark")


def strong_components(edges: DataFrame, max_edges: int | None = None, one_task: int = ONE_TASK) -> DataFrame:
    """(account, scc_size, in_cycle) of the graph of all edges, or of the max_edges largest ones if that is given.

    Accounts outside the cyclic core are alone. In the core, accounts are parted by the least account that reaches them; those of a part that
    reach it in turn are its component. They leave, and so do edges between parts. Each round finds a component in each part, so the loop ends.
    """

    def run(df: pd.DataFrame) -> pd.DataFrame:
        names, a, b = _numbered(df)
        out: list[list[int]] = [[] for _ in names]
        for x, y in zip(a, b, strict=True):
            out[x].append(y)
        found = _scc(out)
        return pd.DataFrame({"account": names[[v for c in found for v in c]], "component": names[[c[0] for c in found for _ in c]]})

    pairs = stored((edges if max_edges is None else top_edges(edges, max_edges)).select("sender", "receiver").distinct(), "scc-edges")
    left = cyclic_core(pairs.where("sender <> receiver"), one_task)
    found = None
    while left.count() > one_task:
        mark = _least_reaching(left)
        to = mark.select(F.col("account").alias("b"), F.col("mark").alias("part"))
        inner = left.join(mark, F.col("sender") == F.col("account")).join(to, (F.col("receiver") == F.col("b")) & (F.col("mark") == F.col("part")))
        inner = stored(inner.select("sender", "receiver", "part"), "scc-parts")
        back = _least_reaching(inner.select(F.col("receiver").alias("sender"), F.col("sender").alias("receiver")))
        # The least account of a part is the one that it is named for.
        done = stored(mark.join(back.select(F.col("account").alias("b"), F.col("mark").alias("m")), (F.col("account") == F.col("b")) & (F.col("mark") == F.col("m"))).select("account", F.col("mark").alias("component")), "scc")
        found = done if found is None else found.unionAll(done)
        rest = inner.join(done, F.col("sender") == F.col("account"), "left_anti").join(done, F.col("receiver") == F.col("account"), "left_anti")
        before, left = left, cyclic_core(rest, one_task)
        for table in (before, inner):
            discard(table)
    last = _in_one_task(left, run, "account string, component string")
    found = stored(last if found is None else found.unionAll(last), "scc")
    sizes = found.groupBy(F.col("component").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    sizes = found.join(sizes, F.col("component") == F.col("c")).select(F.col("account").alias("a"), "n")
    size = F.coalesce("n", F.lit(1).cast("long"))
    return core_nodes(pairs).join(sizes, F.col("account") == F.col("a"), "left").select("account", size.alias("scc_size"), (size > 1).cast("int").alias("in_cycle"))


def _scc(out: list[list[int]]) -> list[list[int]]:
    """Strongly connected components by two depth-first walks, without recursion."""
    n = len(out)
    seen, order = [False] * n, []
    for root in range(n):
        if seen[root]:
            continue
        seen[root] = True
        stack = [(root, iter(out[root]))]
        while stack:
            v, it = stack[-1]
            nxt = next((w for w in it if not seen[w]), None)
            if nxt is None:
                order.append(v)
                stack.pop()
            else:
                seen[nxt] = True
                stack.append((nxt, iter(out[nxt])))
    back: list[list[int]] = [[] for _ in range(n)]
    for v, ws in enumerate(out):
        for w in ws:
            back[w].append(v)
    done, found = [False] * n, []
    for root in reversed(order):
        if done[root]:
            continue
        done[root], group, stack = True, [], [root]
        while stack:
            v = stack.pop()
            group.append(v)
            for w in back[v]:
                if not done[w]:
                    done[w] = True
                    stack.append(w)
        found.append(group)
    return found


@dataclass
class GraphTables:
    accounts: DataFrame  # all graph features of an account
    mutual: DataFrame
    edges: DataFrame
    core: DataFrame

    def meta(self) -> DataFrame:
        """One row of counts."""
        a = self.accounts.agg(F.count(F.lit(1)).alias("n_accounts"), F.coalesce(F.sum("g_in_cycle"), F.lit(0)).cast("long").alias("n_accounts_in_cycle"), F.coalesce(F.sum("g_in_repeat_cycle"), F.lit(0)).cast("long").alias("n_accounts_in_repeat_cycle"))
        rest = {"n_edges_train": self.edges, "n_core_edges": self.core, "n_mutual_pairs": self.mutual}
        return a.withColumns({k: F.lit(t.count()).cast("long") for k, t in rest.items()})


def fit_graph(train: DataFrame, max_edges: int | None = None, iterations: int = 60, tolerance: float = 1e-8) -> GraphTables:
    """All tables of the graph, from training rows only. max_edges: g_nx_ columns from so many of the largest edges only."""
    with scratch() as keep:
        edges = keep(stored(edge_list(train), "edges"))
        core = keep(cyclic_core(edges))
        weak = component_sizes(edges).select("account", F.col("size").alias("g_component_size"))
        wide = weak if max_edges is None else component_sizes(top_edges(edges, max_edges)).select("account", F.col("size").alias("g_component_size"))
        parts = [
            degrees(edges), pagerank(edges, iterations=iterations, tolerance=tolerance), weak, wide.withColumnRenamed("g_component_size", "g_nx_component_size"),
            core_nodes(core).withColumn("g_in_cycle", F.lit(1)), component_sizes(core).select("account", F.col("size").alias("g_core_component_size")),
            strong_components(edges, max_edges).select("account", F.col("scc_size").alias("g_nx_scc_size")), core_nodes(cyclic_core(edges.where("n_txn >= 2"))).withColumn("g_in_repeat_cycle", F.lit(1)),
        ]
        # Each part has an account once, so one shuffle of their rows puts them side by side.
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part, allowMissingColumns=True)
        out = out.groupBy("account").agg(*[F.max(c).alias(c) for c in out.columns if c != "account"])
        fills = {"g_component_size": 1, "g_in_cycle": 0, "g_core_component_size": 0, "g_nx_scc_size": 1, "g_nx_component_size": 1, "g_in_repeat_cycle": 0}
        return GraphTables(keep(stored(out.na.fill(fills), "accounts")), keep(stored(mutual_pairs(edges), "mutual")), edges, core)


def fit_accounts(train: DataFrame, max_edges: int | None = None, iterations: int = 60) -> tuple[DataFrame, DataFrame]:
    """(accounts with all graph features, mutual pairs) of fit_graph()."""
    found = fit_graph(train, max_edges, iterations)
    return found.accounts, found.mutual


def ego_network(edges: DataFrame, start: str, most: int = 40, hops: int = 2) -> DataFrame:
    """Edges among the accounts within some hops of one, in either direction: the nearest `most` of them, by name at one distance."""
    near = edges.sparkSession.createDataFrame([(start, 0)], "account string, hop int")
    ends = edges.select(F.col("sender").alias("a"), F.col("receiver").alias("b"))
    ends = ends.unionAll(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
    for hop in range(1, hops + 1):
        # At most `most` accounts are known at each step, so they are what is broadcast.
        found = ends.join(F.broadcast(near.select(F.col("account").alias("n"))), F.col("a") == F.col("n"), "left_semi").select(F.col("b").alias("account"), F.lit(hop).alias("hop"))
        near = near.unionAll(found).groupBy("account").agg(F.min("hop").alias("hop")).orderBy("hop", "account").limit(most)
    near = stored(near, "ego")
    one, two = near.select(F.col("account").alias("x")), near.select(F.col("account").alias("y"))
    return edges.join(F.broadcast(one), F.col("sender") == F.col("x"), "left_semi").join(F.broadcast(two), F.col("receiver") == F.col("y"), "left_semi").select("sender", "receiver")


def apply_accounts(df: DataFrame, accounts: DataFrame, mutual: DataFrame) -> DataFrame:
    """Account features join on the sender, g_receiver_in_cycle on the receiver, g_is_mutual_pair on both."""
    s = accounts.withColumnRenamed("account", "__a")
    r = accounts.select(F.col("account").alias("__b"), F.col("g_in_cycle").alias("g_receiver_in_cycle"))
    m = mutual.select(F.col("sender").alias("__s"), F.col("receiver").alias("__r"), "g_is_mutual_pair")
    df = df.join(s, F.col("sender") == F.col("__a"), "left").join(r, F.col("receiver") == F.col("__b"), "left").join(m, (F.col("sender") == F.col("__s")) & (F.col("receiver") == F.col("__r")), "left")
    ones = ("g_component_size", "g_nx_scc_size", "g_nx_component_size")
    zeros = ("g_in_cycle", "g_core_component_size", "g_in_repeat_cycle", "g_receiver_in_cycle", "g_is_mutual_pair")
    return df.drop("__a", "__b", "__s", "__r").withColumns({c: F.coalesce(c, F.lit(v)) for cs, v in ((ones, 1), (zeros, 0)) for c in cs})
