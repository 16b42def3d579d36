"""What the library does for large tables and hot keys, on small ones; and operators against plain Python."""

import itertools
import math
import random
import warnings
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import components, features, graph, lift, rules
from tidewatch.plans import build_features
from tidewatch.sources import generator, shared
from tidewatch.sources.transactions import prepare, sample_rows


def test_broadcast_by_bytes(spark):
    df = spark.createDataFrame([("x" * 1000, [1, 2], ["ab", None], b"yy", None)] * 10, "a string, b array<int>, c array<string>, d binary, e struct<f:string>")
    rows, size = shared.measured(df)
    assert rows == 10 and 10_000 < size < 13_000
    plan = lambda out: out._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" in plan(shared.small_side(df)) and "ResolvedHint" not in plan(shared.small_side(df, most=9_000)) and "ResolvedHint" not in plan(shared.small_side(df, limit=9))


def test_scratch_tables_go(spark):
    with shared.scratch() as keep:
        gone, stays = shared.stored(spark.range(3), "gone"), keep(shared.stored(spark.range(4), "stays"))
        with shared.scratch() as inner:
            inner(shared.stored(spark.range(5), "inner"))
    fs = spark._jvm.org.apache.hadoop.fs.Path(shared.new_path(spark, "x")).getFileSystem(spark._jsc.hadoopConfiguration())
    there = lambda df: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(df._tidewatch_path))
    assert not there(gone) and there(stays) and stays.count() == 4


def test_sums_while_storing(spark):
    out, seen = shared.stored_with(spark.range(10), "sums", total=F.sum("id"), n=F.count(F.lit(1)))
    assert out.count() == 10 and seen == {"total": 45, "n": 10}


def test_components_with_split_hubs(spark, monkeypatch):
    monkeypatch.setattr(components, "SPLIT_EDGES", 1)
    pairs = [(0, i) for i in range(1, 300)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000), (None, 1)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(300)} | {1000 + i: 1000 for i in range(41)}


def test_velocity_of_a_hot_sender(spark):
    rng = random.Random(2)
    rows = [(i, "hot" if i % 3 else f"s{i % 5}", rng.randrange(0, 40 * 86_400), rng.choice([None, 100.0, 9500.0, 12_000.0])) for i in range(900)]
    df = spark.createDataFrame(rows, "txn_id long, sender string, epoch long, amount double")
    plain = {r["txn_id"]: r for r in features.velocity(df).collect()}
    split = {r["txn_id"]: r for r in features.velocity(df, hot=100).collect()}
    assert set(plain) == set(split) == {r[0] for r in rows} and features.velocity(df, hot=100).columns == features.velocity(df).columns
    for i, sender, t, _ in rows:
        for h in (1, 24, 168):
            near = [x for x in rows if x[1] == sender and t - h * 3600 < x[2] <= t]
            amounts = [x[3] for x in near if x[3] is not None]
            for got in (plain[i], split[i]):
                assert got[f"vel_count_{h}h"] == len(near)
                assert (got[f"vel_amount_sum_{h}h"] is None) == (not amounts) and math.isclose(got[f"vel_amount_sum_{h}h"] or 0, sum(amounts), abs_tol=1e-6)
                if h > 1:
                    assert (got[f"vel_near_threshold_count_{h}h"] or 0) == sum(9000 <= a < 10_000 for a in amounts)


def test_running_counts(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([-5.0, -0.001, 0.0, 0.2, 3.0, 1e7, 1e300, None, rng.random() * 1e4])) for _ in range(500)]
    for r in features.running_counts(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect():
        mine = [v for k, v in rows if k == r["key"] and v is not None]
        assert (r["c"], r["before"], r["n"]) == (mine.count(r["value"]), sum(v < r["value"] for v in mine), len(mine))


def test_percentile_grid_against_numpy(spark):
    rng = random.Random(4)
    rows = [("one", 7.0)] + [("few", x) for x in (1.0, 2.0, 2.0, 10.0)] + [("many", round(rng.lognormvariate(6, 1.5), 2)) for _ in range(3000)] + [("none", None)]
    df = spark.createDataFrame(rows, "pay_currency string, amount double")
    grid = features.fit_percentiles(df)
    got = {r["pay_currency"]: r["grid"] for r in grid.collect()}
    for k in ("one", "few", "many"):
        want = sorted(set(np.quantile([v for c, v in rows if c == k], [i / 1000 for i in range(1, 1000)])))
        assert len(got[k]) == pytest.approx(len(want), abs=3) and np.allclose(np.interp(np.linspace(0, 1, 50), np.linspace(0, 1, len(got[k])), got[k]), np.interp(np.linspace(0, 1, 50), np.linspace(0, 1, len(want)), want), rtol=2e-3)
    assert "none" not in got
    for r in features.apply_percentiles(df, grid).collect():
        g = got.get(r["pay_currency"])
        assert r["amount_pct_in_currency"] == (None if g is None else sum(v < r["amount"] for v in g) * 100.0 / len(g))


def test_pagerank_against_plain_rounds(spark):
    rng = random.Random(5)
    pairs = {(rng.randrange(25), rng.randrange(30)): rng.randrange(1, 5) for _ in range(80)}
    e = spark.createDataFrame([(f"{a:02d}", f"{b:02d}", w, 1.0) for (a, b), w in pairs.items()], "sender string, receiver string, n_txn long, amount_sum double")
    nodes = sorted({x for p in pairs for x in p})
    rank, out = dict.fromkeys(nodes, 1 / len(nodes)), Counter()
    for (a, _), w in pairs.items():
        out[a] += w
    for _ in range(500):
        lost = sum(r for n, r in rank.items() if not out[n])
        rank = {n: 0.15 / len(nodes) + 0.85 * (sum(rank[a] * w / out[a] for (a, b), w in pairs.items() if b == n) + lost / len(nodes)) for n in nodes}
    for one_task in (graph.ONE_TASK, 0):
        got = {int(r[0]): r[1] for r in graph.pagerank(e, one_task=one_task).collect()}
        assert got.keys() == rank.keys() and all(abs(got[n] - rank[n]) < 1e-7 for n in nodes)
        assert sorted(graph.pagerank(e, norm="in", iterations=3, one_task=one_task).collect())[0]["g_pagerank"] == pytest.approx(sorted(graph.pagerank(e, norm="in", iterations=3).collect())[0]["g_pagerank"])
    assert graph.pagerank(e.limit(0)).count() == 0


def test_graph_tables_and_ego_network(spark):
    train = spark.createDataFrame([(a, b, 10.0, i) for i, (a, b) in enumerate(["AB", "BC", "CA", "CA", "DE", "ED", "FA", "ED"])], "sender string, receiver string, amount double, epoch long")
    found = graph.fit_graph(train)
    assert found.meta().first().asDict() == {"n_accounts": 6, "n_accounts_in_cycle": 5, "n_accounts_in_repeat_cycle": 0, "n_edges_train": 6, "n_core_edges": 5, "n_mutual_pairs": 2}
    assert {(r["sender"], r["receiver"], r["last_ts"]) for r in found.edges.collect()} >= {("C", "A", 3), ("E", "D", 7)}
    ego = lambda start, **k: {r[0] + r[1] for r in graph.ego_network(found.edges, start, **k).collect()}
    assert ego("A", hops=1) == {"AB", "BC", "CA", "FA"} and ego("D") == {"DE", "ED"} and ego("F", hops=1) == {"FA"} and ego("A", most=2) == {"AB"}


def test_rules_that_cannot_be_fitted(spark):
    book = [r for r in rules.default_rule_book() if r.name in ("R1", "R7")]
    df = spark.createDataFrame([(1, None), (0, None)], "amount_above_threshold int, g_out_degree long")
    with pytest.raises(ValueError):
        rules.apply_rules(df, book)
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        fitted = rules.fit_rules(df, book)
    assert any("R7" in str(w.message) for w in said)
    assert rules.apply_rules(df, fitted).where("R7").count() == 0 and rules.apply_rules(df, fitted).where("R1").count() == 1


def test_greedy_selection_against_all_rows(spark):
    rng = random.Random(6)
    book = rules.default_rule_book()[:5]
    rows = [(*[int(rng.random() < p) for p in (0.2, 0.05, 0.05, 0.1, 0.0)], int(rng.random() < 0.1)) for _ in range(400)]
    rows = [(*r[:4], r[1], r[5]) for r in rows]  # the last rule adds nothing to the second
    df = spark.createDataFrame(rows, ", ".join(f"{r.name} int" for r in book) + ", is_laundering int")
    df = df.withColumn("rule_mask", sum((F.col(r.name) * (1 << i) for i, r in enumerate(book)), F.lit(0)))
    chosen, want = [], []
    for _ in range(6):
        now = [any(r[i] for i in chosen) for r in rows]
        options = []
        for i in set(range(5)) - set(chosen):
            new = [a or bool(r[i]) for a, r in zip(now, rows)]
            if sum(new) <= int(400 * 0.6):
                gain = sum(r[5] for a, r in zip(new, rows) if a) - sum(r[5] for a, r in zip(now, rows) if a)
                options.append((gain / max(sum(new) - sum(now), 1), gain, book[i].name, i, sum(new), sum(r[5] for a, r in zip(new, rows) if a)))
        if not options:
            break
        best = max(options)
        chosen.append(best[3])
        want.append((best[2], best[4], best[5]))
    got = [(p["rule"], p["alerts"], p["tp"]) for p in rules.greedy_select(df, book, 0.6)]
    assert got == want and {"R2", "R5"} <= {g[0] for g in got}


def test_instances_of_the_generator(spark):
    for name, (least, most) in ((k, v) for k, v in generator.SIZES.items() if not isinstance(v, int)):
        n = (least + most) * 20
        inst, step, size = generator._instances(name, generator.Draw(1, name, F.col("id")), F.col("id"))
        rows = spark.range(n).select(inst.alias("i"), step.alias("s"), size.alias("n")).collect()
        for i, group in itertools.groupby(sorted(rows), key=lambda r: r["i"]):
            group = list(group)
            assert [r["s"] for r in group] == list(range(group[0]["n"])) and least <= group[0]["n"] <= most
        assert len({r["n"] for r in rows}) > 2
    inst, step, n, m = generator._grids(generator.Draw(1, "g", F.col("id")), F.col("id"))
    rows = spark.range(242 * 4).select(inst.alias("i"), step.alias("s"), n.alias("n"), m.alias("m")).collect()
    for i, group in itertools.groupby(sorted(rows), key=lambda r: r["i"]):
        group = list(group)
        assert [r["s"] for r in group] == list(range(group[0]["n"] * group[0]["m"])) and 4 <= group[0]["n"] <= 7 and 4 <= group[0]["m"] <= 7
    assert len({(r["n"], r["m"]) for r in rows}) > 6


def test_cash_is_paid_in_first(spark):
    rows = generator.generate(spark, 2_000_000, 3).where("Laundering_type = 'Deposit-Send'").collect()
    kinds = Counter(r["Payment_type"] for r in rows)
    assert set(kinds) == {"Cash Deposit", "Wire"} and abs(kinds["Cash Deposit"] - kinds["Wire"]) <= 1


def test_prepared_rows_keep_their_date(spark):
    ready = prepare(generator.generate(spark, 2_000, 3))
    assert "date" in ready.columns and ready.select("date").where("date is not null").count() == 2_000 and dict(ready.dtypes)["date"] == "date"


def test_sample_is_the_same_again(spark):
    df = spark.range(20_000).withColumn("x", F.col("id") % 10)
    one = sample_rows(df, "id", 0.1)
    assert 1_800 < one.count() < 2_200 and one.exceptAll(sample_rows(df.repartition(7), "id", 0.1)).count() == 0
    assert sample_rows(df, "x", 0.5).groupBy("x").count().where("count <> 2000").count() == 0


def test_lift_and_histogram(spark):
    assert lift.lift_and_p(0, 0, 5, 10) == (None, None)
    up, p = lift.lift_and_p(50, 100, 100, 10_000)
    assert math.isclose(up, 50) and p < 1e-6
    df = spark.createDataFrame([(0.0, 1), (0.5, 1), (1.0, 0), (1000.0, 0), (None, 0)], "amount double, y int")
    assert {(r["y"], r["bin"], r["n"]) for r in lift.log_histogram(df, "amount", ["y"]).collect()} == {(1, -20, 1), (1, -4, 1), (0, 0, 1), (0, 30, 1)}


def test_build_job(spark, tmp_path):
    generator.generate(spark, 3_000, 5).coalesce(1).write.option("header", True).csv(f"{tmp_path}/raw")
    build_features.main([f"{tmp_path}/raw", f"{tmp_path}/out", "--max-edges", "200", "--limit", "2500"])
    out = spark.read.parquet(f"{tmp_path}/out/matrix")
    assert out.count() == 2_500 and len(out.columns) == 63 + 3 and {r[0] for r in out.select("period").distinct().collect()} == {"train", "val", "test"}
    assert spark.read.parquet(f"{tmp_path}/out/rulers/accounts").count() > 0


@pytest.mark.parametrize("one_task", [graph.ONE_TASK, 0, 30])
def test_graph_rounds_and_one_task_agree(spark, one_task):
    rng = random.Random(7)
    pairs = sorted({(f"A{rng.randrange(50):02d}", f"A{rng.randrange(50):02d}") for _ in range(60)} | {("X", "Y"), ("Z", "Z")})
    e = spark.createDataFrame([*pairs, pairs[0]], "sender string, receiver string")
    left = set(pairs)
    while True:
        both = {a for a, _ in left} & {b for _, b in left}
        less = {p for p in left if p[0] in both and p[1] in both}
        if less == left:
            break
        left = less
    assert {tuple(r) for r in graph.cyclic_core(e, one_task).collect()} == left
    root = {a: a for p in pairs for a in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    sizes = Counter(root.values())
    assert {tuple(r) for r in graph.component_sizes(e, one_task).collect()} == {(a, c, sizes[c]) for a, c in root.items()}
