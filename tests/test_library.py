import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.calendar import infer_date_format
from tidewatch.functions.scalar import bucketize, two_proportion_ztest
from tidewatch.operators import features, graph, lift, rules
from tidewatch.plans.matrix import FEATURES, GRAPH_FEATURES
from tidewatch.plans.queries import QUERIES, corridor_pivot
from tidewatch.sources import generator
from tidewatch.sources.transactions import RAW, prepare


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, 1, 1.0) for a, b in pairs], "sender string, receiver string, n_txn long, amount_sum double")


def test_feature_contract():
    assert len(FEATURES) == 48 and len(GRAPH_FEATURES) == 15 and len({*FEATURES, *GRAPH_FEATURES}) == 63


def test_cyclic_core(spark):
    core = graph.cyclic_core(edges(spark, ["AB", "BC", "CA", "DE", "ED", "FA"]))
    assert core.count() == 5 and {r[0] for r in graph.core_nodes(core).collect()} == set("ABCDE")
    assert graph.cyclic_core(edges(spark, ["AB", "BC"])).count() == 0
    between = graph.core_nodes(graph.cyclic_core(edges(spark, ["AB", "BA", "BC", "CD", "DE", "ED", "GG"])))
    assert {r[0] for r in between.collect()} == set("ABCDEG")


def test_cyclic_core_of_long_tails(spark):
    tail, chain = [f"T{i:02d}" for i in range(54)], [f"C{i:03d}" for i in range(105)]
    pairs = [*zip(tail, tail[1:]), (tail[-1], "A"), ("A", "B"), ("B", "A"), *zip(chain, chain[1:])]
    core = graph.cyclic_core(edges(spark, pairs).coalesce(1))
    assert {(r["sender"], r["receiver"]) for r in core.collect()} == {("A", "B"), ("B", "A")}


def test_strong_components(spark):
    got = {r["account"]: (r["scc_size"], r["in_cycle"]) for r in graph.strong_components(edges(spark, ["AB", "BA", "BC", "CD", "DE", "ED", "GG"])).collect()}
    assert got == {"A": (2, 1), "B": (2, 1), "C": (1, 0), "D": (2, 1), "E": (2, 1), "G": (1, 0)}


def test_strong_components_of_all_edges(spark, monkeypatch):
    rng = random.Random(4)
    pairs = {(f"A{rng.randrange(60):02d}", f"A{rng.randrange(60):02d}") for _ in range(75)} | {("X", "Y"), ("Y", "Z"), ("Z", "X"), ("Z", "A00"), ("Q", "Q")}
    reach = {a: {a} for e in pairs for a in e}
    for _ in reach:
        for a, b in pairs:
            reach[a] |= reach[b]
    want = {a: sum(a in reach[b] for b in r) for a, r in reach.items()}
    assert len({*want.values()}) > 2
    e = edges(spark, sorted(pairs)).cache()
    for one_task in (0, 10, graph.ONE_TASK):
        got = {r["account"]: (r["scc_size"], r["in_cycle"]) for r in graph.strong_components(e, one_task=one_task).collect()}
        assert got == {a: (n, int(n > 1)) for a, n in want.items()}
    monkeypatch.setattr(graph, "top_edges", None)  # no cap unless it is asked for
    train = spark.createDataFrame([(a, b, 1.0) for a, b in sorted(pairs)], "sender string, receiver string, amount double")
    for r in graph.fit_accounts(train, iterations=1)[0].collect():
        assert r["g_nx_scc_size"] == want[r["account"]] and r["g_nx_component_size"] == r["g_component_size"]


def test_components_of_a_long_chain(spark):
    names = [f"N{i:03d}" for i in range(80)]
    got = graph.component_sizes(spark.createDataFrame([*zip(names, names[1:]), ("X", "Y"), ("Z", "Z")], "sender string, receiver string")).collect()
    assert {(r["component"], r["size"]) for r in got} == {("N000", 80), ("X", 2), ("Z", 1)}


def test_pagerank_norms(spark):
    e = spark.createDataFrame([("A", "B", 3, 1.0), ("A", "C", 1, 1.0), ("B", "C", 2, 1.0)], "sender string, receiver string, n_txn long, amount_sum double")
    out = {r[0]: r[1] for r in graph.pagerank(e, iterations=40).collect()}
    assert math.isclose(sum(out.values()), 1, abs_tol=1e-6) and out["C"] > out["B"] > out["A"]
    assert out != {r[0]: r[1] for r in graph.pagerank(e, iterations=40, norm="in").collect()}


def test_velocity_against_brute_force(spark):
    rows = [(i, f"a{i % 7}", (i * 7919) % 90_000, float(i % 50) * 300) for i in range(600)]
    df = spark.createDataFrame(rows, "txn_id long, sender string, epoch long, amount double")
    for r in features.velocity(df).collect():
        for h in (1, 24):
            near = [x for x in rows if x[1] == r["sender"] and r["epoch"] - h * 3600 < x[2] <= r["epoch"]]
            assert r[f"vel_count_{h}h"] == len(near) and math.isclose(r[f"vel_amount_sum_{h}h"], sum(x[3] for x in near))


def test_corridor_pivot_takes_the_busiest(spark):
    rows = [(f"L{i}", f"L{(i * 7 + k) % 25}", k % 2) for i in range(25) for k in range(i + 1)] + [("L24", "L24", 1)] * 40
    df = spark.createDataFrame(rows, "sender_loc string, receiver_loc string, is_laundering int")

    def busiest(k):
        return {x for _, x in sorted((-n, x) for x, n in Counter(r[k] for r in rows).items())[:12]}

    got = corridor_pivot(df).collect()
    assert {r["sender_loc"] for r in got} == busiest(0) != {f"L{i}" for i in range(12)} and {*got[0].asDict()} == busiest(1) | {"sender_loc"}
    for r in got:
        for c in busiest(1):
            marks = [x[2] for x in rows if x[:2] == (r["sender_loc"], c)]
            assert r[c] == (100 * sum(marks) / len(marks) if marks else None)


def test_ztest_and_lift(spark):
    z, p = two_proportion_ztest(50, 100, 50, 10_000)
    assert z > 0 and p < 0.01
    assert two_proportion_ztest(10, 100, 1000, 10_000)[1] > 0.05 and math.isnan(two_proportion_ztest(0, 0, 1, 2)[0])
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), (F.col("id") % 11 == 0).cast("int").alias("is_laundering"))
    rows = lift.rate_by_group(df, ["g"]).collect()
    assert math.isclose(sum(r["n"] * r["lift"] for r in rows) / 1000, 1, abs_tol=1e-6)


def test_planted_leak_is_found(spark):
    df = spark.range(2000).select((F.rand(1) < 0.1).cast("int").alias("is_laundering"), F.randn(2).alias("noise")).withColumn("leak", F.col("is_laundering") + F.randn(3) * 0.01)
    got = {r["feature"]: r["leaks"] for r in lift.feature_leakage(df, ["noise", "leak"]).collect()}
    assert got == {"noise": False, "leak": True}


def test_buckets_are_left_closed(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (-1.0,), (math.inf,)], "x double").select(bucketize(F.col("x"), [0, 0.5, math.inf], ["a", "b"]))
    assert [r[0] for r in df.collect()] == ["a", "b", "b", None, None]


def test_rules(spark):
    df = spark.range(400).select(*[(F.rand(i) < 0.2).cast("int").alias(c) for i, c in enumerate(("amount_above_threshold", "amount_near_threshold", "g_in_repeat_cycle", "g_is_mutual_pair", "is_new_pair", "is_night", "is_laundering"))],
                                  *[F.floor(F.rand(50 + i) * 5).alias(c) for i, c in enumerate(("vel_near_threshold_count_24h", "vel_near_threshold_count_168h", "vel_count_1h", "vel_amount_24h_to_median", "amount_zscore_sender", "g_degree_ratio", "g_out_degree", "g_in_degree", "g_total_degree"))], (F.rand(9) * 100).alias("amount_pct_in_currency"))
    df = df.cache()
    book = rules.fit_rules(df)
    assert all(r.threshold is not None for r in book if r.quantile)
    got = rules.apply_rules(df, book)
    assert got.where("any_rule <> (risk_score >= 1)").count() == 0
    alerts = [r["alerts"] for r in rules.score_curve(got).orderBy("k").collect()]
    assert alerts == sorted(alerts, reverse=True)
    with pytest.raises(KeyError):
        rules.apply_rules(df.drop("is_night"), book)
    picked = rules.greedy_select(got, book, 0.3)
    assert all(p["alerts"] <= 120 for p in picked)


def test_generator_and_preparation(spark):
    df = generator.generate(spark, 20_000, 3).cache()
    assert df.columns == [n for n, _ in RAW] and df.count() == 20_000
    assert df.where("(Is_laundering = 1) <> (Laundering_type is not null)").count() == 0
    assert df.where("Sender_account = Receiver_account").count() == 0
    assert generator.counts(generator.N_TOTAL) == generator.TYPOLOGIES
    ready = prepare(df)
    assert ready.where("hour not between 0 and 23 or date is null").count() == 0 and "Time" not in ready.columns


def test_synthetic_counts_are_of_the_full_size(spark):
    got = {r["Laundering_type"]: r["n"] for r in QUERIES["synthetic_counts"](spark, "").collect()}
    assert sum(got.values()) == generator.N_TOTAL and {k: n for k, n in got.items() if k} == generator.TYPOLOGIES


def test_date_formats(spark):
    assert infer_date_format(spark.createDataFrame([("31/01/2024",), ("01/02/2024",)], "d string"), "d")[0] == "dd/MM/yyyy"
    assert infer_date_format(spark.createDataFrame([("x",)], "d string"), "d")[0] is None


def test_unseen_pairs_and_leakage(spark):
    df = spark.createDataFrame([(i, "a" if i < 6 else "b", "c", float(i), i, "E") for i in range(10)], "txn_id long, sender string, receiver string, amount double, epoch long, pay_currency string").withColumn("date", F.lit("2024-01-01"))
    t = features.time_split(df)
    features.assert_no_leakage(t)
    train = t.where("period = 'train'")
    got = features.apply_pairs(t, features.fit_pairs(train)).where("is_new_pair = 1")
    assert got.where("period = 'train'").count() == 0


def test_stream_of_bursts(spark, tmp_path):
    from tidewatch.streaming.alerts import hourly_bursts

    spark.sql("select 'a' sender, timestamp'2024-01-01 10:00:00' + make_dt_interval(0, 0, cast(id as int)) ts, 1.0 amount from range(5)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("sender string, ts timestamp, amount double").parquet(str(tmp_path / "in"))
    q = hourly_bursts(stream).writeStream.format("memory").queryName("bursts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("bursts").first()["n"] == 5
