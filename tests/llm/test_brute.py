"""Operators and pipeline stages against plain-Python versions."""

import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewatch.llm import decontaminate, embeddings, jaccard, langid, mixing, tokens, toxicity
from tidewatch.llm.covertree import build, unit

SF = "/root/testdata/sf0.001"


def few(spark, rows, kinds):
    """Rows as a table with further columns whose names the operators use inside."""
    return spark.createDataFrame(rows, kinds).withColumns({c: F.lit(c) for c in ("key", "h", "w", "n", "k", "m", "s", "it", "at", "item", "place", "node", "component", "size", "row", "r", "d", "b")})


# --- language ID ---

LANGS = [("the cat sat on the mat", "en"), ("a dog and the fox", "en"), ("der hund und die katze", "de"), ("ein fuchs auf der matte", "de"), ("le chat et le chien", "fr"), ("", "fr"), (None, "fr"), ("12 34", "de"), ("un renard", None), ("le chat et le chien", "fr")]


@pytest.mark.parametrize("at_once", [200, 2, 1])
def test_language_model(spark, at_once, monkeypatch):
    monkeypatch.setattr(langid, "SLICE", 7)
    model, plain = langid.train(few(spark, LANGS, "text string, lang string"), at_once=at_once), brute.Bayes(LANGS)
    assert [k for m in model for k in m.langs] == ["de", "en", "fr"]
    for m in model:
        for i, lang in enumerate(m.langs):
            assert np.isclose(m.prior[i], np.log(plain.docs[lang] / sum(plain.docs.values())))
            for b in {*plain.seen["de"], *plain.seen["en"], 1, 2}:
                assert np.isclose(m.logp[b, i], plain.logp(lang, b))
    texts = ["the katze", "chien und fox", "", None, "42", "Le Chat!", "zzz", "日本語", "the cat sat on the mat " * 9, "the cat sat on the mat " * 9]
    df = few(spark, list(enumerate(texts)), "id long, text string")
    got = {r["id"]: r for r in langid.predict(df, model).collect()}
    for i, t in enumerate(texts):
        lang, post, fit = plain.predict(t)
        assert got[i]["__tw_lang"] == lang and np.isclose(got[i]["__tw_score"], post) and np.isclose(got[i]["__tw_fit"], fit, atol=1e-6)
    assert langid.predict(df, model).columns == [*df.columns, "__tw_lang", "__tw_score", "__tw_fit"]


def test_language_ties_and_no_rows(spark):
    same = few(spark, [("abc", "y"), ("abc", "x")], "text string, lang string")
    for at_once in (200, 1):
        got = langid.predict(few(spark, [("abc",)], "text string"), langid.train(same, at_once=at_once)).first()
        assert got["__tw_lang"] == "x" and np.isclose(got["__tw_score"], 0.5)
    none = langid.train(same.limit(0))
    assert none == [] and langid.predict(same, none).first()["__tw_lang"] == "und" and langid.predict(same.limit(0), none).count() == 0


# --- toxicity ---

def test_toxicity_against_dense_chain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    marks = [(text[r["doc_id"]], r["quality"], r["toxic"]) for r in labels.collect() if text.get(r["doc_id"]) is not None and r["quality"] is not None and r["toxic"] is not None]
    ids = [d for d in text if text[d]]
    want, cuts = brute.toxicity_chain(marks, [text[d] for d in ids])
    got = {r["doc_id"]: r for r in toxicity.classify(docs, labels).collect()}
    assert len(got) == len(text)
    for d, scores in zip(ids, want):
        assert np.allclose(got[d]["__tw_scores"], scores, atol=0.02)
        for k in range(2):
            if abs(scores[k] - cuts[k]) > 0.02:
                assert got[d]["__tw_flags"][k] == (scores[k] >= cuts[k])


def test_toxicity_of_repeated_and_odd_rows(spark):
    rows = [(i, f"good fine words {i % 7} here", 1, 0) for i in range(60)] + [(100 + i, f"vile nasty words {i % 5} here", 0, 1) for i in range(30)]
    marks = few(spark, [(i, q, t) for i, _, q, t in rows] + [(None, 1, 0), (999, 0, 1), (0, 1, None)], "doc_id long, quality int, toxic int")
    docs = few(spark, [(i, t) for i, t, _, _ in rows] + [(None, "vile nasty"), (500, None), (501, ""), (502, "?!"), (503, "vile nasty " * 20_000), (503, "vile nasty " * 20_000)], "doc_id long, text string")
    got = toxicity.classify(docs, marks)
    flags = [(r["doc_id"], tuple(r["__tw_flags"])) for r in got.collect()]
    assert len(flags) == docs.count() and not any(f for d, f in flags if d in (500, 501, 502) for f in f) and [f for d, f in flags if d == 503] == [(True, True)] * 2
    assert all(f == ((True, True) if 100 <= d < 200 else (False, False)) for d, f in flags if d is not None and d < 500)
    assert toxicity.classify(docs.limit(0), marks).count() == 0
    once = toxicity.fit(spark.createDataFrame([(t, q, x) for _, t, q, x in rows], "text string, quality int, toxic int"), cap=6)[0]
    assert sum(len(w) for w in once.weights) > 0  # a sample of texts, not of rows


# --- near duplicates, embeddings ---

def test_punctuation_after_known_letters_asks_nothing_of_the_model(monkeypatch):
    import pyarrow as pa

    enc, asked = tokens.Encoder(tokens.default_tokenizer(), 2), []
    ids = lambda texts: [x for _, got, ends in enc.batch(pa.array(texts)) for x in np.split(got, ends)[:-1]]
    ids(["I know lettres, été and été.%%% now"])
    word = enc._word
    monkeypatch.setattr(enc, "_word", lambda w: asked.append(w) or word(w))
    texts = ["I know, lettres. été!! and,%%% été; now", "I know's été's l'été a-b. x1, —, ा. now"]
    assert [x.tolist() for x in ids(texts[:1])] == [enc.tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts[:1]]
    assert all(w[0] in "\x02\x03" for w in asked)
    assert [x.tolist() for x in ids(texts)] == [enc.tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]


def test_vectors_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 24)
    monkeypatch.setattr(embeddings, "SAMPLE", (16, 48))
    rng = np.random.default_rng(3)
    x = rng.normal(size=(360, 12))
    x[60:200] = x[:7].repeat(20, axis=0) + rng.normal(size=(140, 12)) * 0.12
    x[200:240] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype("f4").astype(float))]
    rows += [(5, rows[300][1]), (400, rows[5][1]), (400, rows[5][1]), (401, [1.0, 2.0]), (402, [2.0, 4.0]), (403, None), (None, rows[1][1])]
    ok = [(i, np.array(v)) for i, v in rows if i is not None and v is not None]
    near = lambda a, b: len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.95
    pairs = [(p, q) for p in range(len(ok)) for q in range(p) if near(ok[p][1], ok[q][1])]
    links = Counter(e for p in pairs for e in p)
    group = brute.groups({i for i, _ in ok}, [(ok[p][0], ok[q][0]) for p, q in pairs])
    got = embeddings.near_vectors(few(spark, rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == len(rows)
    assert Counter((r["vec_id"], r["n_links"]) for r in got if r["vec_id"] is not None and r["vec_id"] != 403) == Counter((ok[p][0], links[p]) for p in range(len(ok)))
    for r in got:
        if r["vec_id"] in group:
            assert r["component_id"] == group[r["vec_id"]] and r["kept"] == (r["vec_id"] == r["component_id"])
    assert embeddings.near_vectors(few(spark, rows, "vec_id long, embedding array<double>").limit(0)).count() == 0


def test_vectors_of_many_blocks_are_not_shuffled_by_pairs(spark, monkeypatch):
    """Without structure all pairs of blocks meet: four times the rows, shuffled bytes grow about as they do, also if blocks are sent in many waves."""
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    monkeypatch.setattr(embeddings, "WAVE_BYTES", 30_000, raising=False)
    monkeypatch.setattr(embeddings, "SAMPLE", (16, 48))
    written = lambda: spark._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    rng = np.random.default_rng(4)
    took = []
    for n in (150, 600):
        x = rng.normal(size=(n, 64)).astype("f4")
        x[-20:] = x[:20] * (1 + rng.normal(size=(20, 64)) * 0.01)
        before = written()
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_vectors(few(spark, [(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()}
        took.append(written() - before)
        assert got == {i: (1, i) if i < 20 else (1, i - n + 20) if i >= n - 20 else (0, i) for i in range(n)}
    assert took[1] < 6 * took[0]


def test_block_pairs_grow_with_clustered_rows():
    """Vectors about centres that are far from each other: pairs of blocks that may hold a pair grow about as the rows."""
    counts = []
    for times in (1, 4, 16):
        rng = np.random.default_rng(9)
        centres = unit(rng.normal(size=(8 * times, 64)))
        x = unit(centres.repeat(256, axis=0) + rng.normal(size=(2048 * times, 64)) * 0.01)
        tree = build(np.arange(64 * times), x[:: len(x) // (64 * times)][: 64 * times])
        from tidewatch.llm.covertree import deal

        leaf, far = deal(tree, x)
        k = np.bincount(leaf, minlength=len(tree.levels[-1]["lo"]))
        radius = np.zeros(len(k))
        np.maximum.at(radius, leaf, far)
        _, _, many, runs = embeddings.partners(tree, k, radius, 0.95)
        counts.append(sum(n for r, m in zip(runs, many) for _, n in r))
    assert counts[2] <= counts[0] * 16 * 3


def test_jaccard_with_a_hub_and_small_blocks(spark, monkeypatch):
    from tidewatch.operators import components

    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in rng.integers(0, 500, 90)]
    rows = [(i, " ".join([*base[: 90 - i % 6], f"x{i % 9}"])) for i in range(70)] + [(200 + i, " ".join(f"v{k}" for k in rng.integers(0, 400, 40))) for i in range(20)]
    rows += [(300, " ".join(f"u{i}" for i in range(20_000))), (301, " ".join(f"u{i}" for i in range(1, 20_001))), (302, None), (303, ""), (304, "a b"), (305, "A, b!"), (304, "a b")]
    sets = [(d, brute.shingle_set(t)) for d, t in rows]
    pairs = [(p, q) for p in range(len(sets)) for q in range(p) if sets[p][1] and sets[q][1] and len(sets[p][1] & sets[q][1]) / len(sets[p][1] | sets[q][1]) >= 0.8]
    links = Counter(e for p in pairs for e in p)
    group = brute.groups({d for d, _ in rows}, [(rows[p][0], rows[q][0]) for p, q in pairs])
    for split, block, size in ((10_000, 512, 48 << 20), (1, 8, 48 << 20), (1, 512, 4000)):
        monkeypatch.setattr(components, "SPLIT_EDGES", split)
        monkeypatch.setattr(jaccard, "BLOCK", block)
        monkeypatch.setattr(jaccard, "BLOCK_BYTES", size)
        got = jaccard.links_and_classes(few(spark, rows, "doc_id long, text string")).collect()
        assert Counter((r["doc_id"], r["n_links"], r["class_id"]) for r in got) == Counter((rows[p][0], links[p], group[rows[p][0]]) for p in range(len(rows)))


# --- decontamination ---

def prose(seed, n, kinds=300):
    return " ".join(f"w{i}" for i in np.random.default_rng(seed).integers(0, kinds, n))


def test_leaks_against_all_windows(spark):
    items = [(i, prose(i, 12 + 9 * i)) for i in range(6)] + [(10, "alpha beta"), (11, "gamma"), (12, "one two three four"), (13, ""), (14, None), (None, prose(77, 30)), (15, "run " * 30), (0, "another text of the same item id with words enough")]
    texts = [prose(50, 30) + " " + t + " " + prose(51, 40) for _, t in items if t] + [" ".join(w if i % 11 else "zz" for i, w in enumerate(items[3][1].split())), items[4][1][: len(items[4][1]) * 9 // 10], "alpha beta", "alpha", "Beta alpha; ALPHA beta.", "one two three", None, "", prose(60, 20_000) + " " + items[5][1], "run " * 40]
    rows = [*enumerate(texts), (3, items[1][1]), (None, items[2][1])]
    got = {(r[0], r[1]): r[2] for r in decontaminate.leaks(few(spark, rows, "doc_id long, text string"), few(spark, items, "item_id long, text string")).collect()}
    want = brute.leaks(rows, items)
    assert set(got) == set(want) and all(np.isclose(got[k], want[k]) for k in want)
    docs, bench = few(spark, rows, "doc_id long, text string"), few(spark, items, "item_id long, text string")
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {d for d, _ in rows} - {d for d, _ in want}
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0 and decontaminate.decontaminate(docs, bench.limit(0)).count() == len(rows)


def test_a_small_benchmark_is_one_file(spark, monkeypatch):
    kept, stored = {}, decontaminate.stored
    monkeypatch.setattr(decontaminate, "stored", lambda df, tag: kept.setdefault(tag, stored(df, tag)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(9))) for i in range(60)], "item_id long, text string")
        got = decontaminate.leaks(few(spark, [(1, "a " + " ".join(f"w7x{k}" for k in range(9)))], "doc_id long, text string"), table).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, 7)]
    assert len(kept["items"].inputFiles()) == 1 and kept["items"].count() == 60


def test_leak_candidates_are_few(spark):
    """Windows that are fingerprinted grow with the copies of items, not with documents times items."""
    counts = []
    for n in (10, 40):
        items = [(i, prose(1000 + i, 60, 5000)) for i in range(n)]
        rows = [(i, prose(5000 + i, 100, 5000) + " " + items[i][1]) for i in range(n)] + [(n + i, prose(9000 + i, 200, 5000)) for i in range(n)]
        table = spark.createDataFrame(items, "item_id long, text string").select("item_id", decontaminate.words(F.col("text")).alias("w"))
        table = table.select("item_id", F.xxhash64("w").alias("item"), (F.size("w") - 4).alias("m"), decontaminate.shingle_hashes(F.col("w")).alias("h"))
        found = decontaminate.candidates(spark.createDataFrame(rows, "doc_id long, text string"), table, 0.8)
        counts.append(found.select(F.explode("ats.items").alias("i")).agg(F.sum(F.size("i"))).first()[0])
    assert counts[0] >= 10 and counts[1] <= 5 * counts[0] and counts[1] <= 40 * 14


# --- the pipeline, stage by stage ---

@pytest.fixture(scope="module")
def steps(spark):
    """What each stage got and gave, as the pipeline runs them: written and read between stages."""
    out, docs = {}, spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = corpus_pipeline.new_path(spark, "test")
        stage(spark, docs, SF).write.parquet(path)
        done = spark.read.parquet(path)
        out[name] = (docs, done)
        docs = done
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stage_language_id(steps):
    docs, done = steps["language_id"]
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    plain = brute.Bayes([(t, g) for d, t, g in rows if not brute.held_out(d)])
    kept = []
    for d, t, _ in rows:
        lang, post, fit = plain.predict(t)
        kept += [d] * (lang != "und" and post >= corpus_pipeline.LEAST_SCORE and fit >= corpus_pipeline.LEAST_FIT)
    assert ids(done) == sorted(kept) and done.columns == docs.columns


def test_stage_near_duplicates(steps):
    docs, done = steps["near_duplicates"]
    rows = [(r["doc_id"], brute.shingle_set(r["text"])) for r in docs.collect()]
    pairs = [(a, b) for i, (a, x) in enumerate(rows) for b, y in rows[:i] if x and y and len(x & y) / len(x | y) >= 0.8]
    group = brute.groups([d for d, _ in rows], pairs)
    assert ids(done) == sorted(d for d, _ in rows if group[d] == d) and done.columns == docs.columns and len(pairs) > 0


def test_stage_benchmark_leaks(spark, steps):
    docs, done = steps["benchmark_leaks"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {d for d, _ in brute.leaks([(r["doc_id"], r["text"]) for r in docs.collect()], items)}
    assert ids(done) == sorted(set(ids(docs)) - bad) and done.columns == docs.columns


def test_stage_mix_sources(steps):
    docs, done = steps["mix_sources"]
    want = brute.poisson_copies([(r["doc_id"], r["source"]) for r in docs.collect()])
    assert Counter(ids(done)) == Counter({d: n for d, n in want.items() if n}) and done.columns == docs.columns
    whole = {tuple(r) for r in docs.collect()}
    assert all(tuple(r) in whole for r in done.collect())


def test_stage_token_ids(steps):
    from tokenizers import Tokenizer

    docs, done = steps["token_ids"]
    t = Tokenizer.from_file(tokens.default_tokenizer())
    code = lambda text: t.encode(text or "", add_special_tokens=False).ids + [tokens.END_ID]
    want = Counter((r["doc_id"], len(c := code(r["text"])), zlib.crc32(np.array(c, dtype="<u4").tobytes())) for r in docs.collect())
    got = done.orderBy("start").collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got]])[:-1].tolist()
    order = [r["doc_id"] for r in got]
    assert order != sorted(order) and sum(a == b for a, b in zip(order, order[1:])) < max(3, len(order) // 20)


def test_run_gives_the_stages_rows(spark, steps):
    got, want = corpus_pipeline.run(spark, SF), steps["token_ids"][1]
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_stages_on_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(1, None, "en", "a", None), (2, "", None, None, 0), (None, "some words of a text that is not long", "en", "a", 1), (None, "some words of a text that is not long", "en", "a", 1), (3, "the same words again and again", "en", "b", 1), (3, "the same words again and again", "en", "b", 1), (4, "日本 語", "ja", "c", 1), (5, "word " * 60_000, "en", None, 1)]
    spark.createDataFrame([(1, "an item that nothing here holds at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, schema).withColumns({c: F.lit(0) for c in ("key", "m", "d", "n", "place", "class_id", "similarity")})
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name == "token_ids":
                assert out.count() == len(rows)
            else:
                assert out.columns == docs.columns and out.count() <= max(len(rows), 30) and (rows or out.count() == 0)


def test_mix_ties_and_places(spark):
    docs = few(spark, [(1, "t", "x"), (1, "t", "x"), (1, "u", "x")], "doc_id long, text string, source string")
    got = mixing.mix(docs, size=30.0).select("text", "mix_copy", "mix_key").collect()
    keys = {}
    for r in got:
        assert keys.setdefault(r["mix_copy"], r["mix_key"]) == r["mix_key"]  # one doc_id, one position a copy
    assert Counter(r["text"] for r in got)["t"] == 2 * Counter(r["text"] for r in got)["u"]
    placed = mixing.placed(docs).select("mix_key").collect()
    assert len({r[0] for r in placed}) == 3
