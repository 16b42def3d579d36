import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.llm import chat, decontaminate, embeddings, jaccard, langid, lines, mixing, tokens, toxicity, warc
from tidewatch.llm.covertree import build, dual, unit
from tidewatch.sources.shared import new_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]


def prose(seed, n):
    return " ".join(WORDS[i] for i in np.random.default_rng(seed).integers(0, 300, n))


@pytest.fixture(scope="module")
def docs(spark):
    base = prose(1, 60)
    rows = [(1, base, "en", "a", 1), (2, base, "en", "a", 1), (3, base + " tail", "en", None, 1), (4, prose(2, 60), "de", "b", 1), (5, None, None, "b", None), (6, "", "en", None, 0), (7, "two words", "en", "a", 1), (7, "two words", "en", "a", 1), (None, base, None, "c", 1), (8, prose(3, 30_000), "en", "c", 1)]
    return spark.createDataFrame(rows, DOCS).withColumn("m", F.lit("clash")).withColumn("key", F.lit(0))


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_mix(spark, docs):
    got = mixing.mix(docs).collect()
    assert [r.asDict() for r in sorted(got, key=str)] == [r.asDict() for r in sorted(mixing.mix(docs).collect(), key=str)]
    assert mixing.mix(docs, {"a": 1.0}).where("source is null or source <> 'a'").count() == 0
    assert mixing.mix(empty(spark)).count() == 0
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("source"))
    out = {r[0]: r[1] for r in mixing.mix(many, {"x": 0.9, "y": 0.1}).groupBy("source").count().collect()}
    assert abs(out["x"] - 18_000) < 600 and abs(out["y"] - 2_000) < 250
    assert 36_000 < mixing.mix(many.limit(20), size=40_000.0).count() < 44_000  # means over STEP


def test_cover_tree_finds_all_pairs():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 16))
    x[100:150] = x[:50] + rng.normal(size=(50, 16)) * 0.15
    x[150:160] = x[0]
    a, b = build(np.arange(200), unit(x[:200])), build(np.arange(200, 300), unit(x[200:]))
    cos = unit(x) @ unit(x).T
    got = {tuple(sorted((a.ids[i], a.ids[j]))) for p, q in dual(a, a, 0.9) for i, j in zip(p, q)}
    assert got == {(i, j) for i in range(200) for j in range(i + 1, 200) if cos[i, j] >= 0.9}
    assert {(a.ids[i], b.ids[j]) for p, q in dual(a, b, 0.5) for i, j in zip(p, q)} == {(i, j) for i in range(200) for j in range(200, 300) if cos[i, j] >= 0.5}


def test_near_vectors_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (5, None), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [1.0, None]), (9, []), (None, [1.0, 0.0]), (10, [0.3, 1.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[4] == (1, 4, True) and got[10] == (1, 4, False)
    assert all(got[i] == (0, i, True) for i in (5, 6, 7, 8, 9)) and got[None] == (0, None, False)
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", ""]), st.lists(st.sampled_from([*chat.CONTROLS, "\\", "\n", "x", "[", "<", "é", "]"]), max_size=12).map("".join)), max_size=5))
def test_grammar_round_trip(turns):
    text = chat.BOS + "".join(chat.render_turn(r, t)[0] for r, t in turns) + chat.EOS
    assert chat.parse(text) == turns


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "[INST]\\"), (2, None, None, None), (None, 0, "assistant", "é")]
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\nhi\nassistant\n[INST]\\\n").hexdigest() and got[1]["loss_chars"] == 7
    assert got[None]["loss_sha256"] == hashlib.sha256("é".encode()).hexdigest() and got[2]["n_turns"] == 1
    long = spark.range(300).select(F.lit(5).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.repeat(F.lit("ab<s>"), 2000).alias("text"))
    whole = chat.format_conversations(long)
    assert whole.count() > 1 and chat.read_back(whole).first()["loss_chars"] == 300 * 10_000


def test_leaks(spark, docs):
    item = prose(9, 40)
    bench = spark.createDataFrame([(1, item), (2, "too short"), (3, None), (4, prose(10, 40)), (4, item)], "item_id long, text string")
    rows = [(1, prose(11, 50) + " " + item.upper().replace(" ", ", ") + " " + prose(12, 50)), (2, prose(13, 80)), (3, item[: len(item) // 2]), (4, " ".join(item.split()[:39]) + " zz"), (5, None), (6, ""), (None, item)]
    got = {(r[0], r[1]) for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(d, i) for d in (1, 4, None) for i in (1, 4)}
    left = decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    assert {r[0] for r in left.collect()} == {2, 3, 5, 6}
    assert decontaminate.decontaminate(docs, bench).count() == docs.count() and decontaminate.leaks(empty(spark), bench).count() == 0


def test_leaks_of_items_with_a_repeated_word(spark):
    """An item that ends in a run of one word; in the document the run is another word's, or is prose: similarity 0.8 at least."""
    n = 20
    starts = [prose(200 + i, 244) for i in range(n)]
    bench = spark.createDataFrame([(i, t + " fill" * 30) for i, t in enumerate(starts)], "item_id long, text string")
    rows = [(i, t + " " + prose(300 + i, 30)) for i, t in enumerate(starts)] + [(n + i, t + " other" * 30) for i, t in enumerate(starts)]
    got = {(r[0], r[1]): r[2] for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert set(got) == {(i, i) for i in range(n)} | {(n + i, i) for i in range(n)} and set(got.values()) == {0.8}


def test_each_occurrence_has_a_vote(spark):
    rows = [([5, 3, 5, 9, 5, 3],), ([1, 2],), ([],), ([3, 5, 5],)]
    got = [r[0] for r in spark.createDataFrame(rows, "h array<long>").select(decontaminate.votes(F.col("h"))).collect()]
    assert [len(set(v)) for v in got] == [6, 2, 0, 3] and {3, 5, 9} < set(got[0]) and set(got[3]) < set(got[0]) and got[1] == [1, 2]


def test_language_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.op5_language_id(spark, "/root/testdata/sf0.01").join(d.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_language_edges(spark, docs):
    got = langid.identify(docs).collect()
    assert all(r["__tw_lang"] == "und" for r in got if not r["text"]) and all(0 <= r["__tw_score"] <= 1 for r in got)
    assert langid.identify(empty(spark)).count() == 0
    model = langid.Model(["x", "y"], np.zeros(2), np.random.default_rng(0).normal(size=(1 << langid.BITS, 2)))
    long = "héllo wörld " * 60_000  # slices add up to the whole
    f = langid.fold(long)
    brute = sum(model.logp[g].sum(0) for g in langid.grams(f))
    assert model.score([long, "a"])[0][0] == "xy"[int(brute.argmax())]


def test_toxicity_without_labels(spark, docs):
    none = toxicity.classify(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none.count() == docs.count() and none.where("__tw_flags[1]").count() == 0


def test_telling_words():
    y = np.r_[np.ones(20), np.zeros(180)]
    rows = np.r_[np.arange(15), np.arange(200), [3, 190]]
    cols = np.r_[np.zeros(15), np.ones(200), [2, 2]].astype(int)
    x = toxicity.Sparse(rows, cols, 200, 4, np.zeros((200, 0)))
    assert toxicity.telling(x, y, 15.1).tolist() == [True, False, False, False]
    w, b = toxicity.fit_words(x, y, 15.1)
    assert w[0] > 1 and not w[1:].any() and x.dot(w)[0] + b > 0 > x.dot(w)[30] + b


def test_toxicity_f1(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    marks = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    _, report = toxicity.fit(d.join(marks, "doc_id"))
    assert report["toxic"] > 0.9


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=9), max_size=6))
def test_vbyte_round_trip(parts):
    counts = np.array([len(p) for p in parts], dtype=np.int64)
    values = np.array([v for p in parts for v in p], dtype="<u4")
    assert np.array_equal(tokens.decode(*tokens.encode(values, counts), counts), values)


def test_encoder_equals_the_tokenizer():
    enc = tokens.encoder(tokens.default_tokenizer())
    texts = ["", "a  b", "tab\tx", " lead", "trail ", "it's we'll", "x²y a²", "naïve, 12,5 a_b", "日本語 テスト.", "a\n\nb", "\n", "é x", "don't. stop,,.", "x\x1cy", "A<|endoftext|>b", "a\x02b", "x\x00y", "x\n's 's", "café\ncafé", "½ x"]
    for which, ids, ends in enc.batch(pa.array(texts, pa.string())):
        for k, s, e in zip(which, [0, *ends[:-1]], ends):
            assert ids[s:e].tolist() == enc.tokenizer.encode(texts[k], add_special_tokens=False).ids + [2], repr(texts[k])


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    rows = sorted(((r["doc_id"], t.encode(r["text"] or "", add_special_tokens=False).ids + [2]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, len(r[1])))
    got = sorted(tokens.tokens(docs, with_ids=True).collect(), key=lambda r: r["start"])
    start = 0
    for (doc, ids), r in zip(rows, got, strict=True):
        assert (r["doc_id"], r["start"], r["n_tokens"], list(r["ids"])) == (doc, start, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)
    assert tokens.tokens(empty(spark)).count() == 0


def brute_classes(rows, t=0.8):
    def grams(x):
        w = (x or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    s = [(d, grams(x)) for d, x in rows]
    return {d: sum(1 for j, (e, h) in enumerate(s) if j != i and g and h and len(g & h) / len(g | h) >= t) for i, (d, g) in enumerate(s) if d is not None}


def test_jaccard(spark, docs, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None]
    base = prose(20, 80).split()
    rows += [(100 + i, " ".join(base[: 80 - i % 5] + [f"x{i}"])) for i in range(40)]
    df = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string")
    for block in (512, 8):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        got = jaccard.links_and_classes(df).collect()
        assert {r["doc_id"]: r["n_links"] for r in got if r["doc_id"] is not None} == brute_classes(rows)
        assert {r["class_id"] for r in got if (r["doc_id"] or 0) >= 100} == {100}
    kept = jaccard.keep_one(docs)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "4", "5", "6", "7", "8", "None"] and kept.columns == docs.columns
    assert jaccard.links_and_classes(empty(spark)).count() == 0


def test_lines_both_ways(spark):
    rows = [(i, "h" if i % 3 else None, f"menu\n body {i} \n\nmenu \nfoot {i % 2}") for i in range(40)] + [(99, "h", None), (98, "h", "")]
    df = spark.createDataFrame(rows, "id long, host string, text string")
    a = sorted(map(str, lines.drop_boilerplate(df, 0.6).collect()))
    assert a == sorted(map(str, lines.drop_boilerplate(df, 0.6, limit=0).collect()))
    one = lines.drop_boilerplate(df, 0.6).where("id = 4").first()
    assert one["text"] == " body 4 \n\nfoot 0" and one["n_dropped"] == 2
    assert lines.drop_boilerplate(df.limit(0)).count() == 0


def test_warc(spark):
    same = "<p>" + "x" * 200
    rows = [(3, "u\r\nX: y", same), (1, None, same), (1, "u", same), (2, "u", "short"), (4, "u", "short"), (5, "u", None), (None, "u", same), (6, "u", "a\r\n\r\nWARC/1.1\r\n\r\n" + "é" * 100)]
    path = new_path(spark, "warc-test")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = warc.captures(warc.read_records(spark, path, with_payload=True)).collect()
    assert len(got) == len(rows) and all(r["request"] and r["metadata"] and r["main"] for r in got)
    kinds = sorted((str(r["metadata"]["page_id"]), r["main"]["kind"], r["metadata"]["refers_to_page"]) for r in got)
    assert kinds == [("1", "response", None), ("1", "revisit", 1), ("2", "response", None), ("3", "revisit", 1), ("4", "response", None), ("5", "response", None), ("6", "response", None), ("None", "revisit", 1)]
    six = next(r for r in got if r["metadata"]["page_id"] == 6)
    assert bytes(six["main"]["payload"]) == rows[-1][2].encode()


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = corpus_pipeline.language_id(spark, docs, sf)
    rows = [(r["doc_id"], r["text"]) for r in first.collect()]
    assert first.columns == docs.columns and len(rows) <= docs.count()
    kept = corpus_pipeline.near_duplicates(spark, first, sf)
    links = brute_classes([(d, " ".join(w for w in __import__("regex").split(r"[^\p{L}\p{N}]+", x.lower()) if w)) for d, x in rows])
    ids = {r["doc_id"] for r in kept.collect()}
    assert {d for d, n in links.items() if n == 0} <= ids and len(ids) < len(rows)
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "start", "n_tokens", "ids_crc32"} <= set(out.columns) and out.count() > 0
