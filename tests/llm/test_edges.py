"""Ties, repeated rows, empty tables, very long texts and columns whose names the operators use inside."""

import hashlib
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import chat, lines, tokens, warc
from tidewatch.sources.shared import new_path

TURNS = "conv_id long, turn long, role string, text string"


def clash(df):
    return df.withColumns({c: F.lit(c) for c in ("key", "n", "row", "digest", "bytes", "name", "r", "d", "first", "ls", "kept", "bad", "met", "site", "place", "part", "loss")})


def test_roles_come_back():
    for role in ("us\ner", "a\\\nb", "[INST]", "\n", "\\", "x\r\ny", "</s>\n[/INST]"):
        for text in ("", "\n", "a\nb", "[/INST]\\"):
            turn, begins, escaped = chat.render_turn(role, text)
            assert chat.parse(chat.BOS + turn + chat.EOS) == [(role, text)] and chat.unescape(turn[begins : -len(chat.CLOSE)]) == text and escaped


def test_chat_against_its_source(spark):
    rows = [(1, 0, "us\ner", "x"), (1, 1, "assistant", "y\n"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (1, None, "assistant", "last"), (2, 0, "assistant", "<s>" * 200_000), (3, 0, "assistant\n", "not learnt from")]
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(clash(spark.createDataFrame(rows, TURNS)))).collect()}
    order = [("us\ner", "x"), ("assistant", "a"), ("assistant", "a"), ("assistant", "y\n"), ("assistant", "last")]
    assert got[1]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in order).encode()).hexdigest()
    assert got[1]["loss_sha256"] == hashlib.sha256("".join(t for r, t in order[1:]).encode()).hexdigest() and got[1]["loss_chars"] == 8
    assert got[2]["loss_chars"] == 600_000 and got[3]["loss_chars"] == 0 and len(got) == 3
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], TURNS))).count() == 0


def test_chat_sql_of_odd_roles(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = [(1, 0, "us\ner", "x"), (1, 1, "assistant", "y\\"), (2, 0, "[INST]", None), (2, 1, None, "<s>")]
    got = chat.read_back(chat.format_conversations(spark.createDataFrame([*rows, (-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)], TURNS)))
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    want = con.execute(chat.SQL).fetchdf()
    assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == sorted(want.itertuples(index=False, name=None))


def test_lines_of_odd_pages(spark):
    long = "z" * 200_000
    rows = [(i, "h", f"{long}\nown {i}\nhalf" if i % 2 else f"{long}\nown {i}") for i in range(10)] + [(20, "lone", "a\nb\na"), (21, None, "a"), (22, None, "a"), (22, None, "a")]
    df = clash(spark.createDataFrame(rows, "id long, host string, text string"))
    for limit in (10**6, 0):
        got = lines.drop_boilerplate(df, 0.5, limit=limit).collect()
        assert {r["text"] for r in got if r["host"] == "h"} == {f"own {i}\nhalf" if i % 2 else f"own {i}" for i in range(10)}  # half is at the very ratio
        assert [r["text"] for r in got if r["host"] == "lone"] == ["a\nb\na"] and [(r["text"], r["n_dropped"]) for r in got if r["host"] is None] == [("", 1)] * 3
        assert lines.drop_boilerplate(df.limit(0), limit=limit).count() == 0


def test_lines_too_large_to_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(i, "h", f"{'menu ' * 50}\nown {i}") for i in range(10)], "id long, host string, text string")
    monkeypatch.setattr(lines, "LINE_BYTES", 10)
    assert {r["text"] for r in lines.drop_boilerplate(df, 0.5).collect()} == {f"own {i}" for i in range(10)}


def test_warc_of_odd_pages(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3_000_000)
    long = "é" * 1_000_000
    rows = [(5, "u", long), (4, "u", long), (4, "u", long), (7, None, None), (8, "u", "x" * 99), (9, "u", "x" * 99), (10, "u", "x" * 100), (11, "u", "x" * 100)]
    path = new_path(spark, "warc-test")
    warc.write_warc(clash(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)), path)
    records = warc.read_records(spark, path)
    got = warc.captures(records.withColumn("n", F.lit(1))).collect()
    kinds = sorted((r["metadata"]["page_id"], r["main"]["kind"], r["metadata"]["refers_to_page"]) for r in got)
    assert kinds == [(4, "response", None), (4, "revisit", 4), (5, "revisit", 4), (7, "response", None), (8, "response", None), (9, "response", None), (10, "response", None), (11, "revisit", 10)]
    assert {r["main"]["http_length"] for r in got} == {2_000_000, 0, 99, 100}
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).count()
    assert files > 1
    empty = new_path(spark, "warc-test")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc.captures(warc.read_records(spark, empty)).count() == 0


def test_encoder_of_letters_and_marks():
    """Words are cut by Python's idea of a letter and by the tokenizer's: they must be one."""
    enc = tokens.encoder(tokens.default_tokenizer())
    assert enc.by_words
    chars = [chr(i) for i in range(1, 0x30000) if unicodedata.category(chr(i))[0] in "LNMPS" and (i < 0x3000 or i % 61 == 0)]
    texts = [f"a{c}b {c} {c}{c}, x{c}" for c in chars]
    for which, ids, ends in enc.batch(pa.array(texts, pa.string())):
        for k, s, e in zip(which, [0, *ends[:-1]], ends):
            assert ids[s:e].tolist() == enc.tokenizer.encode(texts[k], add_special_tokens=False).ids + [2], repr(texts[k])


def test_encoder_of_other_tokenizers():
    import public_tokenizers

    enc = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"), 2)
    assert not enc.by_words
    texts = ["Hello world, it's", "", "two\n\nlines  x"]
    (which, ids, ends), = enc.batch(pa.array(texts, pa.string()))
    assert [ids[s:e].tolist() for s, e in zip([0, *ends[:-1]], ends)] == [enc.tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]


def test_encoder_forgets(monkeypatch):
    enc = tokens.Encoder(tokens.default_tokenizer(), 2)
    monkeypatch.setattr(tokens, "MEMORY", 2_000)
    texts = [" ".join(f"w{i}x{k}" for k in range(40)) + " " + "q" * 500 for i in range(20)]
    for _ in range(2):
        (_, ids, ends), = enc.batch(pa.array(texts, pa.string()))
        assert [ids[s:e].tolist() for s, e in zip([0, *ends[:-1]], ends)] == [enc.tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert not enc.now and not any(len(w) > tokens.WORD for w in enc.old)  # what one slice brought is the older generation now
    enc.batch(pa.array(["a few words, words."], pa.string()))
    assert set(enc.now) == {"few", "words"} and enc.taken < 2_000


def test_shards_by_place(spark):
    df = spark.createDataFrame([(i, f"text {i}", (i * 7) % 10) for i in range(10)], "doc_id long, text string, place long")
    got = tokens.tokens(clash(df.withColumnRenamed("place", "mine")), place="mine").orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted(range(10), key=lambda i: (i * 7) % 10)
