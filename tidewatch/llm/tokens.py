"""Token ids in shard files: frequency-ranked, byte-aligned variable length, control bytes apart from data bytes.

A shard file is a run of blocks, each followed by one line feed. A block:

    magic "TWT1", u32 documents, u64 ids, u64 control bytes, u64 data bytes
    documents x (i64 doc_id, u8 is null, u64 ids)
    control bytes: two bits an id, four ids a byte, low bits first: bytes of the id's rank, less one; each document begins a byte
    data bytes: the rank of each id, little-endian, in one to four bytes

Ranks run from the most frequent id of the whole corpus down, so frequent ids take one byte. `ranks` beside the shards holds
them. Spark's text writer commits the files, so a lost executor leaves none half-written, on any file system Spark can reach.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import CACHES, bounded_batches, discard, new_path, partitions, release, stored, tidy

MAGIC = b"TWT1"
HEAD = struct.Struct("<4sIQQQ")
DOC = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("n", "<u8")])
END_ID = 2
#: Bytes of a shard, and ids of a block, to aim for. A longer document is a block of its own.
SHARD_BYTES, BLOCK_IDS = 32 << 20, 1 << 20
#: Bytes, as estimated, that a worker spends on remembered words, in each of two generations, before it forgets the older at the end of a slice; a longer word
#: than WORD characters is not remembered.
MEMORY, WORD = 40 << 20, 64
#: What a remembered word takes besides its characters and ids: the objects and the place in the table.
_ENTRY = 200
#: Bytes of text encoded at a time; a longer text goes alone.
SLICE_BYTES = 4 << 20

_LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], dtype=np.uint8)


def _padded(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes of each document, and the place of each id among the two-bit codes."""
    kind = np.int32 if counts.sum() < 1 << 30 else np.int64
    four = -(-counts // 4)
    ends = np.cumsum(counts)
    place = np.repeat(((np.cumsum(four) - four) * 4 - (ends - counts)).astype(kind), counts)
    place += np.arange(len(place), dtype=kind)
    return four, place


def _starts(size: np.ndarray) -> np.ndarray:
    """Where each value's bytes begin."""
    ends = np.cumsum(size, dtype=np.int32 if len(size) < 1 << 28 else np.int64)
    ends -= size
    return ends


def encode(values: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit values, counts[i] of them in document i."""
    v = np.ascontiguousarray(values, dtype="<u4")
    size = np.ones(len(v), dtype=np.uint8)
    longer = [np.flatnonzero(v > (1 << 8 * k) - 1) for k in (1, 2, 3)]
    for at in longer:
        size[at] += 1
    four, place = _padded(counts)
    codes = np.zeros(int(four.sum()) * 4, dtype=np.uint8)
    codes[place] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    start = _starts(size)
    data = np.empty(int(start[-1]) + int(size[-1]) if len(v) else 0, dtype=np.uint8)
    data[start] = v.astype(np.uint8)
    for k, at in enumerate(longer, 1):
        data[start[at] + k] = v[at] >> 8 * k
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode(control: bytes, data: bytes, counts: np.ndarray) -> np.ndarray:
    """The values of all documents again: lengths by table from the control bytes, then bytes to their places."""
    size = _LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[_padded(counts)[1]]
    start, raw = _starts(size), np.frombuffer(data, dtype=np.uint8)
    out = raw[start].astype("<u4")
    for k in (1, 2, 3):
        at = np.flatnonzero(size > k)
        if not len(at):
            break
        out[at] |= raw[start[at] + k].astype("<u4") << np.uint32(8 * k)
    return out


def write_block(doc_ids: list[int | None], counts: np.ndarray, control: bytes, data: bytes) -> bytes:
    index = np.zeros(len(doc_ids), dtype=DOC)
    index["doc_id"] = [0 if d is None else d for d in doc_ids]
    index["null"] = [d is None for d in doc_ids]
    index["n"] = counts
    return HEAD.pack(MAGIC, len(index), int(counts.sum()), len(control), len(data)) + index.tobytes() + control + data


def read_blocks(raw: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index, ranks) of each block of a shard file."""
    at = 0
    while at < len(raw):
        magic, docs, n, c, d = HEAD.unpack_from(raw, at)
        if magic != MAGIC:
            raise ValueError(f"no block at byte {at}")
        at += HEAD.size
        index = np.frombuffer(raw, dtype=DOC, count=docs, offset=at)
        at += index.nbytes
        ranks = decode(raw[at : at + c], raw[at + c : at + c + d], index["n"].astype(np.int64))
        if len(ranks) != n:
            raise ValueError(f"block of {len(ranks)} ids says {n}")
        yield index, ranks
        at += c + d
        if raw[at : at + 1] != b"\n":
            raise ValueError(f"block does not end at byte {at}")
        at += 1


#: Texts that go through the whole tokenizer: any white space but single spaces and line feeds between words, or one of the three
#: control characters used as marks below.
_SPACES = r"\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_ODD = rf"[{_SPACES}\x02\x03]|[ \n][ \n]|\A[ \n]|[ \n]\z"
_FIRST, _END = "\x02", "\x03"
#: Byte-level alphabet: printable bytes stand for themselves, the others follow from code point 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE = {b: b for b in _PLAIN} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in set(_PLAIN))}
#: ASCII punctuation, a run of which is one piece behind letters.
_MARKS = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum())
#: Pieces of an ASCII word, as the byte-level splitter cuts them.
_PIECE = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+")


#: Settings of a tokenizer file under which a text is its words: byte-level pieces of the standard pattern, nothing changed before, plain BPE.
_SPLITTER = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False}


def splits_by_words(settings: dict) -> bool:
    """Whether Encoder may work word by word; a file with other settings goes through the whole tokenizer, text by text."""
    splitter, model = settings.get("pre_tokenizer") or {}, settings.get("model") or {}
    held = all(settings.get(k) is None for k in ("normalizer", "truncation", "padding"))
    return held and all(splitter.get(k) == v for k, v in _SPLITTER.items()) and all((model.get(k) or None) == (v or None) for k, v in _MODEL.items())


#: _BYTE as code points, by byte; a space parts words and stays.
_SPELT = np.array([32 if b == 32 else _BYTE[b] for b in range(256)], dtype="<u4")


def _spelt(words: list[str]) -> list[str]:
    """Words without a space in the byte-level alphabet."""
    if not words:
        return []
    text = " ".join(words)
    return words if text.isascii() else _SPELT[np.frombuffer(text.encode(), dtype=np.uint8)].tobytes().decode("utf-32-le").split(" ")


class Encoder:
    """Ids of whole texts, the tokenizer being asked once for each word it has not met of late.

    Byte-level BPE splits a text first (a word takes the space before it along; a run of punctuation and a single line feed
    are pieces of their own) and encodes each piece by itself. So where white space comes singly, a text is its words, each with the
    space or line feed before it. ASCII words and words of letters go to the tokenizer's model piece by piece; others, and texts
    with other white space, go through the whole tokenizer.
    """

    def __init__(self, path: str, end_id: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_words = splits_by_words(json.loads(self.tokenizer.to_str()))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end = np.array([end_id], dtype="<u4").tobytes()
        self.line = self.whole("\n")
        self.short: dict[str, bytes] = {}
        self.now: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.taken = 0

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> tuple[bytes, bool]:
        """Ids of a word behind a space that is not letters, or letters and punctuation; behind a line feed or the first mark, of any word, without a space. And
        whether they are worth remembering."""
        mark = word[:1]
        if mark == _END:
            return self.end, False
        text, before, space = (word[1:], self.line, "") if mark == "\n" else (word[1:], b"", "") if mark == _FIRST else (word, b"", "Ġ")
        stem = text.rstrip(_MARKS)
        tail = text[len(stem) :]
        if not space and stem.isalpha() and tail[:1] != "'":
            return before + self._letters("", stem) + (self._piece(tail) if tail else b""), False
        text = " " + text if space else text
        if text.isascii() and text.isprintable():
            return before + b"".join([self._piece(p) for p in _PIECE.findall(text)]), True
        return before + self.whole(text), True

    def _letters(self, space: str, word: str) -> bytes:
        return self._pack(space + (word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE)))

    def _pack(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        if len(piece) > 3:
            return self._pack("Ġ" + piece[1:] if piece[0] == " " else piece)
        if piece not in self.short:  # of three ASCII characters at most, so there are few
            self.short[piece] = self._pack("Ġ" + piece[1:] if piece[0] == " " else piece)
        return self.short[piece]

    def _stems(self, words: pa.Array) -> tuple[list[str], list[tuple[int, bytes]]]:
        """The words, those of letters with punctuation after them without it; and for these, which they are and the ids of the punctuation."""
        # No word holds a space, so all of them become strings at once.
        apart = lambda x: pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x), " ")[0].as_py().split(" ")
        stems = pc.ascii_rtrim(words, characters=_MARKS)
        cut = np.flatnonzero(pc.not_equal(pc.binary_length(stems), pc.binary_length(words)).to_numpy(zero_copy_only=False))
        keys, some = apart(words), pa.array(cut)
        ends: dict[str, bytes] = {}
        tails = []
        for k, stem in zip(cut.tolist(), apart(stems.take(some)), strict=True) if len(cut) else ():
            tail = keys[k][len(stem) :]
            if stem.isalpha() and tail[0] != "'":  # behind letters, an apostrophe may belong to them
                if tail not in ends:
                    ends[tail] = self._piece(tail)
                tails.append((k, ends[tail]))
                keys[k] = stem
        return keys, tails

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, each followed by the end id; where each text ends), for texts that _ODD does not match."""
        marked = pc.binary_join_element_wise(_FIRST, pc.replace_substring(texts, "\n", " \n"), f" {_END}", "")
        lists = pc.split_pattern(marked, " ")
        coded, n_words = lists.flatten().dictionary_encode(), pc.list_value_length(lists).to_numpy()
        del marked, lists
        distinct, codes = coded.dictionary, coded.indices.to_numpy()
        del coded
        keys, tails = self._stems(distinct)
        known, old, new, tokenize = self.now.get, self.old.get, self._word, self.model.tokenize
        found = [known(w) for w in keys]
        fresh: dict[str, bytes] = {}
        once: dict[str, bytes] = {}  # what is not worth remembering
        later = [k for k, ids in enumerate(found) if ids is None]
        letters: dict[str, None] = {}
        strange = []
        for k, ids in zip(later, [old(keys[k]) for k in later], strict=True):
            if ids is not None:
                found[k] = fresh[keys[k]] = ids
            elif keys[k].isalpha():
                letters[keys[k]] = None
                strange.append(k)
            else:
                ids, keep = new(keys[k])
                found[k] = ids
                if keep and len(keys[k]) <= WORD:
                    fresh[keys[k]] = ids
        for w, piece in zip(letters, _spelt([*letters]), strict=True):
            (fresh if len(w) <= WORD else once)[w] = array("I", [t.id for t in tokenize("Ġ" + piece)]).tobytes()
        for k in strange:
            w = keys[k]
            found[k] = fresh[w] if w in fresh else once[w]
        for k, tail in tails:
            found[k] += tail
        self.now.update(fresh)
        self.taken += sum(map(len, fresh)) + sum(map(len, fresh.values())) + _ENTRY * len(fresh)
        if self.taken > MEMORY:
            self.now, self.old, self.taken = {}, self.now, 0
        # A text holds under 2^31 bytes and an id takes one at least, so 32 bits hold every place.
        size = np.array([len(x) for x in found], dtype=np.int32) // 4
        start = np.cumsum(size, dtype=np.int32) - size
        each = size[codes]
        ends = np.cumsum(each, dtype=np.int32)
        place = np.repeat(start[codes] - (ends - each), each)
        place += np.arange(len(place), dtype=np.int32)
        ids = np.frombuffer(b"".join(found), dtype="<u4")[place]
        return ids, ends[np.cumsum(n_words) - 1].astype(np.int64)

    def batch(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """[(which rows, their ids in a row, their ends)] of non-null strings."""
        odd = pc.match_substring_regex(texts, _ODD if self.by_words else "")
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        odd = odd.to_numpy(zero_copy_only=False)
        out = []
        if not odd.all():
            some = np.flatnonzero(~odd)
            out.append((some, *self.texts(texts.take(pa.array(some)))))
        if odd.any():
            some = np.flatnonzero(odd)
            got = [self.whole(t) + self.end for t in texts.take(pa.array(some)).to_pylist()]
            out.append((some, np.frombuffer(b"".join(got), dtype="<u4"), np.cumsum([len(g) // 4 for g in got])))
        return out


_encoders: dict[tuple[str, int], Encoder] = {}


def _forget() -> bool:
    had = bool(_encoders)
    _encoders.clear()
    return had


CACHES.append(_forget)


def encoder(path: str, end_id: int = END_ID) -> Encoder:
    if (path, end_id) not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write_tokens(docs: DataFrame, path: str, tokenizer: Callable[[], str] = default_tokenizer, end_id: int = END_ID, place: str | None = None) -> None:
    """Writes the ids of docs (doc_id, text) under path, in ascending order of the long column `place`, by default of doc_id (null first; equal ones by number of ids, then by ids).

    A null or empty text has the end id only. An empty table gives no shard. tokenizer: gives the file's place, on each executor.
    """
    spark = docs.sparkSession
    bounded_batches(spark)

    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_file(tokenizer()).get_vocab_size(), end_id + 1) <= 1 << 16 else 4

    names = ["doc_id", "place", "ids", "counts"]

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(keep=_forget)
        enc, seen = encoder(tokenizer(), end_id), np.zeros(0, dtype="<i8")
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "").cast(pa.string())
            bytes_to = np.cumsum(pc.binary_length(texts).to_numpy())
            at = 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(bytes_to, (bytes_to[at - 1] if at else 0) + SLICE_BYTES, "right")))
                for which, ids, ends in enc.batch(texts.slice(at, to - at)):
                    c = np.bincount(ids)
                    seen, c = (seen, c) if len(seen) >= len(c) else (c, seen)
                    seen[: len(c)] += c
                    offsets = np.concatenate([[0], ends * width]).astype("<i4")
                    packed = pa.Array.from_buffers(pa.binary(), len(which), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype(f"<u{width}"))])
                    named = [batch.column(k).slice(at, to - at).take(pa.array(which)) for k in (0, 2)]
                    yield pa.RecordBatch.from_arrays([*named, packed, pa.nulls(len(which), pa.binary())], names)
                at = to
        if len(seen):  # a last row holds how often each id occurs in the partition
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([seen.astype("<i8").tobytes()], pa.binary())], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.lit(0) if place is None else F.col(place)).cast("long").alias("place"))
    held = stored(rows.mapInArrow(tidy(ids_of), "doc_id long, place long, ids binary, counts binary"), "token-ids")

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for raw in df["counts"]:
                seen = np.frombuffer(raw, dtype="<i8")
                at = np.flatnonzero(seen)
                yield pd.DataFrame({"id": at, "n": seen[at]})

    # As many rows as the vocabulary has ids.
    counts = held.where("counts is not null").select("counts").mapInPandas(tidy(tally), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas().sort_values(["n", "id"], ascending=[False, True])
    order = counts["id"].to_numpy(dtype=np.int64)
    spark.createDataFrame(pd.DataFrame({"rank": np.arange(len(order)), "id": order}), "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    rank = np.zeros(int(order.max()) + 1 if len(order) else 1, dtype="<u4")
    rank[order] = np.arange(len(order))
    sent = spark.sparkContext.broadcast(rank)

    rows = held.where("ids is not null").select("doc_id", "place", "ids")
    shards = partitions((rows.agg(F.sum(F.length("ids"))).first()[0] or 0) * 3 // 4, SHARD_BYTES)
    order_by = ["place" if place else "doc_id", F.length("ids"), F.xxhash64("ids")]

    def shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        ids: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def block() -> pd.DataFrame:
            counts = np.array([len(x) // width for x in held], dtype=np.int64)
            control, data = encode(sent.value[np.frombuffer(b"".join(held), dtype=f"<u{width}")], counts)
            return pd.DataFrame({"value": [write_block(ids, counts, control, data)]})

        for df in batches:
            for d, null, raw in zip(df["doc_id"].fillna(0).astype("int64"), df["doc_id"].isna(), df["ids"], strict=True):
                n = len(raw) // width
                if ids and size + n > BLOCK_IDS:
                    yield block()
                    ids, held, size = [], [], 0
                ids.append(None if null else int(d))
                held.append(raw)
                size += n
        if ids:
            yield block()

    # The ids are dealt and sorted as they are; the sampling of the ranges then runs no Python.
    ordered = rows.repartitionByRange(shards, *order_by).sortWithinPartitions(*order_by)
    ordered.mapInPandas(tidy(shard), "value binary").select(F.col("value").cast("string").alias("value")).write.text(f"{path}/shards", lineSep="\n")
    discard(held)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids, array<long>) of every document under path, from its files alone."""
    order = spark.read.parquet(f"{path}/ranks").orderBy("rank").toPandas()["id"].to_numpy(dtype="<u4")
    back = spark.sparkContext.broadcast(order)

    bounded_batches(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for df in batches:
            for name, raw in zip(df["path"], df["content"], strict=True):
                before = 0
                for index, ranks in read_blocks(raw):
                    ids = back.value[ranks]
                    ends = np.cumsum(index["n"]).astype(np.int64)
                    starts = ends - index["n"].astype(np.int64)
                    doc = pd.array(index["doc_id"].astype("int64"), dtype="Int64")
                    doc[index["null"].astype(bool)] = pd.NA
                    out = {"file": name.rsplit("/", 1)[-1], "doc_id": doc, "at": before + starts, "n_tokens": index["n"].astype("int64"), "ids_crc32": [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(starts, ends, strict=True)]}
                    yield pd.DataFrame(out | ({"ids": [ids[s:e].astype("int64") for s, e in zip(starts, ends, strict=True)]} if with_ids else {}))
                    before += len(ids)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/shards").select("path", "content")
    found = stored(files.mapInPandas(tidy(run), "file string, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids), "token-index")
    # Shards are named in the order of their ranges; one row a shard is summed here.
    totals = found.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    base = totals.select(F.col("file").alias("f"), (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("base"))
    out = found.join(F.broadcast(base) if totals.count() <= 100_000 else base, F.col("file") == F.col("f"))
    return out.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] * with_ids))


def tokens(docs: DataFrame, with_ids: bool = False, place: str | None = None) -> DataFrame:
    """docs through the files: write_tokens to a new folder of the shared one, and read_tokens from it."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, place=place)
    return read_tokens(docs.sparkSession, path, with_ids)


def op7_token_ids(spark, sf_dir: str) -> DataFrame:
    return tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
