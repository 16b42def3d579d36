"""Language ID: multinomial naive Bayes over hashed character n-grams, scored in sparse batches in numpy.

The log-probability matrix is broadcast. Every language of the training rows is learned; beyond AT_ONCE of them, they are counted and scored in
turns of AT_ONCE, each turn with a matrix of its own, and the best language and the sum of all posteriors are carried from turn to turn.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import bounded_batches, release, stored, tidy

#: n-gram lengths and the number of buckets they are hashed to.
ORDERS = (1, 2, 3)
BITS = 16
#: Training: about this many documents of a language at most, chosen by the hash of their text. Scoring covers whole texts.
TRAIN_DOCS = 3000
#: Languages of a turn; each needs 2^BITS doubles in the broadcast matrix.
AT_ONCE = 200
#: A column with more values than this holds no languages; training on it is refused.
MOST_LANGS = 20_000
#: Characters scored at a time, fewer if there are over eight languages; longer texts go in slices that overlap, so no n-gram is lost.
SLICE = 1 << 18


def grams(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Bucket of every n-gram, one array an order, by start; codes are code points, one space between words."""
    c = codes.astype(np.uint64)
    h = np.zeros(len(c), dtype=np.uint64)
    for k in range(max(ORDERS)):
        if len(c) <= k:
            return
        h = h[: len(c) - k] * np.uint64(0x100000001B3) + c[k:] + np.uint64(1)
        if k + 1 in ORDERS:
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            yield (mixed >> np.uint64(64 - BITS)).astype(np.int64)


#: Of each code point below 2^16: itself in lower case if it is a letter, else a space. Others are looked up one by one.
_FOLD: list[np.ndarray] = []


def fold(text: str) -> np.ndarray:
    """Code points of the text in lower case, each run of anything but letters as one space, with a space at both ends."""
    if not _FOLD:
        table = np.full(1 << 16, 32, dtype=np.uint32)
        for i in range(1 << 16):
            ch = chr(i)
            if ch.isalpha():
                low = ch.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _FOLD.append(table)
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    high = raw >= 1 << 16
    out = _FOLD[0][np.where(high, 0, raw)]
    if high.any():
        out[high] = [ord(c) if (c := chr(x)).isalpha() else 32 for x in raw[high]]
    out = np.concatenate([[32], out, [32]]).astype(np.uint32)
    return out[np.r_[True, (out[1:] != 32) | (out[:-1] != 32)]]


def sliced(codes: np.ndarray, most: int = SLICE) -> Iterator[np.ndarray]:
    """grams() of codes of any length, in slices that overlap: each n-gram is in one of them."""
    for s in range(0, len(codes), most):
        for g in grams(codes[s : s + most + max(ORDERS) - 1]):
            yield g[: most if s + most < len(codes) else None]


@dataclass
class Model:
    langs: list[str]
    prior: np.ndarray  # log, by language
    logp: np.ndarray  # log, bucket x language

    def parts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log-probabilities by text and language, prior included; n-grams of each text; whether it is null or holds no letter)."""
        total, bare, size_of = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), dtype=bool), np.zeros(len(texts))
        most = max(1 << 12, SLICE * 8 // max(8, len(self.langs)))
        held: list[np.ndarray] = []
        at = size = 0
        for i, t in enumerate(texts):
            f = fold(t) if t else np.array([32], dtype=np.uint32)
            bare[i] = len(f) <= 1
            size_of[i] = sum(max(0, len(f) - n + 1) for n in ORDERS)
            if held and size + len(f) > most:
                self._add(held, total[at:i], most)
                held, at, size = [], i, 0
            held.append(f)
            size += len(f)
        if held:
            self._add(held, total[at:], most)
        return total + self.prior, size_of, bare

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and its posterior; of equal ones the first by name. Texts that are null or hold no letter, and all texts of an empty model: ("und", 0)."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        total, _, bare = self.parts(texts)
        top = total.argmax(1)
        post = 1.0 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        return ["und" if b else self.langs[i] for b, i in zip(bare, top, strict=True)], np.where(bare, 0.0, np.clip(post, 0.0, 1.0))

    def _add(self, folded: list[np.ndarray], out: np.ndarray, most: int) -> None:
        """Adds the log-probabilities of the texts to their rows of out: several at once, or one of any length in slices."""
        if len(folded) > 1 or len(folded[0]) <= most:
            return self._batch(folded, out)
        for g in sliced(folded[0], most):
            out[0] += self.logp[g].sum(0)

    def _batch(self, folded: list[np.ndarray], out: np.ndarray) -> None:
        """Rows of a sparse count matrix times logp: the buckets of all documents in a row, cut at their ends."""
        codes = np.concatenate(folded)
        ends = np.cumsum([len(f) for f in folded])
        starts = ends - [len(f) for f in folded]
        for n, g in zip(ORDERS, grams(codes), strict=False):
            run = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(self.logp[g], axis=0)])
            first = np.minimum(starts, len(g))
            last = np.maximum(first, np.minimum(ends - n + 1, len(g)))  # n-grams that cross into the next document are left out
            out += run[last] - run[first]


def chosen(rows: DataFrame, n: dict[str, int], per_lang: int):
    """Whether a row is in the training sample: the hash of its text against the share of its language."""
    share = F.create_map(*[F.lit(x) for k in n for x in (k, float(min(1.0, per_lang / n[k])))])
    u = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.where(F.col("lang").isin(list(n))).where(u < F.element_at(share, F.col("lang")))


def train(labelled: DataFrame, alpha: float = 0.1, per_lang: int = TRAIN_DOCS, at_once: int = AT_ONCE) -> list[Model]:
    """labelled (text, lang) -> models, one for each turn of languages in the order of their names. Rows with a null text or lang, or no letter, teach nothing.

    The prior of a language is its share of the rows with text and lang. An empty table gives no model.
    """
    bounded_batches(labelled.sparkSession)
    rows = labelled.where("text is not null and lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    n = dict(rows.groupBy("lang").count().limit(MOST_LANGS + 1).collect())
    if len(n) > MOST_LANGS:
        raise ValueError(f"lang has over {MOST_LANGS} values")
    every = float(sum(n.values()))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        seen: dict[str, np.ndarray] = {}
        for df in batches:
            for text, lang in zip(df["text"], df["lang"], strict=True):
                if len(f := fold(text)) > 1:
                    row = seen.setdefault(lang, np.zeros(1 << BITS, dtype=np.int64))
                    for g in sliced(f):
                        row += np.bincount(g, minlength=1 << BITS)
        for lang, row in seen.items():
            b = np.flatnonzero(row)
            yield pd.DataFrame({"lang": lang, "bucket": b.astype("int32"), "n": row[b]})

    out, names = [], sorted(n)
    for at in range(0, len(names), at_once):
        langs = names[at : at + at_once]
        some = chosen(rows, {k: n[k] for k in langs}, per_lang)
        found = some.mapInPandas(tidy(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
        counts = np.full((1 << BITS, len(langs)), alpha)
        np.add.at(counts, (found["bucket"].to_numpy(dtype=np.int64), found["lang"].map({k: i for i, k in enumerate(langs)}).to_numpy(dtype=np.int64)), found["n"].to_numpy(dtype=np.float64))
        out.append(Model(langs, np.log(np.array([n[k] for k in langs]) / every), np.log(counts / counts.sum(0))))
    return out


def predict(docs: DataFrame, models: list[Model]) -> DataFrame:
    """docs + __tw_lang, __tw_score, __tw_fit. Only text is read. A model (2^BITS x AT_ONCE doubles at most) is broadcast at a time.

    __tw_lang: the most probable language, of equal ones the first by name; "und" if the text is null or has no letter, or nothing was learned.
    __tw_score: its posterior among the learned languages, 0 for "und". __tw_fit: by how much its n-grams are likelier, on average, than if all
    buckets were equally frequent (natural logarithm); under 0 the language explains the text worse than none would.
    """
    bounded_batches(docs.sparkSession)
    if not models:
        return docs.withColumns({"__tw_lang": F.lit("und"), "__tw_score": F.lit(0.0), "__tw_fit": F.lit(0.0)})
    kind = "lang string, best double, every double, fit double"
    out = docs.withColumn("__tw_p", F.lit(None).cast(f"struct<{kind.replace(' ', ':').replace(',:', ',')}>"))
    for k, model in enumerate(models):
        score = _scorer(docs.sparkSession.sparkContext.broadcast(model), kind)
        out = out.withColumn("__tw_p", score(F.col("text").cast("string"), F.col("__tw_p")))
        if k + 1 < len(models):
            out = stored(out, "languages")  # so that a worker holds one matrix at a time
    p, known = F.col("__tw_p"), F.col("__tw_p.lang") != "und"
    posterior = F.when(known, F.least(F.lit(1.0), F.exp(p["best"] - p["every"]))).otherwise(0.0)
    return out.withColumns({"__tw_lang": p["lang"], "__tw_score": posterior, "__tw_fit": p["fit"]}).drop("__tw_p")


def _scorer(held, kind: str):
    @F.pandas_udf(kind)
    @tidy
    def score(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        release()
        for text, was in batches:
            yield turn(held.value, [None if t is None or t != t else t for t in text], was)

    return score


def turn(model: Model, texts: list[str | None], was: pd.DataFrame) -> pd.DataFrame:
    """Best language so far with its log-probability, the logarithm of the sum over all languages so far, and the fit of the best."""
    total, n, bare = model.parts(texts)
    top = total.argmax(1)
    best = total.max(1)
    every = best + np.log(np.exp(total - best[:, None]).sum(1))
    fit = (best - model.prior[top]) / np.maximum(n, 1) + BITS * np.log(2)
    lang = np.array(model.langs, dtype=object)[top]
    if len(was) and was["lang"].notna().any():
        # Turns go by name, so of equal languages the earlier stays.
        old = was["best"].to_numpy(dtype=np.float64)
        every = np.logaddexp(every, was["every"].to_numpy(dtype=np.float64))
        keep = old >= best
        best, fit, lang = np.where(keep, old, best), np.where(keep, was["fit"], fit), np.where(keep, was["lang"], lang)
    return pd.DataFrame({"lang": np.where(bare, "und", lang), "best": best, "every": every, "fit": np.where(bare, 0.0, fit)})


def held_out():
    return F.coalesce(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang and any more columns) + __tw_held_out, __tw_lang, __tw_score, __tw_fit; learns only from rows that are not held out.

    A null doc_id counts as an empty one. lang, source and doc_id are never read in prediction, so repeated rows get the same answer, and rows that
    tie between languages the first by name. Very long texts are counted and scored whole, in slices that overlap. An empty table gives none; one
    without a language "und" throughout. Other columns stay as they are; their names may not start with __tw_.
    """
    models = train(docs.where(~held_out()).select("text", "lang"))
    return predict(docs.withColumn("__tw_held_out", held_out()), models)


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    out = identify(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
    return out.select("doc_id", F.col("__tw_held_out").alias("held_out"), F.col("__tw_lang").alias("lang_pred"), F.col("__tw_score").alias("score"))
