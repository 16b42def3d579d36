"""Toxicity by a classifier chain over hashed words.

The labels table has two categories, low quality and toxic. The chain predicts them in the order of CHAIN: each model is a
logistic regression on words of the text and on the probabilities of the categories before it. In training those come
from models that did not see the row (out of fold); in prediction from the models fitted on all rows. A model learns from the
words that go with its category by a likelihood-ratio test on its own training rows, or from all words: what does better out of fold.
Where few words tell, as for toxicity, the many rare words of long documents would outweigh them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import small_side, words

#: Columns of the labels table in the order of the chain, with the value that counts as positive.
CHAIN = (("quality", 0), ("toxic", 1))
BITS = 18
FOLDS = 5
#: Training: about this many different labelled texts at most, chosen by their hash; of each the distinct words.
TRAIN_DOCS = 6000
#: Only words in this many training documents at least are learned.
MIN_DOCS = 4
#: Least log-likelihood ratios (G squared, one degree of freedom) of a word to be learned, tried in turn: 15.1 is chance once in 10,000.
LEAST_G2 = (15.1, 0.0)
L2 = 1.0


def features(text):
    """Sorted array<int> of the buckets of the distinct words."""
    return F.array_sort(F.array_distinct(F.transform(F.array_distinct(words(text)), lambda w: F.pmod(F.xxhash64(w), F.lit(1 << BITS)).cast("int"))))


class Sparse:
    """Rows of ones at some columns, plus dense extra columns."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, n: int, d: int, extra: np.ndarray):
        self.rows, self.cols, self.n, self.d, self.extra = rows, cols, n, d, extra

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights=w[self.cols], minlength=self.n) + self.extra @ w[self.d :]

    def t_dot(self, r: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.cols, weights=r[self.rows], minlength=self.d), self.extra.T @ r])

    def counts(self, weight: np.ndarray) -> np.ndarray:
        """By column, the summed weight of the rows that have it."""
        return np.bincount(self.cols, weights=weight[self.rows], minlength=self.d)

    def pick(self, keep: np.ndarray) -> Sparse:
        place = np.cumsum(keep) - 1
        m = keep[self.rows]
        return Sparse(place[self.rows[m]], self.cols[m], int(keep.sum()), self.d, self.extra[keep])

    def only(self, cols: np.ndarray) -> Sparse:
        """The columns of a mask, renumbered; all extra columns."""
        m = cols[self.cols]
        return Sparse(self.rows[m], (np.cumsum(cols) - 1)[self.cols[m]], self.n, int(cols.sum()), self.extra)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: Sparse, y: np.ndarray, times: np.ndarray | None = None, l2: float = L2, rounds: int = 40, memory: int = 8) -> tuple[np.ndarray, float]:
    """Weights and intercept by L-BFGS, each row counted `times`. One class only: a constant."""
    times = np.ones(len(y)) if times is None else times
    p = (times @ y + 0.5) / (times.sum() + 1.0)
    w = np.zeros(x.d + x.extra.shape[1] + 1)
    w[-1] = np.log(p / (1 - p))
    if y.min() == y.max():
        return w[:-1], w[-1]

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = x.dot(w[:-1]) + w[-1]
        value = times @ (np.logaddexp(0, z) - y * z) + 0.5 * l2 * (w[:-1] ** 2).sum()
        r = times * (sigmoid(z) - y)
        g = np.append(x.t_dot(r), r.sum())
        g[:-1] += l2 * w[:-1]
        return value, g

    value, g = loss(w)
    s_list: list[np.ndarray] = []
    y_list: list[np.ndarray] = []
    for _ in range(rounds):
        q, alphas = g.copy(), []
        for s, t in zip(reversed(s_list), reversed(y_list), strict=True):
            a = (s @ q) / (t @ s)
            alphas.append(a)
            q -= a * t
        q *= (s_list[-1] @ y_list[-1]) / (y_list[-1] @ y_list[-1]) if s_list else 1.0 / max(1.0, np.abs(g).max())
        for s, t, a in zip(s_list, y_list, reversed(alphas), strict=True):
            q += (a - (t @ q) / (t @ s)) * s
        step, slope = 1.0, -(g @ q)
        while True:
            new = w - step * q
            value2, g2 = loss(new)
            if value2 <= value + 1e-4 * step * slope or step < 1e-6:
                break
            step /= 2
        if (new - w) @ (g2 - g) > 1e-10:
            s_list, y_list = [*s_list, new - w][-memory:], [*y_list, g2 - g][-memory:]
        done = abs(value - value2) < 1e-6 * max(1.0, abs(value))
        w, g, value = new, g2, value2
        if done:
            break
    return w[:-1], w[-1]


def telling(x: Sparse, y: np.ndarray, least: float, times: np.ndarray | None = None) -> np.ndarray:
    """Mask of the columns whose G squared against y is `least` or more, each row counted `times`."""
    times = np.ones(len(y)) if times is None else times
    n, p = float(times.sum()), float(times @ y)
    df, hit = x.counts(times), x.counts(times * y)
    total = np.zeros(x.d)
    for seen, expected in ((hit, df * p / n), (df - hit, df * (n - p) / n), (p - hit, (n - df) * p / n), (n - p - df + hit, (n - df) * (n - p) / n)):
        some = seen > 0
        total[some] += 2 * seen[some] * np.log(seen[some] / expected[some])
    return total >= least - 1e-9


def fit_words(x: Sparse, y: np.ndarray, least: float, times: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """logistic() on the telling columns; the weights of the others are 0."""
    cols = telling(x, y, least, times)
    w, b = logistic(x.only(cols), y, times)
    full = np.zeros(x.d + x.extra.shape[1])
    full[: x.d][cols] = w[: int(cols.sum())]
    full[x.d :] = w[int(cols.sum()) :]
    return full, b


@dataclass
class Chain:
    names: list[str]
    weights: list[np.ndarray]  # by category: 2^BITS word weights, then one for each category before
    bias: list[float]
    cut: list[float]

    def predict(self, rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, len(self.names)))
        for k, (w, b) in enumerate(zip(self.weights, self.bias, strict=True)):
            out[:, k] = sigmoid(Sparse(rows, cols, n, 1 << BITS, out[:, :k]).dot(w) + b)
        return out


def best_cut(p: np.ndarray, y: np.ndarray, times: np.ndarray) -> float:
    """The threshold of the best F1 on out-of-fold probabilities, halfway to the next lower one; 0.5 without positives."""
    if not y.any():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum((times * y)[order])
    f1 = 2 * hit / (np.cumsum(times[order]) + times @ y)
    ends = np.r_[p[order][1:] != p[order][:-1], True]
    at = int(np.argmax(np.where(ends, f1, -1)))
    below = p[order][at + 1] if at + 1 < len(p) else 0.0
    return float((p[order][at] + below) / 2)


def fit(labelled: DataFrame, chain: tuple[tuple[str, int], ...] = CHAIN, cap: int = TRAIN_DOCS) -> tuple[Chain, dict[str, float]]:
    """labelled (text and a column for each category) -> chain, and the out-of-fold F1 of each category.

    Rows with a null text or category teach nothing. Equal texts with equal labels are one training row that counts as often as it occurs, so the driver gets
    about `cap` rows whatever repeats. No rows: a chain that answers 0 everywhere.
    """
    marks = [(F.col(c) == v).cast("int").alias(c) for c, v in chain]
    rows = labelled.dropna(subset=["text", *[c for c, _ in chain]]).select(F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text"), *marks)
    n = rows.select("h").distinct().count()
    u = F.pmod(F.col("h"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = rows.where(u < min(1.0, cap / max(1, n))).groupBy("h", *[c for c, _ in chain]).agg(F.min("text").alias("text"), F.count(F.lit(1)).alias("times"))
    some = some.select("h", features(F.col("text")).alias("f"), "times", *[c for c, _ in chain])
    got = some.toPandas().sort_values(["h", *[c for c, _ in chain]], kind="stable").reset_index(drop=True)
    names = [c for c, _ in chain]
    if got.empty:
        return Chain(names, [np.zeros((1 << BITS) + k) for k in range(len(chain))], [-40.0] * len(chain), [0.5] * len(chain)), {}
    sizes = got["f"].map(len).to_numpy()
    row, col = np.repeat(np.arange(len(got)), sizes), np.concatenate([np.asarray(f, dtype=np.int64) for f in got["f"]] or [np.zeros(0, dtype=np.int64)]).astype(np.int64)
    times = got["times"].to_numpy(dtype=float)
    common = np.bincount(col, weights=times[row], minlength=1 << BITS) >= min(MIN_DOCS, max(1, int(times.sum()) // 50))
    short = np.cumsum(common) - 1  # the learned words, renumbered
    keep = common[col]
    d = int(common.sum())
    # Equal texts share a fold, so that no copy of a row is in the models that judge it.
    fold = (got["h"].to_numpy() & 0xFFFF) % FOLDS
    past = np.zeros((len(got), 0))
    out, report = Chain(names, [], [], []), {}
    for name in names:
        y = got[name].to_numpy(dtype=float)
        x = Sparse(row[keep], short[col[keep]], len(got), d, past)
        best = None
        for least in LEAST_G2:
            oof = np.zeros(len(got))
            for f in range(FOLDS):
                rest = fold != f
                if rest.any() and not rest.all():
                    w, b = fit_words(x.pick(rest), y[rest], least, times[rest])
                    oof[~rest] = sigmoid(x.dot(w) + b)[~rest]
            cut = best_cut(oof, y, times)
            said = oof >= cut
            f1 = float(2 * (times @ (said & (y > 0))) / max(1.0, times @ said + times @ y))
            if best is None or f1 > best[0]:
                best = f1, cut, oof, least
        report[name], cut, oof, least = best
        w, b = fit_words(x, y, least, times)
        full = np.zeros((1 << BITS) + past.shape[1])
        full[np.flatnonzero(common)] = w[:d]
        full[1 << BITS :] = w[d:]
        out.weights.append(full)
        out.bias.append(float(b))
        out.cut.append(cut)
        past = np.column_stack([past, oof])
    return out, report


def predict(docs: DataFrame, model: Chain) -> DataFrame:
    """docs (text) + __tw_scores (array<double>, one a category). The model (2^BITS doubles a category) is broadcast.

    Null and empty texts hold no word: they get what the intercepts say, and are never flagged by flag().
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for f in batches:
            sizes = f.map(len).to_numpy()
            cols = np.concatenate([*f, np.zeros(0, dtype=np.int64)]).astype(np.int64)
            yield pd.Series(list(held.value.predict(np.repeat(np.arange(len(f)), sizes), cols, len(f))))

    return docs.withColumn("__tw_scores", score(features(F.col("text"))))


def classify(docs: DataFrame, labels: DataFrame, chain: tuple[tuple[str, int], ...] = CHAIN) -> DataFrame:
    """docs (doc_id, text) with labels (doc_id and the categories) -> docs + __tw_scores, __tw_flags (array<boolean>).

    Labels of a doc_id that repeats teach once each. Labels without a document, and with a null doc_id, teach nothing. Repeated rows, and texts with the
    same words, get the same scores; a score equal to its category's cut is flagged. Null, empty and wordless texts are scored by the intercepts and never flagged.
    Very long texts are read whole. An empty table gives none; without labels nothing is flagged. Other columns stay; their names may not start with __tw_.
    """
    marks = labels.where("doc_id is not null").select(F.col("doc_id").alias("__tw_id"), *[F.col(c).alias(c) for c, _ in chain])
    texts = docs.select(F.col("doc_id").alias("__tw_doc"), F.col("text").alias("text")).join(small_side(marks), F.col("__tw_doc") == F.col("__tw_id"))
    model, _ = fit(texts.select("text", *[c for c, _ in chain]), chain)
    scored = predict(docs, model)
    some = F.size(words(F.col("text"))) > 0
    return scored.withColumn("__tw_flags", F.array(*[some & (F.get("__tw_scores", k) >= c) for k, c in enumerate(model.cut)]))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    last = len(CHAIN) - 1
    return out.select("doc_id", F.get("__tw_flags", last).alias("toxic"), F.get("__tw_scores", last).alias("toxic_score"), F.get("__tw_flags", 0).alias("low_quality"), F.get("__tw_scores", 0).alias("low_quality_score"))
