"""Plain-Python versions of the corpus operators, for small tables. They share no code with the operators but constants."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import regex
import xxhash

from tidewatch.llm import langid, toxicity


def words(text):
    return [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]


def shingle_set(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def groups(nodes, links):
    """The least node that each can reach."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


# --- language ID ---

def grams(text):
    """Buckets of all n-grams, one character after the other."""
    folded = []
    for ch in text:
        low = ch.lower() if ord(ch) < 1 << 16 else ch
        folded.append(ord(low if len(low) == 1 else ch) if ch.isalpha() else 32)
    run = [32]
    for c in [*folded, 32]:
        if c != 32 or run[-1] != 32:
            run.append(c)
    out = []
    for n in langid.ORDERS:
        for i in range(len(run) - n + 1):
            h = 0
            for c in run[i : i + n]:
                h = (h * 0x100000001B3 + c + 1) % (1 << 64)
            out.append((((h ^ (h >> 29)) * 0x9E3779B97F4A7C15) % (1 << 64)) >> (64 - langid.BITS))
    return out if len(run) > 1 else []


class Bayes:
    def __init__(self, rows, alpha=0.1):
        self.docs = Counter(lang for text, lang in rows if text is not None and lang is not None)
        self.seen = defaultdict(Counter)
        for text, lang in rows:
            if text is not None and lang is not None:
                self.seen[lang].update(grams(text))
        self.alpha = alpha

    def logp(self, lang, bucket):
        return math.log((self.seen[lang][bucket] + self.alpha) / (sum(self.seen[lang].values()) + self.alpha * (1 << langid.BITS)))

    def predict(self, text):
        """(language, posterior, fit)."""
        g = Counter(grams(text or ""))
        if not g or not self.docs:
            return "und", 0.0, 0.0
        score, bare = {}, {}
        for lang, n in sorted(self.docs.items()):
            total = sum(self.seen[lang].values()) + self.alpha * (1 << langid.BITS)
            bare[lang] = sum(k * math.log((self.seen[lang][b] + self.alpha) / total) for b, k in g.items())
            score[lang] = bare[lang] + math.log(n / sum(self.docs.values()))
        top = max(score, key=lambda k: score[k])
        post = 1 / sum(math.exp(s - score[top]) for s in score.values())
        return top, post, bare[top] / sum(g.values()) + langid.BITS * math.log(2)


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


# --- decontamination ---

def similarity(a, b):
    x, y = Counter(a), Counter(b)
    both = sum((x & y).values())
    return both / (len(a) + len(b) - both)


def leaks(docs, items, least=0.8):
    """{(doc_id, item_id): similarity of the best window}, over every window of every document."""
    out = {}
    for item_id, text in items:
        w = words(text)
        if not w:
            continue
        k = min(5, len(w))
        want = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
        for doc_id, body in docs:
            v = words(body)
            have = [tuple(v[i : i + k]) for i in range(len(v) - k + 1)]
            if not set(have) & set(want):
                continue
            best = max(similarity(have[s : s + len(want)], want) for s in range(max(1, len(have) - len(want) + 1)))
            if best >= least:
                out[doc_id, item_id] = max(best, out.get((doc_id, item_id), 0))
    return out


# --- mixing ---

def poisson_copies(rows, seed=1234, alpha=0.5):
    """rows (doc_id, source) -> how often each comes out."""
    n = Counter(s for _, s in rows)
    total = sum(k**alpha for k in n.values())
    out = Counter()
    for doc_id, source in rows:
        rate = n[source] ** alpha * len(rows) / (total * n[source])
        steps = max(1, math.ceil(rate / 16))
        for i in range(1, steps + 1):
            u = int(hashlib.md5(f"{seed}|{doc_id}|{i}".encode()).hexdigest()[:13], 16) / 2**52
            k, p = 0, math.exp(-rate / steps)
            run = p
            while run <= u and k < 80:
                k += 1
                p *= rate / steps / k
                run += p
            out[doc_id] += k
    return out


# --- toxicity ---

def signed_xxh64(text):
    h = xxhash.xxh64(text.encode(), seed=42).intdigest()
    return h - (1 << 64) if h >= 1 << 63 else h


def newton(x, y, times, l2=1.0):
    """Logistic regression with a free intercept, by Newton's method in the space of the rows: weights are sums of rows."""
    p = (times @ y + 0.5) / (times.sum() + 1)
    a, b, gram, n = np.zeros(len(x)), math.log(p / (1 - p)), x @ x.T, len(x)
    if y.min() == y.max():
        return np.r_[np.zeros(x.shape[1]), b]
    for _ in range(60):
        f = np.clip(gram @ a + b, -30, 30)
        q = 1 / (1 + np.exp(-f))
        h = times * q * (1 - q)
        left = np.block([[h[:, None] * gram + l2 * np.eye(n), h[:, None]], [np.ones((1, n)), np.zeros((1, 1))]])
        new = np.linalg.solve(left, np.r_[h * f + times * (y - q), 0.0])
        moved = abs(new[:-1] - a).max()
        a, b = new[:-1], new[-1]
        if moved < 1e-10:
            break
    return np.r_[x.T @ a, b]


def g_squared(x, y, times):
    n, p = times.sum(), times @ y
    out = []
    for col in x.T:
        a, b = (times * y) @ col, (times * (1 - y)) @ col
        cells = ((a, (a + b) * p / n), (b, (a + b) * (n - p) / n), (p - a, (n - a - b) * p / n), (n - p - b, (n - a - b) * (n - p) / n))
        out.append(sum(2 * s * math.log(s / e) for s, e in cells if s > 0))
    return np.array(out)


def toxicity_chain(labelled, texts, names=("quality", "toxic"), positive=(0, 1)):
    """labelled (text, quality, toxic) -> (scores of texts, cuts): the chain with dense matrices, folds by the hash of the text, and Newton's method."""
    grouped = Counter((t, *[int(v == w) for v, w in zip(m, positive)]) for t, *m in labelled)
    rows = sorted(grouped, key=lambda r: (signed_xxh64(r[0]), r[1:]))
    times = np.array([grouped[r] for r in rows], dtype=float)
    bucket = lambda t: {signed_xxh64(w) % (1 << toxicity.BITS) for w in set(words(t))}
    have = [bucket(r[0]) for r in rows]
    df = Counter()
    for h, k in zip(have, times):
        for b in h:
            df[b] += k
    least = min(toxicity.MIN_DOCS, max(1, int(times.sum()) // 50))
    cols = sorted(b for b in df if df[b] >= least)
    dense = lambda sets: np.array([[b in s for b in cols] for s in sets], dtype=float).reshape(len(sets), len(cols))
    x, new = dense(have), dense([bucket(t) for t in texts])
    fold = np.array([(signed_xxh64(r[0]) & 0xFFFF) % toxicity.FOLDS for r in rows])
    past, past_new, cuts = np.zeros((len(rows), 0)), np.zeros((len(texts), 0)), []
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def fit(keep, y, g2):
        some = g_squared(x[keep], y[keep], times[keep]) >= g2 - 1e-9
        w = newton(np.column_stack([x[keep][:, some], past[keep]]), y[keep], times[keep])
        return lambda a, b: sigmoid(np.column_stack([a[:, some], b, np.ones(len(a))]) @ w)

    for k in range(len(names)):
        y = np.array([r[1 + k] for r in rows], dtype=float)
        best = None
        for g2 in toxicity.LEAST_G2:
            oof = np.zeros(len(rows))
            for f in range(toxicity.FOLDS):
                if (fold == f).any() and (fold != f).any():
                    oof[fold == f] = fit(fold != f, y, g2)(x[fold == f], past[fold == f])
            order = sorted(set(oof), reverse=True)
            f1s = [2 * (times @ (y * (oof >= c))) / (times @ (oof >= c) + times @ y) for c in order]
            at = int(np.argmax(f1s)) if y.any() else None
            cut = 0.5 if at is None else (order[at] + (order[at + 1] if at + 1 < len(order) else 0.0)) / 2
            f1 = 2 * (times @ (y * (oof >= cut))) / max(1.0, times @ (oof >= cut) + times @ y)
            if best is None or f1 > best[0] + 1e-12:
                best = f1, cut, oof, g2
        _, cut, oof, g2 = best
        score = fit(np.ones(len(rows), dtype=bool), y, g2)(new, past_new)
        past, past_new = np.column_stack([past, oof]), np.column_stack([past_new, score])
        cuts.append(cut)
    return past_new, cuts

