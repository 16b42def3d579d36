"""N-gram Jaccard join: MinHash banding for candidates, full n-gram sets to verify.

1. Each text gets a MinHash signature of its set of word 5-grams, cut into bands; texts of one set are one node.
2. Nodes that share a band hash are candidates. They are not listed: each joins the least node of its bucket, and the connected
   components of that hold every candidate pair.
3. A component is cut into blocks, bounded in sets and bytes; a task gets two blocks with their full sets, compares those pairs that share a band,
   and returns counts of links and edges that span each group, never the pairs.
4. The components of those edges are the classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import bounded_batches, partitions, release, small_side, stored, tidy, trim, words
from tidewatch.operators.components import components

SIZE = 5
#: Nodes of a block, and bytes of their sets, on average; a task gets two blocks. A larger set is a block of its own.
BLOCK, BLOCK_BYTES = 512, 48 << 20
_M64 = (1 << 64) - 1


def bands_for(threshold: float, recall: float, most: int = 256) -> tuple[int, int]:
    """(bands, rows): the most rows, hence the fewest false candidates, that reach the recall at the threshold within `most` hashes."""
    for rows in range(most, 0, -1):
        p = threshold**rows
        need = math.ceil(math.log(1 - recall) / math.log1p(-p)) if p < 1 else 1
        if need * rows <= most:
            return need, rows
    raise ValueError("no banding reaches this recall")


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(w: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of word hashes; a text of fewer words, but some, is one n-gram of all of them."""
    w = w.view(np.uint64)
    if not len(w):
        return w
    k = min(size, len(w))
    h = np.full(len(w) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - k + 1 + i])
    return np.unique(h)


class Signer:
    def __init__(self, bands: int, rows: int) -> None:
        rng = np.random.default_rng(20240607)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)

    def __call__(self, s: np.ndarray) -> np.ndarray:
        """A hash for each band of a set, int64."""
        x = (s >> np.uint64(32)).astype(np.uint32) ^ s.astype(np.uint32)
        low = np.full(len(self.a), np.uint32(0xFFFFFFFF))
        step = max(1, (1 << 18) // len(self.a))
        for at in range(0, len(x), step):
            low = np.minimum(low, (self.a[:, None] * x[None, at : at + step] + self.b[:, None]).min(1))
        h = np.arange(1, self.bands + 1, dtype=np.uint64)
        for r in low.reshape(self.bands, self.rows).T:
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + r)
        return h.view(np.int64)


def _word_hashes(text):
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _arrays(column: pd.Series) -> Iterator[np.ndarray]:
    for x in column:
        yield np.asarray(x, dtype=np.int64)


def set_key(s: np.ndarray) -> bytes:
    """128 bits of a set."""
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def links_and_classes(docs: DataFrame, threshold: float = 0.8, recall: float = 0.9995, size: int = SIZE) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_links, class_id, n_copies; one row per row of docs.

    Two documents link if the Jaccard similarity of their sets of word n-grams is at or above the threshold (a text of fewer than n words is
    one n-gram; texts without words, null and empty ones among them, link with nothing). n_links: the other rows a row links with;
    n_copies: the rows with the very same set, itself included; class_id: the least doc_id reachable by links. Rows with a null doc_id
    link with nothing and have a null class_id. A pair at the threshold is a candidate with the given recall, and one above with more. Very long texts are compared whole;
    an empty table gives none; other columns of docs are not read, whatever their names.
    """
    bands, rows = bands_for(threshold, recall)
    bounded_batches(docs.sparkSession)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        signer = Signer(bands, rows)
        for df in batches:
            out = []
            for w in _arrays(df["w"]):
                s = shingles(w, size)
                out.append((set_key(s), signer(s).tobytes(), len(s)) if len(s) else (None, None, 0))
            yield pd.DataFrame({"doc_id": df["doc_id"].astype("Int64"), "key": [k for k, _, _ in out], "bands": [b for _, b, _ in out], "size": [n for _, _, n in out]})

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stored(base.select("doc_id", _word_hashes(F.col("text")).alias("w")).mapInPandas(tidy(sign), "doc_id long, key binary, bands binary, size long"), "signatures")
    usable = signed.where("key is not null and doc_id is not null")
    # A node is a set; its id is the least doc_id with it. Ids stay apart unless a doc_id repeats with other texts: those are one node for classes, and count as rows.
    nodes = stored(usable.groupBy("key").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.min("bands").alias("bands"), F.min("size").alias("n_grams")), "sets")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            h = np.frombuffer(b"".join(df["bands"]), dtype=np.int64).reshape(len(df), -1) if len(df) else np.zeros((0, bands), dtype=np.int64)
            yield pd.DataFrame({"id": df["id"].to_numpy().repeat(bands), "h": h.reshape(-1)})

    members = nodes.select("id", "bands").mapInPandas(tidy(unpack), "id long, h long")
    least = members.groupBy("h").agg(F.min("id").alias("m"), F.max("id").alias("x")).where("m < x").select(F.col("h").alias("g"), "m")
    near = members.join(least, F.col("h") == F.col("g")).where("id <> m").select(F.col("id").alias("a"), F.col("m").alias("b")).distinct()
    groups = stored(components(near, "candidates"), "candidate-groups")

    found = _verify(base, nodes, groups, threshold, size, bands)
    counts = found.where("b is null").groupBy(F.col("key").alias("k")).agg(F.sum("n").alias("others"))
    # Rows of one doc_id with several sets are one node in the classes.
    same = usable.join(nodes.select(F.col("key").alias("k"), "id"), F.col("key") == F.col("k")).where("doc_id <> id")
    edges = found.where("b is not null").select("a", "b").unionAll(same.select(F.col("doc_id").alias("a"), F.col("id").alias("b")))
    classes = stored(components(edges, "classes"), "classes")
    per = nodes.select(F.col("key").alias("k2"), "copies").join(counts, F.col("k2") == F.col("k"), "left").select("k2", "copies", F.coalesce("others", F.lit(0)).alias("others"))
    out = signed.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key")).join(per, F.col("key") == F.col("k2"), "left")
    out = out.join(classes, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", F.coalesce(F.col("others") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "doc_id").alias("class_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"))


def _verify(base: DataFrame, nodes: DataFrame, groups: DataFrame, threshold: float, size: int, bands: int) -> DataFrame:
    """(key, a, b, n): edges (a, b) spanning every group of links, and for each set with links the rows it links with (b null)."""
    joined = nodes.join(groups, F.col("id") == F.col("node")).select("key", "id", "copies", "bands", "n_grams", F.col("component").alias("g"))
    sizes = joined.groupBy(F.col("g").alias("c")).agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)), F.ceil(F.sum("n_grams") * 8 / F.lit(BLOCK_BYTES))).cast("int").alias("cut"))
    wanted = stored(joined.join(sizes, F.col("g") == F.col("c")).drop("c"), "candidate-nodes")
    n, grams = wanted.agg(F.count(F.lit(1)), F.sum("n_grams")).first()

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for df in batches:
            s = [shingles(w, size) for w in _arrays(df["w"])]
            keep = np.array([set_key(x) == k for x, k in zip(s, df["key"], strict=True)], dtype=bool)
            yield df[["key"]].assign(set=[x.tobytes() for x in s])[keep]

    # Only numbers and keys are looked up for the texts; the rest meets the sets by key, for which they are shuffled anyway.
    texts = base.where("doc_id is not null").join(small_side(wanted.select(F.col("id").alias("i"), "key")), F.col("doc_id") == F.col("i"))
    held = texts.select("key", _word_hashes(F.col("text")).alias("w")).mapInPandas(tidy(sets), "key binary, set binary").dropDuplicates(["key"])
    held = held.join(wanted.withColumnRenamed("key", "k"), F.col("key") == F.col("k")).drop("k", "n_grams")
    # Components within a block are packed several to a task; larger ones go by pairs of blocks.
    cut = F.col("cut")
    mine = F.pmod(F.xxhash64("key"), cut).cast("int")
    pair = F.explode(F.transform(F.sequence(F.lit(0), cut - 1), lambda o: F.struct(F.least(mine, o).alias("i"), F.greatest(mine, o).alias("j"))))
    bins = max(partitions(n, BLOCK), partitions((grams or 0) * 8, BLOCK_BYTES))
    held = held.withColumn("mine", mine).withColumn("pair", pair)
    held = held.withColumn("task", F.when(cut == 1, F.pmod(F.xxhash64("g"), F.lit(bins))).otherwise(F.col("g"))).withColumn("large", cut > 1)

    def compare(df: pd.DataFrame) -> pd.DataFrame:
        large = bool(df["large"].iloc[0])
        out = []
        for _, part in df.groupby("g", sort=False):
            part = part.sort_values("id", kind="stable")
            lone = large and df["i"].iloc[0] != df["j"].iloc[0]
            out += _compare(part, part["mine"].to_numpy() == df["i"].iloc[0] if lone else None, threshold)
        trim()
        return pd.concat(out) if out else pd.DataFrame({"key": [], "a": [], "b": [], "n": []})

    held = held.select("large", "task", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "mine", "g", "key", "id", "copies", "bands", "set")
    return stored(held.groupBy("large", "task", "i", "j").applyInPandas(compare, "key binary, a long, b long, n long"), "links")


def _compare(df: pd.DataFrame, left: np.ndarray | None, threshold: float) -> list[pd.DataFrame]:
    """Links among the rows of df, or between those of `left` and the others."""
    n = len(df)
    h = np.frombuffer(b"".join(df["bands"]), dtype=np.int64).reshape(n, -1)
    maybe = np.zeros((n, n), dtype=bool)
    for k in range(h.shape[1]):
        maybe |= h[:, k][:, None] == h[:, k][None, :]
    maybe &= np.tri(n, k=-1, dtype=bool).T if left is None else left[:, None] & ~left[None, :]
    i, j = np.nonzero(maybe)
    if not len(i):
        return []
    sets = [np.frombuffer(s, dtype=np.uint64) for s in df["set"]]
    size = np.array([len(s) for s in sets])
    # Sets whose sizes differ too much can't reach the threshold.
    fit = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9
    i, j = i[fit], j[fit]
    both = _common(sets, i, j)
    hit = both / (size[i] + size[j] - both) >= threshold
    i, j = i[hit], j[hit]
    ids, copies = df["id"].to_numpy(), df["copies"].to_numpy()
    count = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        was = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if np.array_equal(was, label):
            break
    some, moved = np.flatnonzero(count), np.flatnonzero(label != np.arange(n))
    key = df["key"].to_numpy()
    return [
        pd.DataFrame({"key": key[some], "a": ids[some], "b": pd.array([None] * len(some), dtype="Int64"), "n": pd.array(count[some].astype("int64"), dtype="Int64")}),
        pd.DataFrame({"key": key[moved], "a": ids[moved], "b": pd.array(ids[label[moved]], dtype="Int64"), "n": pd.array([None] * len(moved), dtype="Int64")}),
    ]


def _common(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, columns: int = 2048) -> np.ndarray:
    """Sizes of the intersections of pairs of sorted sets: one by one if they are few, else by products of 0/1 matrices."""
    if len(i) <= 2 * len(sets):
        return np.array([_meet(sets[a], sets[b]) for a, b in zip(i, j, strict=True)], dtype=np.int64)
    used = np.unique(np.concatenate([i, j]))
    row = np.repeat(used, [len(sets[k]) for k in used])
    _, col, often = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True, return_counts=True)
    keep = often[col] > 1  # what one set alone holds is in no intersection
    fresh = np.cumsum(often > 1) - 1
    row, col = row[keep], fresh[col[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    total = np.zeros((len(sets), len(sets)), dtype=np.float32)
    wide = int(col[-1]) + 1 if len(col) else 0
    for at in range(0, wide, columns):
        lo, hi = np.searchsorted(col, [at, at + columns])
        x = np.zeros((len(sets), min(columns, wide - at)), dtype=np.float32)
        x[row[lo:hi], col[lo:hi] - at] = 1
        total += x @ x.T
    return np.rint(total[i, j]).astype(np.int64)


def _meet(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def keep_one(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs with one row of each class: that of the least doc_id (of repeated rows of it, the first by text). Rows without a link stay, as do those with a null doc_id."""
    from pyspark.sql import Window

    found = stored(links_and_classes(docs, threshold).where("class_id <> doc_id or n_links > 0").select(F.col("doc_id").alias("__tw_id"), "class_id").distinct(), "classes-kept")
    gone = found.where("class_id <> __tw_id").select("__tw_id").distinct()
    kept = docs.join(small_side(gone), F.col("doc_id").cast("long") == F.col("__tw_id"), "left_anti")
    twice = kept.where("doc_id is not null").groupBy(F.col("doc_id").alias("__tw_twice")).count().where("count > 1").select("__tw_twice")
    if twice.isEmpty():
        return kept
    # Rows that repeat one doc_id are rare; they alone are ranked.
    again = kept.join(twice, F.col("doc_id") == F.col("__tw_twice"), "left_semi")
    first = again.withColumn("__tw_rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where("__tw_rank = 1").drop("__tw_rank")
    return kept.join(twice, F.col("doc_id") == F.col("__tw_twice"), "left_anti").unionByName(first)


def op8_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return links_and_classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = r"""
with recursive w0 as materialized (select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents where doc_id is not null),
sh as materialized (select distinct doc_id, array_to_string(w[i:i+4], ' ') as s from w0, unnest(range(1, greatest(len(w) - 4, 1) + 1)) x(i) where len(w) > 0),
n as (select doc_id, count(*) as n from sh group by doc_id),
c as materialized (select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
p as materialized (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where c / cast(x.n + y.n - c as double) >= 0.8),
e as materialized (select a, count(*) as k, min(b) as m from p group by a),
r as (select a as n, a as c from e union select p.b, r.c from r join p on r.n = p.a where r.c < p.b),
cls as (select n, min(c) as c from r group by n),
copies as (select doc_id, count(*) over (partition by l) as k from (select doc_id, list(s order by s) as l from sh group by doc_id))
select d.doc_id, coalesce(e.k, 0) as n_links, coalesce(cls.c, d.doc_id) as class_id, coalesce(copies.k, 1) as n_copies
from documents d left join e on e.a = d.doc_id left join cls on cls.n = d.doc_id left join copies on copies.doc_id = d.doc_id
"""
