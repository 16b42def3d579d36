"""Benchmark decontamination by SimHash of item-sized windows. DataFrame functions only.

An item of n words has n - 4 shingles of five words, weighted by how often they occur; a window of a document is as many
consecutive shingles (the whole document if it is shorter). Similarity is sum(min) / sum(max) of the weights. An item of one to four words is one shingle
of all its words, and so is a window of its size.

Which windows: a window that shares no shingle with an item has similarity 0, and moving a window right to its first
shared shingle (or left to the end of the document) loses none of what it shares. So the windows that start at a shingle shared with an item decide;
each meets only the items whose shingle it starts at, and only if it holds enough of the item's shingles to reach the similarity at all.
Their number is that of shared shingles at most, not windows times items.
Each window gets a 64-bit SimHash. The fingerprints of the items are indexed by item and by RADIUS + 1 blocks of bits: two
fingerprints within RADIUS bits agree on one block at least, so the join on (item, block, bits) finds all of them. At this radius blocks are of two or three
bits and let most pairs through; it is the shared shingles that keep candidates few, and the Hamming distance that sorts them.
Each occurrence of a shingle votes with a hash of its own: the k-th one of a window with that of (shingle, k). So sum(min) / sum(max) of the weights
is the share of common votes, and a shingle that is repeated often outweighs no others. At similarity 0.8 the votes have cosine 8/9 at least, so 9.7 of 64 bits
differ on average; more than RADIUS = 23 differ for about 1 in 100,000 such windows. Survivors are compared exactly on their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import partitions, small_side, stored, words

SIZE = 5
RADIUS = 23
#: Items of a file.
ITEMS = 2_000
_WIDTHS = [64 * (i + 1) // (RADIUS + 1) - 64 * i // (RADIUS + 1) for i in range(RADIUS + 1)]
_STARTS = [sum(_WIDTHS[:i]) for i in range(RADIUS + 1)]


def shingle_hashes(ws: Column, size: int = SIZE) -> Column:
    """Hashes of the shingles of an array of words; none if it has fewer words."""
    last = F.size(ws) - size
    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(size)]))
    return F.when(last >= 0, each).otherwise(F.array().cast("array<bigint>"))


def shingle_texts(ws: Column, size: int = SIZE) -> Column:
    last = F.size(ws) - size
    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.concat_ws(" ", *[F.get(ws, i + k) for k in range(size)]))
    return F.when(last >= 0, each).otherwise(F.array().cast("array<string>"))


def common(a: Column, b: Column) -> Column:
    """sum(min) of the weights of two arrays of shingles."""
    twice = F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, s: acc + F.least(F.size(F.filter(a, lambda x: x == s)), F.size(F.filter(b, lambda x: x == s))))
    # Where no shingle of one side repeats, each counts once at most.
    return F.when(F.size(F.array_distinct(a)) == F.size(a), F.size(F.array_intersect(a, b))).otherwise(twice)


def votes(hashes: Column) -> Column:
    """A hash for each occurrence: the first of a shingle keeps the shingle's, the k-th has that of (shingle, k)."""
    ordered = F.array_sort(hashes)

    def vote(xs: Column) -> Column:
        return F.transform(xs, lambda x, i: F.when((i == 0) | (F.get(xs, i - 1) != x), x).otherwise(F.xxhash64(x, i - F.array_position(xs, x) + 2)))

    # ordered is bound to a name, so it is sorted once.
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), hashes).otherwise(F.get(F.transform(F.array(ordered), vote), 0))


def simhash(hashes: Column, longest: int) -> Column:
    """64-bit SimHash of an array of votes; a tied bit is 0.

    Bits are counted in lanes of a long: lane k of sum j counts bit k * width + j. Lanes are wide enough for `longest` votes.
    """
    width = 8 if longest <= 127 else 16 if longest <= 32_767 else 32
    mask = F.lit(sum(1 << (k * width) for k in range(64 // width))).cast("long")

    def lane_sum(j: Column) -> Column:
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, x: acc + F.call_function("shiftrightunsigned", x, j).bitwiseAND(mask))

    sums = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lane_sum)

    def bits(s: Column) -> Column:
        def vote(acc: Column, b: Column) -> Column:
            lane = F.call_function("shiftrightunsigned", F.get(s, F.pmod(b, F.lit(width))), (b - F.pmod(b, F.lit(width))))
            count = lane.bitwiseAND(F.lit((1 << width) - 1).cast("long"))
            return acc.bitwiseOR(F.when(count * 2 > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))

        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), vote)

    # The sums are bound to a name, so they are made once.
    return F.get(F.transform(F.array(sums), bits), 0)


def blocks(fp: Column) -> Column:
    """array<struct<no, bits>>: the RADIUS + 1 blocks of a fingerprint."""
    return F.array(*[F.struct(F.lit(i).alias("no"), F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << w) - 1).cast("long")).alias("bits")) for i, (s, w) in enumerate(zip(_STARTS, _WIDTHS, strict=True))])


def candidates(docs: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """docs (doc_id, text), items (item_id, item, m, h) -> doc_id, mark, ats: for each text the windows that can reach the similarity, each with its items.

    ats: array<struct<m, s, items>>, a window being m shingles from the s-th on; mark is a hash of the text. A window is listed once. A window of n shingles
    reaches the similarity t with an item of m only if t / (1 + t) * (m + n) of its shingles at least occur in the item; the others are left out.
    """
    each = items.select(F.explode(F.array_distinct("h")).alias("x"), F.struct("m", "item_id", "item").alias("it"))
    wanted = each.groupBy("x").agg(F.collect_set("it").alias("its"))
    spread = docs.select("doc_id", F.xxhash64("text").alias("mark"), words(F.col("text")).alias("w")).select("doc_id", "mark", shingle_hashes(F.col("w")).alias("h"))
    # explode_outer: for explode Spark adds a filter on the array, which would work it out anew, word by word.
    hits = spread.select("doc_id", "mark", F.size("h").alias("n"), F.posexplode_outer("h").alias("pos", "x")).join(small_side(wanted), "x")
    met = hits.select("doc_id", "mark", "n", "pos", F.explode("its").alias("it")).groupBy("doc_id", "mark", "n", "it").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    m, n, at, size = F.col("it.m"), F.col("n"), F.col("at"), F.size("at")
    met = met.withColumn("need", F.greatest(F.lit(1), F.ceil(F.lit(similarity / (1 + similarity)) * (m + F.least(m, n)) - F.lit(1e-6)).cast("int"))).where(size >= F.col("need"))
    # A window that starts at the i-th shared shingle holds the `need` next of them if the last of these lies in it; one moved left to the end of the document, if the `need` last lie in it.
    inside = lambda p, i: F.when(p <= n - m, F.get(at, i + F.col("need") - 1) < p + m).otherwise(F.get(at, size - F.col("need")) >= n - m)
    starts = F.array_distinct(F.transform(F.filter(at, lambda p, i: F.coalesce(inside(p, i), F.lit(False))), lambda p: F.greatest(F.lit(0), F.least(p, n - m))))
    windows = met.select("doc_id", "mark", "it", F.explode(starts).alias("s")).groupBy("doc_id", "mark", "it.m", "s").agg(F.collect_set(F.struct("it.item_id", "it.item")).alias("items"))
    return windows.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("m", "s", "items")).alias("ats"))


def near_windows(docs: DataFrame, items: DataFrame, longest: int, similarity: float) -> DataFrame:
    """doc_id, item_id, item, wt (the window's shingles): windows whose fingerprint is within RADIUS of an item that they share a shingle with."""
    starts = stored(candidates(docs, items, similarity), "leak-starts").select(F.col("doc_id").alias("d"), F.col("mark").alias("k"), "ats")
    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).join(small_side(starts), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("k")))
    held = marked.select("doc_id", words(F.col("text")).alias("w"), "ats").select("doc_id", "w", shingle_hashes(F.col("w")).alias("h"), "ats")
    windows = held.select("doc_id", "w", "h", F.explode_outer("ats").alias("at"))
    windows = windows.select("doc_id", "at.items", F.slice("h", F.col("at.s") + 1, F.col("at.m")).alias("wh"), F.slice("w", F.col("at.s") + 1, F.col("at.m") + SIZE - 1).alias("ww"))
    windows = windows.withColumn("v", votes(F.col("wh"))).withColumn("fp", simhash(F.col("v"), longest)).select("doc_id", "ww", "fp", "items")
    probes = windows.select("doc_id", "ww", "fp", F.explode_outer("items").alias("it")).select("doc_id", "ww", "fp", "it", F.explode_outer(blocks(F.col("fp"))).alias("b"))
    index = items.select(F.col("item_id").alias("ii"), F.col("item").alias("ik"), "ifp", F.explode_outer(blocks(F.col("ifp"))).alias("ib"))
    same = (F.col("it.item") == F.col("ik")) & F.col("it.item_id").eqNullSafe(F.col("ii"))
    near = probes.join(small_side(index), same & (F.col("b.no") == F.col("ib.no")) & (F.col("b.bits") == F.col("ib.bits")))
    near = near.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= RADIUS)
    # A pair within the radius meets in several blocks; it goes on from the first one only.
    agree = F.get(F.filter(F.arrays_zip(blocks(F.col("fp")).alias("p"), blocks(F.col("ifp")).alias("q")), lambda z: z["p"]["bits"] == z["q"]["bits"]), 0)["p"]["no"]
    return near.where(agree == F.col("b.no")).select("doc_id", F.col("ii").alias("item_id"), F.col("ik").alias("item"), shingle_texts(F.col("ww")).alias("wt"))


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> doc_id, item_id, similarity of the best window; pairs at or above `similarity`.

    Items of one to four words match the very same words in a row (similarity 1). Null and empty texts, and texts without a word, match nothing; nor do documents
    shorter than an item of four words or fewer, while a document shorter than a longer item is one window. Rows of docs
    with one doc_id count as one document; so do rows with a null doc_id, and items likewise: the best window of any of them. Very long texts are read whole;
    an empty table on either side gives no rows; other columns are not read, whatever their names.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0).distinct()
    # As few files as the items need, whatever the shuffle's partitions: each file that an executor writes makes it start other processes.
    items = items.repartition(partitions(benchmark.count(), ITEMS))
    items = stored(items.withColumn("k", F.least(F.lit(SIZE), F.size("w"))).withColumn("item", F.xxhash64("w")), "items")
    counts = dict(items.groupBy("k").agg(F.struct(F.count(F.lit(1)), F.max(F.size("w")))).collect())
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = None
    if SIZE in counts:
        n, most = counts[SIZE]
        whole = items.where(F.col("k") == SIZE).repartition(partitions(n, 8, 1)).select("item_id", "item", "w", (F.size("w") - SIZE + 1).alias("m"), shingle_hashes(F.col("w")).alias("h"))
        whole = whole.withColumn("v", votes(F.col("h"))).withColumn("ifp", simhash(F.col("v"), most))
        whole = stored(whole.select("item_id", "item", "m", "h", "ifp", shingle_texts(F.col("w")).alias("t")), "item-fingerprints")
        near = near_windows(base, whole, most, similarity)
        texts = small_side(whole.select(F.col("item_id").alias("ti"), F.col("item").alias("tk"), "t"))
        near = near.join(texts, (F.col("item") == F.col("tk")) & F.col("item_id").eqNullSafe(F.col("ti"))).withColumn("c", common(F.col("t"), F.col("wt")))
        near = near.select("doc_id", "item_id", (F.col("c").cast("double") / (F.size("t") + F.size("wt") - F.col("c"))).alias("similarity"))
        found = near.where(F.col("similarity") >= F.lit(float(similarity)))
    for k in sorted(set(counts) - {SIZE}):
        # A window of one shingle is its own fingerprint, so here the index is the shingle.
        short = small_side(items.where(F.col("k") == k).select("item_id", F.array_join("w", " ").alias("t")))
        each = base.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.explode(shingle_texts(F.col("w"), k)).alias("wt"))
        each = each.join(short, F.col("wt") == F.col("t")).select("doc_id", "item_id", F.lit(1.0).alias("similarity"))
        found = each if found is None else found.unionAll(each)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, similarity double")
    return found.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """docs without those that hold an item; all columns as they were. Rows with a null doc_id go or stay together."""
    bad = stored(leaks(docs, benchmark, similarity).select(F.col("doc_id").alias("__tw_bad")).distinct(), "leaks")
    return docs.join(small_side(bad), F.col("doc_id").cast("long").eqNullSafe(F.col("__tw_bad")), "left_anti")


def op4_benchmark_leaks(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: DuckDB: every window of an item's size that starts at a shared shingle, compared exactly.
SQL = r"""
with d as (select doc_id, row_number() over () as rid, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents),
b0 as (select item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from benchmark),
b as (select distinct item_id, w, least(5, len(w)) as k, len(w) - least(5, len(w)) + 1 as m from b0 where len(w) >= 1),
b1 as (select *, row_number() over () as iid from b),
ds as (select rid, doc_id, k, len(w) - k + 1 as n, i, array_to_string(w[i:i+k-1], ' ') as s from d join (select distinct k from b) on len(w) >= k, unnest(range(1, len(w) - k + 2)) x(i)),
bs as (select iid, k, m, s, count(*) as c from (select iid, k, m, array_to_string(w[i:i+k-1], ' ') as s from b1, unnest(range(1, m + 1)) x(i)) group by all),
hit as (select distinct rid, doc_id, n, ds.i, iid, m, bs.s, bs.c from ds join bs on ds.k = bs.k and ds.s = bs.s),
win as (select distinct rid, doc_id, iid, n, m, greatest(1, least(i, n - m + 1)) as start from hit),
cnt as (select w.rid, w.doc_id, w.iid, w.n, w.m, w.start, h.s, least(count(*), any_value(h.c)) as c from win w join hit h on h.rid = w.rid and h.iid = w.iid and h.i between w.start and w.start + w.m - 1 group by all),
sim as (select doc_id, iid, sum(c) / cast(least(n, m) + m - sum(c) as double) as similarity from cnt group by rid, doc_id, iid, n, m, start)
select doc_id, item_id, max(similarity) as similarity from sim join b1 using (iid) group by all having max(similarity) >= 0.8
"""
