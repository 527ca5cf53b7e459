"""Benchmark decontamination: SimHash of item-sized windows, multi-index blocks, exact check.

DataFrame expressions only. Texts and items become lower-case alphanumeric words and hashed 5-word
shingles. A document holds an item if some window of as many words as the item has (the whole text
if it is shorter) has weighted-shingle similarity >= `similarity` with it: the sum of the smaller
over the sum of the larger counts of each shingle.

1. Windows. A window that meets the similarity s shares at least o = ceil(s * (a + b) / (1 + s))
   shingles with its item (a, b: their numbers). Moving a window's start to its first shared shingle
   loses none, so only windows that start at a shared shingle (or end with the text) and span o
   shared ones are kept. This is exact and leaves few windows of a corpus.
2. Fingerprints. Each such window and each item gets a 64-bit SimHash of its shingles, each shingle marked
   with its number among equal ones, so that similarity counts repeats and the angle below holds for them.
3. Multi-index. 64 bits form radius + 1 blocks; any two fingerprints within the radius agree on a
   block, so windows meet items of their own size on equal blocks, and the Hamming distance decides.
   Marked shingles at similarity 0.8 lie 27 degrees apart, 10 +- 3 bits of 64; the default radius of
   24 is over four standard deviations more. A pair further apart is not lost: step 1 knows which item each
   window was found by, and pairs beyond the radius go to step 4 as well.
4. Exact weighted-shingle similarity of these pairs.

The items' shingles and blocks are broadcast only while they number at most `broadcast_rows`; beyond
that the joins shuffle, with the same result. Text is shuffled by document only in the second pass, to the rows that
have windows (or not at all, if Spark finds those small enough to broadcast).

Defined cases: a null text or an item of fewer than five words has no shingle and is never found;
equal items are found together; a null item_id is kept as null; rows with equal doc_id and text are one document; a null doc_id is
kept as null; an empty table gives no pair. Other columns are ignored by find(), kept by clean().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfix.llm.common import materialise

SIZE = 5
SIMILARITY = 0.8
RADIUS = 24
BROADCAST_ROWS = 200_000

GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), GAPS), lambda w: w != "")


def shingles(hashes: Column, size: int = SIZE) -> Column:
    """The hashed shingles of an array of word hashes, in order; empty if there are fewer words."""
    n = F.size(hashes) - (size - 1)
    each = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(size)]))
    return F.when(n > 0, each).otherwise(F.array().cast("array<bigint>"))


def _with_shingles(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n (words) and shingles of every row."""
    hashed = df.select(*keys, F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    return hashed.select(*keys, F.size("h").alias("n"), shingles(F.col("h")).alias("shingles"))


def _marked(bag: Column) -> Column:
    """Each shingle hashed with its number among equal ones, so that common elements count repeats."""
    ordered = F.array_sort(bag)
    return F.transform(ordered, lambda x, i: F.xxhash64(x, i - F.array_position(ordered, x).cast("int")))


def _bits(name: str) -> list[Column]:
    return [F.sum(F.shiftrightunsigned(F.col(name), b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(64)]


def _fingerprint(count: Column) -> Column:
    out = F.lit(0).cast("long")
    for b in range(64):
        bit = F.lit(1 << b) if b < 63 else F.lit(-(2**63))
        out = out.bitwiseOR(F.when(F.col(f"b{b}") * 2 > count, bit.cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def fingerprints(bags: DataFrame, keys: list[str], bag: str) -> DataFrame:
    """keys, fp: the SimHash of every row's array of (marked) shingles."""
    one = bags.select(*keys, F.explode_outer(bag).alias("shingle"))
    return one.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), *_bits("shingle")).select(*keys, _fingerprint(F.col("count")).alias("fp"))


def _blocks(fp: Column, radius: int) -> Column:
    edges = [round(i * 64 / (radius + 1)) for i in range(radius + 2)]
    return F.array(*[F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:], strict=False)])


def _least(a: Column, b: Column, similarity: float) -> Column:
    """The smallest number of common shingles with which bags of a and b shingles meet the similarity."""
    return F.greatest(F.ceil(F.lit(similarity / (1 + similarity)) * (a + b) - 1e-9), F.lit(1)).cast("int")


def find(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, text_hash, item_id, similarity (of the best window) of every document and item it holds."""
    if not 0 < radius < 64:
        raise ValueError("radius must lie in 1..63")
    items = _with_shingles(items.select("item_id", "text"), ["item_id"]).filter(F.size("shingles") > 0)
    # equal rows are one; item names a row, as ids may be null or shared
    items = items.withColumn("item", F.xxhash64("item_id", "shingles")).dropDuplicates(["item"])
    items = materialise(items.withColumn("item_bag", _marked(F.col("shingles"))), "items")
    few = items.agg(F.sum(F.size("shingles"))).first()[0] or 0
    small = lambda df, rows: F.broadcast(df) if rows <= broadcast_rows else df
    wanted = small(items.select("item", F.col("n").alias("i_n"), F.explode(F.array_distinct("shingles")).alias("shingle")), few)
    keys = ["doc_id", "text_hash"]
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    # outer: else Spark infers a filter on the array's size and evaluates the whole text twice
    places = _with_shingles(rows, keys).select(*keys, "n", F.posexplode_outer("shingles").alias("p", "shingle"))
    hits = places.join(wanted, "shingle").groupBy(*keys, "n", "item", "i_n").agg(F.array_sort(F.collect_set("p")).alias("ps"))
    span = F.least("n", "i_n") - (SIZE - 1)
    hits = hits.withColumn("span", span).withColumn("least", _least(F.col("span"), F.col("i_n") - (SIZE - 1), similarity)).filter(F.size("ps") >= F.col("least"))
    last = F.col("n") - F.least("n", "i_n")
    full = lambda p, i: F.get("ps", i + F.col("least") - 1) < p + F.col("span")
    at_hits = F.filter("ps", lambda p, i: (p <= F.col("last")) & F.coalesce(full(p, i), F.lit(False)))
    at_end = F.when(F.size(F.filter("ps", lambda p: p >= F.col("last"))) >= F.col("least"), F.array("last"))
    starts = F.array_union(at_hits, F.coalesce(at_end, F.array().cast("array<int>")))
    windows = hits.withColumn("last", last).select(*keys, "item", "i_n", "span", F.explode_outer(starts).alias("start")).filter("start is not null")
    windows = windows.groupBy(*keys, "i_n", "span", "start").agg(F.collect_set("item").alias("by"))
    windows = windows.groupBy(*keys).agg(F.collect_list(F.struct("i_n", "span", "start", "by")).alias("windows"))
    windows = materialise(windows, "windows").withColumnsRenamed({"doc_id": "of", "text_hash": "of_hash"})
    # the second pass: the windows' shingles
    held = rows.join(windows, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_hash")))
    held = held.select(*keys, "windows", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h")).select(*keys, "windows", shingles(F.col("h")).alias("shingles"))
    bags = F.transform("windows", lambda w: F.struct(w["i_n"].alias("i_n"), w["start"].alias("start"), w["by"].alias("by"), F.slice("shingles", w["start"] + 1, w["span"]).alias("bag")))
    bags = held.select(*keys, F.explode_outer(bags).alias("w")).select(*keys, "w.i_n", "w.start", "w.by", _marked(F.col("w.bag")).alias("bag"))
    # equal bags of one size, wherever they stand, are compared once
    bags = bags.withColumn("name", F.xxhash64("i_n", "bag"))
    bags = materialise(bags, "bags")
    places = bags.select(*keys, "name").distinct()
    found_by = bags.select("name", F.explode("by").alias("item")).distinct()
    distinct = bags.groupBy("name").agg(F.first("i_n").alias("i_n"), F.first("bag").alias("bag"))
    distinct = materialise(distinct, "distinct-bags")
    # merged: both sides grow with the leaks, and their files' sizes say little of their arrays' size in memory
    left = materialise(distinct.hint("merge").join(fingerprints(distinct, ["name"], "bag"), "name"), "window-fingerprints")
    right = materialise(items.join(fingerprints(items, ["item"], "item_bag").withColumnRenamed("fp", "item_fp"), "item").select("item", "n", "item_bag", "item_fp"), "item-fingerprints")
    indexed = lambda fp: F.explode(F.arrays_zip(F.sequence(F.lit(0), F.lit(radius)).alias("block"), _blocks(F.col(fp), radius).alias("value")))
    probes = left.select("name", "i_n", "fp", indexed("fp").alias("probe"))
    index = small(right.select("item", "n", "item_fp", indexed("item_fp").alias("entry")), few * (radius + 1))
    within = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius
    near = probes.join(index, (F.col("i_n") == F.col("n")) & (F.col("probe.block") == F.col("entry.block")) & (F.col("probe.value") == F.col("entry.value"))).filter(within)
    far = found_by.join(left.select("name", "fp"), "name").join(small(right.select("item", "item_fp"), few), "item").filter(~within)
    pairs = near.select("name", "item").unionByName(far.select("name", "item")).distinct()
    pairs = pairs.join(left.select("name", "bag").hint("merge"), "name").join(small(right.select("item", "item_bag"), few), "item")
    common = F.size(F.array_intersect("bag", "item_bag"))
    alike = pairs.select("name", "item", (common / (F.size("bag") + F.size("item_bag") - common)).alias("similarity")).filter(F.col("similarity") >= similarity)
    out = places.join(alike, "name").groupBy(*keys, "item").agg(F.max("similarity").alias("similarity"))
    return out.join(small(items.select("item", "item_id"), few), "item").groupBy(*keys, "item_id").agg(F.max("similarity").alias("similarity"))


def clean(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The rows of docs, unchanged, that hold no item."""
    found = materialise(find(docs, items, similarity, radius).select(F.col("doc_id").alias("of"), F.col("text_hash").alias("of_hash")).distinct(), "contaminated")
    return docs.join(found, docs["doc_id"].eqNullSafe(found["of"]) & (F.xxhash64(docs["text"]) == found["of_hash"]), "left_anti")
