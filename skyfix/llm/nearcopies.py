"""SimHash near-dedup with exact similarity: five-word shingles, for the pipeline's near-duplicate stage.

Two texts are linked if the Jaccard similarity of their sets of `size`-word shingles (ASCII letters
lower-cased) is `similarity` or more. The search is exact, so no pair is lost to a fingerprint:

1. Rows with equal sets are one set, and every set gets a SimHash of its shingles.
2. Fingerprints within `radius` bits of one another (pivot tables, see simhash.py) make groups, whose sets
   are compared. This links the closest copies.
3. Prefix filter. Under any one order of the shingles, linked sets of n shingles share one of the first
   n - ceil(similarity * n) + 1. The order is by hash, with shingles that are frequent in a sample
   of the texts last; the sample only chooses the order, so it cannot change the result.
   Sets that lie further apart than the radius (at 0.8 fingerprints differ in 10 +- 3 bits) are
   found by it: each set goes to the bucket of its first shared prefix shingle, where all are compared.
   Groups and buckets of more than LIMIT sets are dealt to several tasks, and dealt anew in a second round, so
   that no task holds a third of all sets.
4. Prefix shingles that still hold several components are buckets too. Two sets have at most their
   prefixes' common shingles and the longer rest in common, which rules out nearly all pairs.
   Buckets of at most WIDE sets give pairs, whose common prefix shingles are counted (those of wide
   buckets as if common) and which are then verified. To wide buckets first only the prefixes go; the
   sets that these cannot rule out follow whole, and pairs of different components are compared.
   Links of all steps give the components.

Defined cases: a null text is an empty one, and the empty texts are one set; fewer words than a
shingle make one shingle; a null doc_id counts as the smallest long; repeated rows are one; see keep_one() for which row stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfix.llm.common import LONG_MIN, as_bytes, discard, materialise, slices
from skyfix.llm.components import connected_components
from skyfix.llm.simhash import RADIUS, fingerprint_links, only
from skyfix.llm.textscan import WORDS, chunks

SIZE = 5
SIMILARITY = 0.8
#: One text of SAMPLE is counted for the order; a shingle in FREQUENT of these or more comes last.
SAMPLE, FREQUENT, MOST = 16, 12, 100_000
WIDE = 64
#: Sets of a bucket that one task compares.
LIMIT = 4096

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    for chunk in chunks(column):
        chunk.data = _LOWER[chunk.data]
        starts, ends, first = chunk.words()
        prefix = WORDS.prefix(chunk.word_hashes(starts, ends))
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            at = np.arange(a, max(b - size, a) + 1 if b > a else a)
            yield np.unique(WORDS.span(prefix, at, np.minimum(at + size, b)))


def set_fingerprint(s: np.ndarray) -> int:
    """Bit b is 1 if it is set in more than half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(s), 1 << 16):
        own = s[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.add.reduce(np.unpackbits(own, axis=1, bitorder="little"), axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(s), bitorder="little").tobytes(), "little")


def _name(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), 7)


def _prefix(n: int, similarity: float) -> int:
    return n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def among(s: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of s are in the sorted array `known`, by bisection: np.isin would sort all of `known` anew for every text."""
    return known[np.minimum(np.searchsorted(known, s), len(known) - 1)] == s if len(known) else np.zeros(len(s), bool)


def _scan_prefixes(size: int, similarity: float, last: np.ndarray):
    """last: sorted."""

    def ordered(s: np.ndarray) -> np.ndarray:
        late = among(s, last)
        return np.concatenate([s[~late], s[late]])[: _prefix(len(s), similarity)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = list(shingle_sets(batch.column("text"), size))
            names = np.array([_name(s) for s in sets], np.uint64).view(np.int64)
            marks = np.array([set_fingerprint(s) for s in sets], np.uint64).view(np.int64)
            columns = {"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "set": pa.array(names), "n": pa.array([len(s) for s in sets], pa.int64()), "fp": pa.array(marks), "prefix": _lists([ordered(s) for s in sets])}
            yield pa.RecordBatch.from_pydict(columns)

    return scan


def _scan_sets(size: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = list(shingle_sets(batch.column("text"), size))
            names = np.array([_name(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names), _lists(sets)], ["set", "shingles"])

    return scan


def _overlaps(sets: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each set the numbers of elements that it has in common with every set."""
    m, size = len(sets), [len(s) for s in sets]
    owner = np.repeat(np.arange(m), size)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    held = owner[np.argsort(code, kind="stable")]
    count = np.bincount(code)
    ends = np.cumsum(count)
    place = np.concatenate([[0], np.cumsum(size)])
    for i in range(m):
        mine = code[place[i] : place[i + 1]]
        n = count[mine]
        at = np.arange(n.sum()) + np.repeat(ends[mine] - np.cumsum(n), n)
        yield np.bincount(held[at], minlength=m)


def _enough(common: np.ndarray, size: np.ndarray, i: int, similarity: float) -> np.ndarray:
    return common * (1 + similarity) >= similarity * (size + size[i]) - 1e-9


def bucket_links(sets: list[np.ndarray], labels: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links that join the components of a bucket's sets; sets of one label are joined already."""
    size = np.array([len(s) for s in sets])
    _, group = np.unique(labels, return_inverse=True)
    out = []
    for i, common in enumerate(_overlaps(sets)):
        for j in np.flatnonzero(_enough(common, size, i, similarity) & (group != group[i])).tolist():
            if group[j] != group[i]:
                out.append((i, j))
                group[group == group[j]] = group[i]
        if (group == group[0]).all():
            break
    return out


def open_sets(prefixes: list[np.ndarray], size: np.ndarray, labels: np.ndarray, similarity: float) -> np.ndarray:
    """Which sets of a bucket could be linked to one of another label, as far as the prefixes tell."""
    rest = size - np.array([len(p) for p in prefixes])
    out = np.zeros(len(size), bool)
    for i, common in enumerate(_overlaps(prefixes)):
        most = np.minimum(common + np.maximum(rest, rest[i]), np.minimum(size, size[i]))
        out[i] = (_enough(most, size, i, similarity) & (labels != labels[i])).any()
    return out


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Names, labels, sizes and lists of each bucket of two or more. Rows come sorted by key and set; repeats are one."""
    key, rows = None, []

    def bucket() -> tuple:
        names, labels, sizes, lists = zip(*rows, strict=True)
        return np.array(names, np.int64), np.array(labels, np.int64), np.array(sizes), list(lists)

    for batch in batches:
        keys, name, label, size = (batch.column(c).to_pylist() for c in ("key", "set", "label", "n"))
        lists = batch.column("list")
        offs, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        for i, k in enumerate(keys):
            if k != key:
                if len(rows) > 1:
                    yield bucket()
                key, rows = k, []
            if not rows or rows[-1][0] != name[i]:
                rows.append((name[i], label[i], size[i], flat[offs[i] : offs[i + 1]]))
    if len(rows) > 1:
        yield bucket()


def _scan_links(similarity: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, labels, _, sets in _buckets(batches):
            if found := bucket_links(sets, labels, similarity):
                u, v = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(names[u]), pa.array(names[v])], ["u", "v"])

    return scan


def _scan_texts(size: int, similarity: float):
    """Links of the texts in each bucket (key, set, text); texts are smaller to send than their sets."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = list(shingle_sets(batch.column("text"), size))
            sizes = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("set"), batch.column("set"), sizes, _lists(sets)], ["key", "set", "label", "n", "list"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _scan_links(similarity)(listed(batches))

    return scan


def _scan_open(similarity: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, labels, sizes, prefixes in _buckets(batches):
            found = open_sets(prefixes, sizes, labels, similarity)
            if found.any():
                yield pa.RecordBatch.from_arrays([pa.array(names[found])], ["set"])

    return scan


def _bucketed(members: DataFrame, lists: DataFrame) -> DataFrame:
    """members (key, set, label) with the n and list of their set, in buckets."""
    rows = members.join(lists, "set").select("key", "set", "label", "n", "list")
    return rows.repartition("key").sortWithinPartitions("key", "set")


def _mixed(members: DataFrame) -> DataFrame:
    """The members of keys that hold several labels, with the key's number of members."""
    keys = members.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count(F.lit(1)).alias("members")).filter("a <> b")
    return members.join(keys.select("key", "members"), "key").select("key", "set", "label", "members")


def _likely(common: Column, similarity: float) -> Column:
    return common * (1 + similarity) >= similarity * (F.col("u_n") + F.col("v_n")) - 1e-9


def _pairs(members: DataFrame, sizes: DataFrame, wide: int, similarity: float) -> DataFrame:
    """u_set, v_set, u_n, v_n: pairs of different labels with a prefix shingle of a bucket of at most `wide` sets in common, that their prefixes do not rule out."""
    many = members.groupBy("set").agg(F.sum((F.col("members") > wide).cast("long")).alias("many"))
    rows = materialise(members.filter(F.col("members") <= wide).join(many, "set").join(sizes, "set").select("key", "set", "label", "n", "rest", "many"), "narrow-places")
    a, b = (rows.select("key", *[F.col(c).alias(f"{side}_{c}") for c in rows.columns[1:]]) for side in "uv")
    pairs = a.join(b, "key").filter((F.col("u_set") < F.col("v_set")) & (F.col("u_label") != F.col("v_label")) & _likely(F.least("u_n", "v_n"), similarity))
    own = [f"{side}_{c}" for side in "uv" for c in ("n", "rest", "many")]
    pairs = pairs.groupBy("u_set", "v_set").agg(F.count(F.lit(1)).alias("c"), *[F.first(c).alias(c) for c in own])
    most = F.least(F.col("c") + F.least("u_many", "v_many") + F.greatest("u_rest", "v_rest"), "u_n", "v_n")
    pairs = materialise(pairs.filter(_likely(most, similarity)).select("u_set", "v_set", "u_n", "v_n"), "pairs")
    discard(rows)
    return pairs


def _pair_links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """u, v: the pairs that are linked, by the lists of their sets."""
    for side in "uv":
        pairs = pairs.join(sets.select(F.col("set").alias(f"{side}_set"), F.col("list").alias(f"{side}_list")), f"{side}_set")
    common = F.size(F.array_intersect("u_list", "v_list"))
    return pairs.filter(_likely(common, similarity)).select(F.col("u_set").alias("u"), F.col("v_set").alias("v"))


def _fingerprint_groups(distinct: DataFrame, radius: int) -> DataFrame:
    """key, set of the sets whose fingerprints are linked to others'."""
    fps = materialise(distinct.groupBy("fp").agg(F.count(F.lit(1)).alias("sets")), "set-fingerprints")
    roots = connected_components(fingerprint_links(fps.select("fp"), radius)).withColumnRenamed("node", "fp")
    # a set alone with its fingerprint, without a link, has nothing to be compared with
    groups = fps.join(roots, "fp", "left").filter("sets > 1 or component is not null").select("fp", F.coalesce("component", "fp").alias("key"))
    return distinct.select("set", "fp").join(groups, "fp").select("key", "set")


def _dealt(places: DataFrame, limit: int) -> DataFrame:
    """places (key, set), with keys of more than `limit` members dealt to as many keys as needed, in two ways."""
    members = places.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > limit)
    parts = F.ceil(F.col("members") / limit)
    salt = F.explode(F.array(*[F.when(F.col("members").isNotNull(), F.pmod(F.xxhash64("set", F.lit(r)), parts) * 2 + r + 1) for r in range(2)]))
    rows = places.join(materialise(members, "crowded-keys"), "key", "left").withColumn("salt", salt)
    return rows.select(F.when(F.col("salt").isNull(), F.col("key")).otherwise(F.xxhash64("key", "salt")).alias("key"), "set").distinct()


def near_copies(docs: DataFrame, size: int = SIZE, similarity: float = SIMILARITY, wide: int = WIDE, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """set, row (smallest doc_id and text_hash) and root of every distinct set of shingles."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LONG_MIN)).alias("doc_id"), F.xxhash64("text").alias("text_hash"), as_bytes().alias("text"))
    sample = texts.filter(F.pmod("text_hash", F.lit(SAMPLE)) == 0).dropDuplicates(["text_hash"]).select("text")
    often = sample.mapInArrow(_scan_sets(size), "set long, shingles array<long>").select(F.explode("shingles").alias("s"))
    often = often.groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "s").limit(MOST)
    last = np.sort(np.array([r["s"] for r in often.collect()], np.int64).view(np.uint64))
    marked = texts.mapInArrow(_scan_prefixes(size, similarity, last), "doc_id long, text_hash long, set long, n long, fp long, prefix array<long>")
    distinct = marked.groupBy("set").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("prefix").alias("prefix"))
    distinct = materialise(distinct, "shingle-sets")
    places = distinct.select(F.explode("prefix").alias("key"), "set")
    keys = materialise(places.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "shared-shingles")
    shared = materialise(places.join(keys, "key").select("key", "set"), "shared-places")
    once = shared.groupBy("set").agg(F.min("key").alias("key")).select("key", "set")
    once = materialise(_fingerprint_groups(distinct, radius).unionByName(once), "first-groups")
    once = materialise(_dealt(once, limit), "first-places")
    discard(keys)

    def texts_of(names: DataFrame) -> DataFrame:
        """names (with a column set) with the text of each set's row."""
        of = names.join(distinct, "set").select(*names.columns, F.col("row.doc_id").alias("of"), F.col("row.text_hash").alias("of_hash"))
        return texts.join(of, (texts["doc_id"] == of["of"]) & (texts["text_hash"] == of["of_hash"])).select(*names.columns, "text")

    first = texts_of(once).select("key", "set", "text").repartition("key").sortWithinPartitions("key", "set")
    links = materialise(first.mapInArrow(_scan_texts(size, similarity), "u long, v long"), "first-links")
    roots = materialise(connected_components(links), "first-roots")
    labelled = shared.join(roots, F.col("set") == F.col("node"), "left").select("key", "set", F.coalesce("component", "set").alias("label"))
    labelled = materialise(_mixed(labelled), "mixed-places")
    pairs = _pairs(labelled, distinct.select("set", "n", (F.col("n") - F.size("prefix")).alias("rest")), wide, similarity)
    broad = labelled.filter(F.col("members") > wide).select("key", "set", "label")
    prefixes = distinct.select("set", "n", F.col("prefix").alias("list"))
    open_ = materialise(_bucketed(broad, prefixes).mapInArrow(_scan_open(similarity), "set long").distinct(), "open-sets")
    # the texts are gone through once for both
    names = pairs.select(F.explode(F.array("u_set", "v_set")).alias("set")).unionByName(open_).distinct()
    sets = texts_of(names).select("text").mapInArrow(_scan_sets(size), "set long, shingles array<long>").dropDuplicates(["set"])
    sets = materialise(sets.select("set", F.size("shingles").cast("long").alias("n"), F.col("shingles").alias("list")), "open-lists")
    again = _bucketed(_mixed(broad.join(open_, "set")), sets)
    more = _pair_links(pairs, sets, similarity).unionByName(again.mapInArrow(_scan_links(similarity), "u long, v long"))
    roots = connected_components(links.unionByName(more))
    return distinct.join(roots, F.col("set") == F.col("node"), "left").select("set", "row", F.coalesce("component", "set").alias("root"))


def keep_one(docs: DataFrame, size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of docs, unchanged, for each group of linked texts: the one with the smallest doc_id.

    Of several texts with that id the one with the smallest hash stays, and of repeated rows one.
    """
    return only(docs, near_copies(docs, size, similarity).groupBy("root").agg(F.min("row").alias("row")))
