"""SimHash near-dedup with pivot distance tables.

Fingerprint: bit b is 1 if bit b is set in more than half of the XXH64 hashes (seed 42) of a text's
word shingles, repeats included. Equal fingerprints are merged first, so copies cost one row.

The pivots are a zero fingerprint and 32 masks of two neighbouring bits each. With distances d0 and di,
(d0 - di) / 2 + 1 is the number of ones in mask i, so the whole table of distances is kept as one
64-bit column of 32 coordinates (0 to 2 each), computed once for every distinct fingerprint.

Candidate search is exact. By the triangle inequality no coordinate differs by more than the Hamming
distance, and as the masks do not overlap, two fingerprints within `radius` differ in at most
`radius` of the 32 coordinates. These form BLOCKS groups of which BLOCKS - radius must agree wholly:
each fingerprint is filed under every such combination. Within a bucket, pairs whose distances to
the zero pivot differ by more than the radius, or that differ in more than `radius` coordinates,
are discarded, and the survivors' Hamming distances are computed. In a bucket of more than BUCKET fingerprints
the coordinates do not separate enough (dense groups of near copies): its members are filed anew by
groups of bits, and again by finer ones, until at most FREE_BITS bits are free, so that no bucket can
hold more. Only a spanning forest of each bucket's links leaves it, never all pairs; components
join the forests.

Defined cases: a null text is an empty one, fingerprint zero, linked like any other; fewer words
than a shingle make one shingle; ties of a bit give 0; rows with equal doc_id each get a row, and
their component is that of their own text; a null doc_id counts in no component's smallest id
unless all ids are null (then component_id is null). Bytes that are not UTF-8 are taken as they are.
A text of any length is handled in blocks of shingles. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyfix.llm.common import LONG_MIN, as_bytes, fresh, materialise
from skyfix.llm.components import connected_components

SEED = 42
RADIUS = 3
BLOCKS = 6
#: Bits left free in a refined bucket, and so the most distinct fingerprints it can hold.
FREE_BITS = 12
BUCKET = 1 << FREE_BITS
#: Shingles whose hashes are held at once.
_BLOCK = 1 << 16
_LOW = 0x5555555555555555

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint_bytes(text: bytes, size: int = 3) -> int:
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    digest, n = xxhash.xxh64_digest, max(1, len(words) - size + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        own = words[at : at + _BLOCK + size - 1]
        grams = [b" ".join(own)] if n == 1 else map(b" ".join, zip(*(own[i : len(own) - size + 1 + i] for i in range(size)), strict=True))
        hashes = np.frombuffer(b"".join([digest(g, SEED) for g in grams]), np.uint8)
        ones += np.add.reduce(np.unpackbits(hashes.reshape(-1, 8), axis=1), axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _fingerprints(size: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint_bytes(t.as_py() or b"", size) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(found.view(np.int64))], ["doc_id", "text_hash", "fp"])

    return scan


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, text_hash, fp (the fingerprint's 64 bits as a long) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), as_bytes().alias("text"))
    return rows.mapInArrow(_fingerprints(size), "doc_id long, text_hash long, fp long")


def _masks(bits: int, blocks: int, radius: int) -> list[int]:
    """The masks of every choice of blocks - radius of the blocks of the lowest `bits` bits."""
    edges = [round(i * bits / blocks) for i in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(block, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keys(radius: int) -> tuple[list[int], dict[int, list[int]]]:
    """First masks; for each, finer masks that include it and leave at most FREE_BITS bits free."""
    first = _masks(64, radius + 3, radius)
    finer = {}
    for m in first:
        free = [i for i in range(64) if not m >> i & 1]
        blocks = next(b for b in range(radius + 1, len(free) + 1) if max(len(free) - bin(x).count("1") for x in _masks(len(free), b, radius)) <= FREE_BITS)
        finer[m] = [m | sum(1 << free[i] for i in range(len(free)) if x >> i & 1) for x in _masks(len(free), blocks, radius)]
    return first, finer


def _filed(masks: list[int], of: str) -> Column:
    """One struct for each mask: its number and the masked column."""
    return F.array(*[F.struct(F.lit(i).alias("mask"), F.col(of).bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])


def pivots() -> list[int]:
    """The reference fingerprints: zero, then each pair of neighbouring bits."""
    return [0, *(3 << i for i in range(0, 64, 2))]


def pivot_table(fp: Column) -> Column:
    """The coordinates of a fingerprint, two bits each: its ones within each pivot's pair of bits."""
    high, low = F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_LOW)), fp.bitwiseAND(F.lit(_LOW))
    return F.shiftleft(high.bitwiseAND(low), 1).bitwiseOR(high.bitwiseXOR(low))


def coordinates(fps: np.ndarray) -> np.ndarray:
    """pivot_table() of an array."""
    return fps - (fps >> np.uint64(1) & np.uint64(_LOW))


def apart(t: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The number of coordinates in which two rows of pivot tables differ."""
    z = t ^ u
    return np.bitwise_count((z | z >> np.uint64(1)) & np.uint64(_LOW))


def near(fps: np.ndarray, table: np.ndarray, zero: np.ndarray, other: tuple, radius: int) -> np.ndarray:
    """Which fingerprints lie within the radius of `other` (fingerprint, table, distance to zero); the pivots discard first."""
    out = (np.abs(zero - other[2]) <= radius) & (apart(table, other[1]) <= radius)
    at = np.flatnonzero(out)
    pick = lambda x: x[at] if np.ndim(x) else x
    out[at] = np.bitwise_count(fps[at] ^ pick(other[0])) <= radius
    return out


def bucket_forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links (at most `radius` differing bits) among distinct fingerprints.

    A breadth-first search; each step compares one fingerprint's row of the pivot table with all unvisited ones.
    """
    table, zero = coordinates(fps), np.bitwise_count(fps).astype(np.int16)
    left = np.arange(len(fps))
    out, queue = [], []
    while len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
        i = queue.pop()
        linked = near(fps[left], table[left], zero[left], (fps[i], table[i], zero[i]), radius)
        if linked.any():
            hit = left[linked]
            out += [(i, j) for j in hit]
            queue += hit.tolist()
            left = left[~linked]
    return out


def _forests(radius: int):
    """Rows come sorted by (mask, key): each run of one key is a bucket of at most BUCKET rows."""

    def pairs_of(fps: np.ndarray, runs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        size = np.diff(runs)
        two = runs[:-1][size == 2]
        a, b = fps[two], fps[two + 1]
        zero = lambda x: np.bitwise_count(x).astype(np.int16)
        ok = near(a, coordinates(a), zero(a), (b, coordinates(b), zero(b)), radius)
        yield a[ok], b[ok]
        for s, n in zip(runs[:-1][size > 2], size[size > 2], strict=True):
            own = fps[s : s + n]
            if forest := bucket_forest(own, radius):
                u, v = np.array(forest).T
                yield own[u], own[v]

    def emit(fps: np.ndarray, runs: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = list(pairs_of(fps, runs))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["u", "v"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros((3, 0), np.int64)]
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy() for c in ("mask", "key", "fp")]).astype(np.int64)
            rows = np.concatenate([*held, rows], axis=1)
            new = np.flatnonzero((rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])) + 1
            if not len(new):
                held = [rows]
                continue
            yield from emit(rows[2, : new[-1]].view(np.uint64), np.concatenate([[0], new]))
            held = [rows[:, new[-1] :]]
        rows = np.concatenate(held, axis=1)
        if rows.shape[1]:
            yield from emit(np.ascontiguousarray(rows[2]).view(np.uint64), np.array([0, rows.shape[1]]))

    return scan


def _counted(filed: DataFrame) -> DataFrame:
    """The rows of buckets of two or more, with the bucket's number of rows."""
    counts = filed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return filed.join(materialise(counts, "buckets"), ["mask", "key"])


def _links_of(buckets: DataFrame, radius: int) -> DataFrame:
    return buckets.repartition("mask", "key").sortWithinPartitions("mask", "key").mapInArrow(_forests(radius), "u long, v long")


def _bit_links(fps: DataFrame, radius: int, bucket: int) -> DataFrame:
    """Links among the members of overfull buckets, which are filed by groups of bits."""
    first, finer = _keys(radius)
    shared = _counted(fps.select("fp", F.explode(_filed(first, "fp")).alias("at")).select("at.mask", "at.key", "fp"))
    few = shared.filter(F.col("n") <= bucket).select("mask", "key", "fp")
    # the finer masks: as many rows for any input, so they are broadcast
    again = [(i, (i + 1) * 10_000 + j, _signed(x)) for i, m in enumerate(first) for j, x in enumerate(finer[m])]
    again = F.broadcast(fps.sparkSession.createDataFrame(again, "mask int, finer int, bits long"))
    many = shared.filter(F.col("n") > bucket).select("mask", "fp").join(again, "mask").select(F.col("finer").alias("mask"), F.col("fp").bitwiseAND(F.col("bits")).alias("key"), "fp")
    return _links_of(few.unionByName(many), radius)


def candidates(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """mask, key, fp and n (rows of the bucket): the fingerprints that share a bucket of pivot coordinates."""
    # a group of coordinates is twice as many bits of the table
    masks = [sum(3 << 2 * i for i in range(32) if m >> i & 1) for m in _masks(32, radius + 3, radius)]
    return _counted(fps.withColumn("table", pivot_table(F.col("fp"))).select("fp", F.explode(_filed(masks, "table")).alias("at")).select("at.mask", "at.key", "fp"))


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """u, v: links between distinct fingerprints (column fp) whose components are those of all links."""
    shared = materialise(candidates(fps, radius), "pivot-buckets")
    links = _links_of(shared.filter(F.col("n") <= bucket).select("mask", "key", "fp"), radius)
    crowded = materialise(shared.filter(F.col("n") > bucket).select("fp").distinct(), "crowded")
    return links.unionByName(_bit_links(crowded, radius, bucket))


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = RADIUS) -> DataFrame:
    """doc_id, text_hash, fp, root and component_id of every row.

    component_id is the smallest doc_id of the linked documents, root their smallest fingerprint.
    """
    marked = materialise(fingerprints(docs, size), "fingerprints")
    distinct = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints")
    roots = connected_components(fingerprint_links(distinct.select("fp"), radius))
    of = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("root"))
    of = materialise(of, "roots")
    lows = of.groupBy("root").agg(F.min("low").alias("component_id"))
    named = materialise(of.join(lows, "root").select("fp", "root", "component_id"), "components")
    return marked.join(named, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def keep_one(docs: DataFrame, size: int = 3, radius: int = RADIUS) -> DataFrame:
    """One row of docs, unchanged, for each group of linked documents: the one with the smallest doc_id.

    Of several texts with that id the one with the smallest hash stays, and of repeated rows one.
    """
    return only(docs, near_duplicates(docs, size, radius).groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("row")))


def only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """One row of docs, unchanged, for each row (doc_id and text_hash) of kept; a null id counts as the smallest long."""
    key, mark, number = (fresh(docs, c) for c in ("_key", "_hash", "_number"))
    plain = lambda c: F.coalesce(c.cast("long"), F.lit(LONG_MIN))
    kept = materialise(kept.select(plain(F.col("row.doc_id")).alias(key), F.col("row.text_hash").alias(mark)).distinct(), "kept")
    rows = docs.withColumn(key, plain(F.col("doc_id"))).withColumn(mark, F.xxhash64("text"))
    # join and window need one and the same exchange of the texts
    order = Window.partitionBy(key, mark).orderBy(*[F.col(c) for c in ("doc_id", "lang", "source", "n_chars") if c in docs.columns])
    return rows.join(kept, [key, mark], "left_semi").withColumn(number, F.row_number().over(order)).filter(F.col(number) == 1).select(*docs.columns)


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
