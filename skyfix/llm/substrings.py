"""Substring dedup by De Bruijn compaction.

Token k-mers are the graph's edges. Of every window of `window` words only the k-mer with the
smallest hash (its minimizer) is kept as an edge: equal windows choose equal edges at equal
places, so no repeat is lost, and the edge table has about 2 / (window - k + 2) rows per word.
The path around an edge is the run of words of all consecutive windows that chose it; its
successor is the next edge of the document.

1. An edge that occurs once cannot lie in a repeat and is dropped.
2. An edge whose occurrences all lie on one path, and all have the same successor, which occurs as often
   and lies on one path too, is nonbranching. Joins of the edges with their successors and
   connected components compact such runs to one row: the head edge, the number of windows, and
   the source coordinates of the first occurrence. Every other occurrence of the head is a repeat as a whole.
3. An edge with several paths branches: equal paths are compacted to their first occurrence, and
   for these first occurrences alone the windows are read back from the text at their source
   coordinates, and each window is compared with the same window on the other paths.

Words decide: paths and windows are compared by 128-bit BLAKE2b of their words as read from the text
at the source coordinates. The k-mers' own 64-bit hashes only choose edges, so their collisions
cost time and cannot change the result.

Every aggregate is combined before its shuffle, and the joins back to the occurrences are
sort-merge joins whose skewed partitions Spark can split, so a passage that a third of all
documents share is no hot task.

Defined cases: a null text is an empty one (no words, nothing removed); texts shorter than the
window lose nothing; a null doc_id counts as the smallest id; rows that share doc_id and text are
one document and each gets that document's result; rows that share only doc_id are documents of
their own, ordered by a hash of the text. Bytes that are not UTF-8 are words like others.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfix.llm.common import LONG_MIN, as_bytes, discard, materialise
from skyfix.llm.components import connected_components
from skyfix.llm.textscan import WORDS, Chunk, chunks, mix, sliding_argmin

DEFAULT_K = 6
_EDGES = "edge long, next long, p1 long, p2 long, doc long, tie long, start long, windows int"
_COLUMNS = [c.split()[0] for c in _EDGES.split(", ")]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc, no_id, tie, text (bytes); tie tells apart the texts of one id and is 0 for an id with one text."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LONG_MIN)).alias("doc"), F.col("doc_id").isNull().alias("no_id"), F.xxhash64("text").alias("hash"), as_bytes().alias("text"))
    shared = rows.groupBy("doc").agg(F.min("hash").alias("low"), F.max("hash").alias("high")).filter("low <> high")
    shared = materialise(shared.select("doc", F.lit(True).alias("shared")), "shared-ids")
    return rows.join(shared, "doc", "left").select("doc", "no_id", F.when(F.col("shared"), F.col("hash")).otherwise(F.lit(0)).cast("long").alias("tie"), "text")


def _digests(chunk: Chunk, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two 64-bit halves of the digest of words a to b - 1, joined by single spaces, for every pair of a and b."""
    size = ends - starts
    at = np.cumsum(size) - size + np.arange(len(size))
    letters = chunk.letters()
    joined = np.full(len(letters) + len(size), 0x20, np.uint8)
    joined[np.arange(len(letters)) + np.repeat(np.arange(len(size)), size)] = letters
    blob = joined.tobytes()
    found = b"".join([blake2b(blob[i:j], digest_size=16).digest() for i, j in zip(at[a].tolist(), (at[b - 1] + size[b - 1]).tolist(), strict=True)])
    return np.frombuffer(found, "<i8").reshape(-1, 2)


def _edges(chunk: Chunk, window: int, k: int):
    """Row, first window, number of windows, edge, successor and digest of every edge of a chunk."""
    starts, ends, first = chunk.words()
    n = len(starts)
    if n < window:
        return None
    prefix = WORDS.prefix(chunk.word_hashes(starts, ends))
    at = np.arange(n - k + 1)
    kmer = WORDS.span(prefix, at, at + k) | np.uint64(1)
    chosen = sliding_argmin(kmer, window - k + 1)
    row = np.repeat(np.arange(chunk.rows), np.diff(first))[: len(chosen)]
    valid = np.arange(len(chosen)) + window <= first[row + 1]
    new = np.ones(len(chosen), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])
    a = np.flatnonzero(new & valid)
    if not len(a):
        return None
    total = np.concatenate([[0], np.cumsum(valid)])
    runs = np.append(np.flatnonzero(new), len(chosen))
    count = total[runs[np.searchsorted(runs, a, "right")]] - total[a]
    p = chosen[a]
    edge = kmer[p].view(np.int64)
    after = np.zeros(len(a), np.int64)  # no successor: 0, which no edge is
    after[:-1] = np.where(row[a[1:]] == row[a[:-1]], edge[1:], 0)
    digest = _digests(chunk, starts, ends, a, a + count - 1 + window)
    own = digest[:, 0] ^ mix((p - a).astype(np.uint64)).view(np.int64)
    return row[a], a - first[row[a]], count, edge, after, own, digest[:, 1]


def _scan_edges(window: int, k: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tie = batch.column("doc").to_numpy(), batch.column("tie").to_numpy()
            for chunk in chunks(batch.column("text")):
                if (found := _edges(chunk, window, k)) is None:
                    continue
                row, start, count, edge, after, p1, p2 = found
                at = chunk.first + row
                yield pa.RecordBatch.from_arrays([*map(pa.array, (edge, after, p1, p2, doc[at], tie[at], start, count.astype(np.int32)))], _COLUMNS)

    return scan


def _scan_kmers(window: int, k: int):
    """The edges alone, without their digests."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                starts, ends, first = chunk.words()
                if len(starts) < window:
                    continue
                prefix = WORDS.prefix(chunk.word_hashes(starts, ends))
                at = np.arange(len(starts) - k + 1)
                kmer = WORDS.span(prefix, at, at + k) | np.uint64(1)
                chosen = sliding_argmin(kmer, window - k + 1)
                row = np.repeat(np.arange(chunk.rows), np.diff(first))[: len(chosen)]
                valid = np.arange(len(chosen)) + window <= first[row + 1]
                new = np.ones(len(chosen), bool)
                new[1:] = (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(kmer[chosen[new & valid]].view(np.int64))], ["edge"])

    return scan


def _scan_windows(window: int):
    """The windows of the paths named in `paths`, read from the text at their coordinates."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tie, paths = batch.column("doc").to_numpy(), batch.column("tie").to_numpy(), batch.column("paths")
            offs = paths.offsets.to_numpy()
            begin, count, edge = (paths.values.field(i).to_numpy() for i in range(3))
            for chunk in chunks(batch.column("text")):
                starts, ends, first = chunk.words()
                lo, hi = offs[chunk.first], offs[chunk.first + chunk.rows]
                row = np.repeat(np.arange(chunk.rows), np.diff(offs[chunk.first : chunk.first + chunk.rows + 1]))
                n = count[lo:hi].astype(np.int64)
                each = np.repeat(np.arange(hi - lo), n)
                start = begin[lo:hi][each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                at = first[row[each]] + start
                digest = _digests(chunk, starts, ends, at, at + window)
                of = chunk.first + row[each]
                yield pa.RecordBatch.from_arrays([*map(pa.array, (edge[lo:hi][each], digest[:, 0], digest[:, 1], doc[of], tie[of], start))], _WINDOWS)

    return scan


_WINDOWS = ["edge", "p1", "p2", "doc", "tie", "start"]


def _first() -> Column:
    return F.min(F.struct("doc", "tie", "start"))


def _is_first() -> Column:
    return (F.col("doc") == F.col("first.doc")) & (F.col("tie") == F.col("first.tie")) & (F.col("start") == F.col("first.start"))


def _places(texts: DataFrame, window: int, k: int) -> DataFrame:
    """The edges that occur more than once, with all their occurrences."""
    if not 1 <= k <= window:
        raise ValueError("needs 1 <= k <= window")
    counts = texts.select("text").mapInArrow(_scan_kmers(window, k), "edge long").groupBy("edge").agg(F.count(F.lit(1)).alias("n"))
    repeated = materialise(counts.filter("n > 1").select("edge"), "repeated-edges")
    found = materialise(texts.select("doc", "tie", "text").mapInArrow(_scan_edges(window, k), _EDGES).join(repeated, "edge"), "places")
    discard(repeated)
    return found


def _unitigs(places: DataFrame) -> DataFrame:
    """edge (the head), windows, n and first of every compacted run; branching edges have null windows."""
    path = F.struct("p1", "p2")
    nodes = places.groupBy("edge").agg(F.count(F.lit(1)).alias("n"), F.min(path).alias("low"), F.max(path).alias("high"), F.min("next").alias("next"), F.max("next").alias("last"), F.first("windows").alias("windows"), _first().alias("first"))
    one = F.col("low") == F.col("high")
    nodes = materialise(nodes.select("edge", "n", one.alias("one"), F.when(one & (F.col("next") == F.col("last")), F.col("next")).alias("next"), "windows", "first"), "nodes")
    after = nodes.filter("one").select(F.col("edge").alias("next"), F.col("n").alias("next_n"))
    links = materialise(nodes.filter("next is not null").select("edge", "next", "n").join(after, "next").filter("n = next_n").select(F.col("edge").alias("u"), F.col("next").alias("v")), "successors")
    runs = connected_components(links)
    size = nodes.select("edge", "windows").join(runs, F.col("edge") == F.col("node")).groupBy("component").agg(F.sum("windows").alias("total"))
    heads = links.join(links.select(F.col("v").alias("u")), "u", "left_anti").select(F.col("u").alias("head"))
    heads = heads.join(runs, F.col("head") == F.col("node")).join(size, "component").select("head", "total")
    inner = links.select(F.col("v").alias("edge"))
    whole = nodes.join(inner, "edge", "left_anti").join(heads, F.col("edge") == F.col("head"), "left")
    return materialise(whole.select("edge", F.when(F.col("one"), F.coalesce("total", F.col("windows").cast("long"))).alias("windows"), "n", "first"), "unitigs")


def repeated_passages(docs: DataFrame, window: int = 20, k: int = DEFAULT_K) -> DataFrame:
    """doc_id and start (first word, from 0) of the first occurrence, n_words and n (occurrences) of every compacted run."""
    runs = _unitigs(_places(_keyed(docs), window, k)).filter("windows is not null")
    return runs.select(F.when(F.col("first.doc") != LONG_MIN, F.col("first.doc")).alias("doc_id"), F.col("first.start").alias("start"), (F.col("windows") + (window - 1)).alias("n_words"), "n")


def repeated_spans(texts: DataFrame, window: int = 20, k: int = DEFAULT_K) -> DataFrame:
    """doc, tie, start, windows of every run of windows that repeats an earlier one. texts: see _keyed().

    k is the edge length in words; a smaller one gives fewer edges and more chance branches.
    """
    places = _places(texts, window, k)
    runs = _unitigs(places)
    compact = places.drop("windows").join(runs.filter("windows is not null"), "edge").filter(~_is_first()).select("doc", "tie", "start", "windows")
    compact = materialise(compact, "compacted")
    open_ = materialise(places.join(runs.filter("windows is null").select("edge"), "edge", "left_semi"), "branches")
    discard(places, runs)
    # written, so that the join back has exchanges of its own, whose skewed partitions Spark splits
    heads = materialise(open_.groupBy("edge", "p1", "p2").agg(_first().alias("first"), F.first("windows").alias("w"), F.count(F.lit(1)).alias("n")), "heads")
    copies = open_.join(heads.filter("n > 1"), ["edge", "p1", "p2"]).filter(~_is_first()).select("doc", "tie", "start", F.col("windows").cast("long"))
    copies = materialise(copies, "copies")
    wanted = heads.select("first.doc", "first.tie", F.struct("first.start", "w", "edge").alias("path")).groupBy("doc", "tie").agg(F.collect_list("path").alias("paths"))
    schema = "edge long, p1 long, p2 long, doc long, tie long, start long"
    windows = materialise(texts.select("doc", "tie", "text").join(wanted, ["doc", "tie"]).mapInArrow(_scan_windows(window), schema), "windows")
    seen = materialise(windows.groupBy("edge", "p1", "p2").agg(_first().alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "repeated-windows")
    repeats = windows.join(seen, ["edge", "p1", "p2"]).filter(~_is_first()).select("doc", "tie", "start", F.lit(1).cast("long").alias("windows"))
    return compact.unionByName(copies).unionByName(repeats)


def _apply_spans(window: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column("text"), batch.column("spans")
            n_words, n_removed, kept = [], [], []
            for text, span in zip(texts, spans, strict=True):
                words = (text.as_py() or b"").split()
                n_words.append(len(words))
                if (marks := span.values) is not None and len(marks):
                    start, windows = (marks.field(i).to_numpy() for i in range(2))
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + windows - 1 + window, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("no_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())], ["doc", "no_id", "n_words", "n_removed", "kept"])

    return apply


def remove_repeats(docs: DataFrame, window: int = 20, k: int = DEFAULT_K) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by single spaces) of every row.

    A word goes if some window of `window` consecutive words that covers it also starts earlier:
    in a document with a smaller id, or earlier in its own.
    """
    texts = _keyed(docs)
    spans = repeated_spans(texts, window, k).groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "windows")).alias("spans"))
    joined = texts.join(spans, ["doc", "tie"], "left").select("doc", "no_id", "text", "spans")
    out = joined.mapInArrow(_apply_spans(window), "doc long, no_id boolean, n_words long, n_removed long, kept binary")
    return out.select(F.when(~F.col("no_id"), F.col("doc")).alias("doc_id"), "n_words", "n_removed", F.col("kept").cast("string").alias("kept"))
