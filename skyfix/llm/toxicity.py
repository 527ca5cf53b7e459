"""Toxicity: a counterfactual-regularised linear classifier.

Features: lower-cased words and their first 4, 5 and 6 bytes, hashed; each has two channels, its
presence and the square root of its density. The SELECTED features that separate the classes best
(log-likelihood ratio of document counts) are kept. Training minimises the logistic loss, an L2
term, and `fairness` times the mean squared change of the margin when the identity terms of a
labelled text are swapped for others of their group, or, in a text without such terms, when a neutral
mention of a group is inserted between two of its sentences. Every labelled text thus has a counterfactual, and a neutral
mention of a group moves a score little whatever the sample says.

Training reads at most SAMPLE labelled rows (those with the smallest hash of their id; one text of each id), which also
bounds the broadcast of their ids, and the driver sees at most SELECTED features for each. The
fitted weights are broadcast, and every document is scored whole.

Defined cases: a null text is an empty one and gets the bias' score; rows with equal doc_id each get
a row, and one text of such an id (the one of the smallest hash) is trained on; of several labels of a doc_id the
largest counts, null labels do not; no labels, or labels of
one kind, give every text the share of toxic labels (0 without any); a null doc_id hashes as ''; bytes
that are not UTF-8 are read as U+FFFD.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfix.llm.common import as_bytes, fold, fresh, materialise, slices
from skyfix.llm.textscan import _BYTE, BYTES

HELD_OUT = 2
THRESHOLD = 0.3
#: Most labelled rows that a model is fitted on, and features that it keeps. SELECTED and the weight of the L2 term in
#: fit() have the least logistic loss of sixteen settings in cross-validation inside the training rows (sf0.1).
SAMPLE = 20_000
SELECTED = 256
PREFIXES = (4, 5, 6)

# Groups of identity terms that are swapped for one another, and neutral mentions of people, in four languages.
IDENTITY = (
    ("men", "women"),
    ("man", "woman"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "natives", "refugees"),
    ("african", "european", "american", "arab"),
    ("muslime", "christen", "juden"),
    ("männer", "frauen"),
    ("musulmans", "chrétiens", "juifs"),
    ("hommes", "femmes"),
    ("musulmanes", "cristianos", "judíos"),
    ("hombres", "mujeres"),
)
MENTIONS = (
    ("Some of them were {}.", ("men", "women", "muslims", "christians", "jews", "hindus", "immigrants", "gay", "black", "white")),
    ("Einige von ihnen waren {}.", ("Männer", "Frauen", "Muslime", "Christen", "Juden")),
    ("Certains étaient {}.", ("hommes", "femmes", "musulmans", "chrétiens", "juifs")),
    ("Algunos eran {}.", ("hombres", "mujeres", "musulmanes", "cristianos", "judíos")),
)
_GROUP = {t: g for g in IDENTITY for t in g}
_TERMS = re.compile(rf"\b(?:{'|'.join(sorted(_GROUP, key=len, reverse=True))})\b", re.IGNORECASE)
_SENTENCE = re.compile(r"(?<=[.!?])\s+")

_CHARS = 1 << 20
_KINDS = (np.arange(1, 8, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)).tolist()
_PART = np.array([chr(i).isalnum() or i >= 128 for i in range(256)])


def _words(texts: list[str]):
    """Bytes of the lower-cased texts, starts and ends of their words, and each text's first word."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    begins = np.cumsum([0, *(len(r) + 1 for r in raw)])
    step = np.diff(np.concatenate([[0], _PART[data].astype(np.int8)]))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    return data, starts, ends, np.searchsorted(starts, begins)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and hash of every feature occurrence, and the number of words of each text."""
    data, starts, ends, first = _words(texts)
    prefix = BYTES.prefix(_BYTE[data])
    n = np.diff(first)
    text = np.repeat(np.arange(len(texts)), n)
    of, code = [text], [BYTES.span(prefix, starts, ends) ^ np.uint64(_KINDS[0])]
    for kind, size in enumerate(PREFIXES, 1):
        long = ends - starts > size
        of.append(text[long])
        code.append(BYTES.span(prefix, starts[long], starts[long] + size) ^ np.uint64(_KINDS[kind]))
    return np.concatenate(of), np.concatenate(code), n


def swapped(text: str, turn: int = 1) -> str | None:
    """The text with every identity term replaced by another of its group, `turn` places on; None if it has none."""

    def other(m: re.Match) -> str:
        group = _GROUP[m[0].lower()]
        new = group[(group.index(m[0].lower()) + 1 + (turn - 1) % (len(group) - 1)) % len(group)]
        return new.upper() if m[0].isupper() and len(m[0]) > 1 else new.capitalize() if m[0][0].isupper() else new

    out = _TERMS.sub(other, text)
    return out if out != text else None


def counterfactual(text: str) -> str:
    """The text with its identity terms swapped, or with a neutral mention of a group inserted; which ones depends on the text alone."""
    pick = zlib.crc32(text.encode("utf-8", "replace"))
    if (other := swapped(text, 1 + pick % 5)) is not None:
        return other
    phrase, members = MENTIONS[pick % len(MENTIONS)]
    mention = phrase.format(members[pick // 7 % len(members)])
    sentences = _SENTENCE.split(text)
    at = pick // 77 % (len(sentences) + 1)
    return " ".join([*sentences[:at], mention, *sentences[at:]])


def _grouped(column: list[bytes | None]) -> Iterator[tuple[int, list[str]]]:
    first, size, held = 0, 0, []
    for i, t in enumerate(column):
        held.append((t or b"").decode("utf-8", "replace"))
        size += len(held[-1])
        if size >= _CHARS:
            yield first, held
            first, size, held = i + 1, 0, []
    if held:
        yield first, held


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each feature, the numbers of toxic and other texts that have it."""
    for batch in slices(batches):
        toxic = batch.column("toxic").to_numpy()
        for first, texts in _grouped(batch.column("text").to_pylist()):
            text, code, _ = features(texts)
            order = np.lexsort((text, code))
            text, code = text[order], code[order]
            once = np.concatenate([[True], (code[1:] != code[:-1]) | (text[1:] != text[:-1])]) if len(code) else np.zeros(0, bool)
            text, code = text[once], code[once]
            at = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
            if not len(at):
                continue
            bad = np.add.reduceat(toxic[first + text].astype(np.int64), at)
            every = np.diff(np.append(at, len(code)))
            yield pa.RecordBatch.from_arrays([pa.array(code[at].view(np.int64)), pa.array(bad), pa.array(every - bad)], ["feature", "bad", "good"])


class Selected:
    """Finds the kept features among occurrences: a 16-bit filter, then a search."""

    def __init__(self, codes: list[int]):
        self.codes = np.sort(np.array(codes, np.int64).view(np.uint64))
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(self.codes & np.uint64(0xFFFF)).astype(np.int64)] = True

    def count(self, texts: list[str]):
        """Text, feature number and count of each kept feature of each text; words of each text."""
        text, code, n = features(texts)
        if not len(self.codes):
            return (np.zeros(0, np.int64),) * 3 + (n,)
        maybe = self.filter[(code & np.uint64(0xFFFF)).astype(np.int64)]
        text, code = text[maybe], code[maybe]
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        hit = self.codes[at] == code
        key, count = np.unique(text[hit] * len(self.codes) + at[hit], return_counts=True)
        return key // len(self.codes), key % len(self.codes), count, n


def _density(count: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.sqrt(count / (words + 25.0))


FITTED = pa.schema([("toxic", pa.int32()), ("pair", pa.bool_()), ("feature", pa.list_(pa.int32())), ("density", pa.list_(pa.float32()))])


def _rows(blob):
    def row(selected: Selected, text: str):
        _, at, count, n = selected.count([text])
        return at.tolist(), _density(count, n[0]).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        selected = Selected(blob.value)
        for batch in slices(batches):
            out = []
            for raw, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                text = (raw or b"").decode("utf-8", "replace")
                out.append((toxic, False, *row(selected, text)))
                out.append((toxic, True, *row(selected, counterfactual(text))))  # the row after a text is its counterfactual
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), FITTED.types, strict=True)], schema=FITTED)

    return run


class Sparse:
    """Counted features of texts: one column for a feature's presence, one for its density."""

    def __init__(self, table: pa.Table, width: int):
        self.n, self.width = table.num_rows, width
        feature, density = (table.column(c).combine_chunks() for c in ("feature", "density"))
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(feature.offsets.to_numpy()))
        # flatten() heeds the offsets of a filtered table
        self.at = feature.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
        self.density = density.flatten().to_numpy(zero_copy_only=False).astype(np.float32)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.at] + 5 * self.density * w[self.at + self.width], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        own = g[self.row]
        return np.concatenate([np.bincount(self.at, own, self.width), np.bincount(self.at, 5 * self.density * own, self.width)])


def fit(rows: pa.Table | list[dict], width: int, l2: float = 1e-4, fairness: float = 1.0, rounds: int = 300, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias. rows: a text's row may be followed by its counterfactual (pair true)."""
    table = rows if isinstance(rows, pa.Table) else pa.Table.from_pylist(rows, FITTED)
    pair = table.column("pair").to_numpy().astype(bool)
    own = np.flatnonzero(~pair)
    y = table.column("toxic").to_numpy().astype(float)[own]
    share = y.mean() if len(y) else 0.0
    if not 0 < share < 1:
        return np.zeros(2 * width), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    x = Sparse(table.take(own), width)
    second = np.flatnonzero(pair)
    second = second[second > 0]
    # nearly always every text has its counterfactual, and the texts before them are x
    before = x if np.array_equal(second - 1, own) else Sparse(table.take(second - 1), width)
    after = Sparse(table.take(second), width)
    w, bias = np.zeros(2 * width + 1), float(np.log(share / (1 - share)))
    w[-1] = bias
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        off = (1 / (1 + np.exp(-np.clip(x.times(w[:-1]) + w[-1], -40, 40))) - y) / len(y)
        g = np.append(x.back(off) + l2 * w[:-1], off.sum())
        if len(second):
            change = (before.times(w[:-1]) - after.times(w[:-1])) * (2 * fairness / len(second))
            g[:-1] += before.back(change) - after.back(change)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def sample_labels(labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """doc_id, toxic of at most `bound` labelled documents outside the held-out fold."""
    own = labels.filter("doc_id is not null and toxic is not null").filter(fold() != HELD_OUT)
    own = own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    return own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, selected: int = SELECTED, fairness: float = 1.0) -> dict:
    """The fitted model: codes of the kept features, their weights, the bias."""
    sample = sample_labels(labels, bound)
    # at most `bound` ids and labels, and one text of each
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), as_bytes().alias("text")).join(F.broadcast(sample), "doc_id")
    rows = materialise(rows.groupBy("doc_id").agg(F.min_by("text", "hash").alias("text"), F.first("toxic").alias("toxic")), "labelled-texts")
    totals = rows.agg(F.sum("toxic"), F.count("toxic")).first()
    bad, good = totals[0] or 0, (totals[1] or 0) - (totals[0] or 0)
    counts = rows.mapInArrow(_class_counts, "feature long, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    seen = F.col("bad") + F.col("good")
    # log-likelihood ratio of the feature's counts against the classes' shares
    parts = [F.col(c) * F.log((F.col(c) + 0.5) / (seen * (n / max(bad + good, 1)) + 0.5)) for c, n in (("bad", bad), ("good", good))]
    best = counts.filter(seen >= 3).orderBy(F.desc(parts[0] + parts[1]), "feature").limit(selected)
    codes = sorted((r["feature"] for r in best.select("feature").collect()), key=lambda c: c % (1 << 64))
    blob = docs.sparkSession.sparkContext.broadcast(codes)
    table = rows.mapInArrow(_rows(blob), "toxic int, pair boolean, feature array<int>, density array<float>").toArrow()
    weights, bias = fit(table, len(codes), fairness=fairness)
    return {"codes": codes, "weights": weights, "bias": bias, "pairs": int(np.sum(table.column("pair").to_numpy()))}


def score_texts(model: dict, selected: Selected, texts: list[str]) -> np.ndarray:
    width = len(model["codes"])
    text, at, count, n = selected.count(texts)
    w = model["weights"]
    margin = np.bincount(text, w[at] + 5 * w[at + width] * _density(count, n[text]), len(texts)) if width else np.zeros(len(texts))
    return 1 / (1 + np.exp(-np.clip(margin + model["bias"], -40, 40)))


def _score(blob):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = blob.value
        selected = Selected(model["codes"])
        for batch in slices(batches):
            parts = [score_texts(model, selected, texts) for _, texts in _grouped(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(np.concatenate([np.zeros(0), *parts]))], ["doc_id", "held_out", "score"])

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score of every row of docs."""
    blob = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold() == HELD_OUT).alias("held_out"), as_bytes().alias("text"))
    return own.mapInArrow(_score(blob), "doc_id long, held_out boolean, score double")


def keep_clean(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, unchanged, whose score is below the threshold."""
    blob = docs.sparkSession.sparkContext.broadcast(model)
    raw = fresh(docs, "_raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = blob.value
        selected = Selected(fitted["codes"])
        for batch in slices(batches):
            parts = [score_texts(fitted, selected, texts) for _, texts in _grouped(batch.column(raw).to_pylist())]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0), *parts]) < threshold))

    # the text travels as bytes, and as bytes only
    rows = docs.withColumn(raw, as_bytes()).drop("text")
    return rows.mapInArrow(run, rows.schema).withColumn("text", F.col(raw).cast("string")).select(*docs.columns)
