"""Language identification by rank-order n-gram profiles.

A text's n-grams are its letters' 1-, 2- and 3-grams within words, with a pad at either end of a
word, lower-cased. A language's profile ranks its `top` most frequent n-grams. A text is compared by
the out-of-place distance: over the text's own `top` n-grams, the sum of the differences of the two
ranks, or `top` where the profile lacks the n-gram. The nearest profile names the language.

Learning counts n-grams over all labelled texts: workers sum them per language and flush sums of
bounded size, Spark adds them up, and a window keeps each language's first `top` ranks. Only the
profiles (languages times `top` rows) reach the driver and are broadcast; a language with a third of
all rows is as many partial sums as it has tasks, not rows.

Score: (d2 - d1) / d2 of the two nearest profiles' distances, or 1 - d1 / most if only one language
was learned. Ties go to the language first by code point, n-gram ties to the smaller code.

Defined cases: a null text or one without a letter is `und` with score 0; no labelled texts make
every text `und`; rows with equal doc_id each get a row; a null doc_id hashes as ''; bytes that are not
UTF-8 are read as U+FFFD, which is no letter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyfix.llm.common import as_bytes, fold

TOP = 400
HELD_OUT = 2
UNKNOWN = "und"
PAD = 1
MASK = (1 << 21) - 1
#: Characters of text handled at once, and n-gram sums that a worker holds before it hands them on.
_CHARS, _FLUSH = 1 << 19, 1 << 20


class Grams:
    """Turns texts into n-gram occurrences; holds a table of letters."""

    def __init__(self):
        self.letter = np.zeros(0x110000, bool)
        self.known = np.zeros(0x110000, bool)

    def _letters(self, codes: np.ndarray) -> np.ndarray:
        fresh = np.unique(codes[~self.known[codes]])
        for c in fresh.tolist():
            self.letter[c] = chr(c).isalpha()
        self.known[fresh] = True
        return self.letter[codes]

    def of(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For n = 1, 2, 3: the text's number and the code of every n-gram occurrence."""
        lowered = [t.lower() for t in texts]
        sizes = np.array([len(t) + 1 for t in lowered])
        # a pad before the first text too: what a text has must not hang on the texts beside it
        codes = np.frombuffer(("\n" + "\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(self._letters(codes), codes, PAD).astype(np.int64)
        text = np.append(0, np.repeat(np.arange(len(texts), dtype=np.int64), sizes))
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != PAD) | (codes[:-1] != PAD)
        codes, text = codes[keep], text[keep]
        pad = codes == PAD
        out = [(text[~pad], codes[~pad])]
        if len(codes) < 2:
            return out
        two = (codes[:-1] << 21) | codes[1:]
        # a pad belongs to the word before it or after it, whichever the n-gram holds
        of_two = np.where(pad[:-1], text[1:], text[:-1])
        out.append((of_two, two))
        three = (two[:-1] << 21) | codes[2:]
        inner = ~pad[1:-1]
        out.append((text[1:-1][inner], three[inner]))
        return out


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def _read(column: pa.Array) -> list[str]:
    return [(t or b"").decode("utf-8", "replace") for t in column.to_pylist()]


def _batches(column: list[str]) -> Iterator[tuple[int, list[str]]]:
    first, size = 0, 0
    for i, t in enumerate(column):
        size += len(t)
        if size >= _CHARS:
            yield first, column[first : i + 1]
            first, size = i + 1, 0
    if first < len(column):
        yield first, column[first:]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams = Grams()
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def flush():
        for lang, parts in held.items():
            code, n = _merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code)), pa.array(code), pa.array(n)], ["lang", "gram", "n"])

    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for first, texts in _batches(_read(batch.column("text"))):
            own = langs[first : first + len(texts)]
            names, number = np.unique(own.astype(str), return_inverse=True)
            for text, code in grams.of(texts):
                which = number[text]
                for k, lang in enumerate(names.tolist()):
                    part = _runs(code[which == k])
                    held.setdefault(lang, []).append(part)
                    size += len(part[0])
        if size > _FLUSH:
            held = {lang: [_merged(parts)] for lang, parts in held.items()}
            size = sum(len(p[0][0]) for p in held.values())
            if size > _FLUSH // 2:
                yield from flush()
                held, size = {}, 0
    yield from flush()


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return code[first], np.add.reduceat(n, first) if len(first) else n


def learn(rows: DataFrame, top: int = TOP) -> DataFrame:
    """lang, gram, rank (from 0) of the profiles; rows has text and lang."""
    usable = rows.filter("text is not null and lang is not null").select("lang", as_bytes().alias("text"))
    sums = usable.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return sums.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("lang", "gram", (F.col("rank") - 1).alias("rank"))


class Profiles:
    """Sorted n-gram codes, and for each the languages that have it with their ranks; what a language lacks takes no room."""

    def __init__(self, rows: list[tuple[str, int, int]], top: int):
        self.top = top
        self.langs = sorted({r[0] for r in rows})
        number = {lang: i for i, lang in enumerate(self.langs)}
        lang, code, rank = (np.array(c, np.int64) for c in (([number[r[0]] for r in rows], [r[1] for r in rows], [r[2] for r in rows])))
        order = np.lexsort((lang, code))
        self.lang, self.rank, code = lang[order], rank[order], code[order]
        self.codes, first = np.unique(code, return_index=True)
        self.first = np.append(first, len(code)).astype(np.int64)

    def distances(self, text: np.ndarray, code: np.ndarray, place: np.ndarray, texts: int) -> np.ndarray:
        """A text's n-grams lie `top` places off where a language lacks them: that is the start, and each one that it has takes off the difference."""
        at = np.searchsorted(self.codes, code)
        at[at == len(self.codes)] = 0
        known = np.flatnonzero(self.codes[at] == code)
        begin, n = self.first[at[known]], np.diff(self.first)[at[known]]
        entry = np.arange(n.sum()) + np.repeat(begin - np.cumsum(n) + n, n)
        of = np.repeat(known, n)
        nearer = np.abs(self.rank[entry] - place[of]) - self.top
        found = np.bincount(text[of] * len(self.langs) + self.lang[entry], nearer, texts * len(self.langs))
        return found.reshape(texts, -1) + self.top * np.bincount(text, minlength=texts)[:, None]


def _ranked(occurrences: list[tuple[np.ndarray, np.ndarray]], texts: int, top: int):
    """Text, code and place (from 0) of each text's `top` most frequent n-grams."""
    found = []
    for code_size, (text, code) in enumerate(occurrences, 1):
        # number the characters that occur, so that text and n-gram fit 64 bits
        letters = np.unique(code & MASK) if len(code) else code
        letters = np.union1d(letters, [PAD])
        number = np.zeros(int(letters[-1]) + 1, np.int64)
        number[letters] = np.arange(len(letters))
        base = len(letters)
        if texts * base**3 >= 1 << 62:  # too many letters for that: number the n-grams
            grams, which = np.unique(code, return_inverse=True)
            key, n = _runs(text * max(len(grams), 1) + which)
            found.append((key // max(len(grams), 1), grams[key % max(len(grams), 1)] if len(key) else key, n))
            continue
        small = number[code & MASK] + base * (number[np.minimum(code >> 21 & MASK, letters[-1])] + base * number[np.minimum(code >> 42, letters[-1])])
        key, n = _runs(text * base**3 + small)
        own = key % base**3
        wide = letters[own % base] | (np.where(code_size > 1, letters[own // base % base], 0) << 21) | (np.where(code_size > 2, letters[own // base**2], 0) << 42)
        found.append((key // base**3, wide, n))
    text, code, n = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((code, -n, text))
    text, code = text[order], code[order]
    begin = np.searchsorted(text, np.arange(texts))
    place = np.arange(len(text)) - begin[text]
    keep = place < top
    return text[keep], code[keep], place[keep]


def _predict(blob):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, top = blob.value
        profiles, grams = Profiles(rows, top), Grams()
        for batch in batches:
            langs: list[str] = []
            scores: list[float] = []
            for _, texts in _batches(_read(batch.column("text"))):
                lang, score = identify(profiles, grams, texts)
                langs += lang
                scores += score
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(profiles: Profiles, grams: Grams, texts: list[str]) -> tuple[list[str], list[float]]:
    if not profiles.langs:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    text, code, place = _ranked(grams.of(texts), len(texts), profiles.top)
    size = np.bincount(text, minlength=len(texts))
    far = profiles.distances(text, code, place, len(texts))
    order = np.argsort(far, axis=1, kind="stable")
    best = np.take_along_axis(far, order, axis=1)
    if best.shape[1] > 1:
        score = (best[:, 1] - best[:, 0]) / np.maximum(best[:, 1], 1)
    else:
        score = 1 - best[:, 0] / np.maximum(size * profiles.top, 1)
    names = [profiles.langs[i] if n else UNKNOWN for i, n in zip(order[:, 0].tolist(), size.tolist(), strict=True)]
    return names, np.where(size > 0, np.clip(score, 0, 1), 0.0).tolist()


def predict(docs: DataFrame, profiles: DataFrame, top: int = TOP) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs."""
    rows = [tuple(r) for r in profiles.select("lang", "gram", "rank").collect()]
    blob = docs.sparkSession.sparkContext.broadcast((rows, top))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold() == HELD_OUT).alias("held_out"), as_bytes().alias("text"))
    return own.mapInArrow(_predict(blob), "doc_id long, held_out boolean, lang_pred string, score double")
