"""Personal data: e-mail addresses, IP addresses, card and phone numbers, plain or disguised, as spans of the source text.

A text passes through three transducers. Each rewrites some places and leaves the rest, and keeps for every place where it read
and wrote, so that any span of its output leads back to a span of its input:

  homoglyphs   letters of other alphabets that look like a-z, full-width and mathematical forms, other scripts' digits, spaces and dashes
               become ASCII; characters without width vanish;
  digits       runs with four spelled digits in a row (English, French, German, Spanish), and figures beside them, become figures;
               "plus" before such a run becomes "+", "dot" inside it ".";
  at and dot   [at], (dot), character references, and the bare words where an address has both, become "@" and ".".

The four patterns are looked for in the source (base spans) and in the last output. What is found there and holds a rewritten
place is mapped back and added, unless a base span covers it; an added address must end in two letters or more. A transducer that has
nothing to rewrite costs one look at the text.

Patterns are matched in time linear in the text: an address is looked for around each "@", runs are never given back.

Defined cases: a null or empty text has no spans; offsets are code points of the text (each byte that is not UTF-8 counts as one), ends are exclusive;
spans stand in the order of KINDS, then by start and end, and no span twice; rows with equal doc_id have results of their own; other columns are
ignored by scan() and kept by redact(). A text is held whole by the task that reads it, with about as much again for each layer that rewrites it.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfix.llm.common import as_bytes

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"

# Characters that look like the ASCII characters below them.
LOOKS = "аеорсухіѕјһԁԛԝАВЕКМНОРСТХІЅЈοανιΑΒΕΖΗΙΚΜΝΟΡΤΥΧ․。｡‐‑‒–—−﹣﹫"
ASCII = "aeopcyxisjhdqwABEKMHOPCTXISJoaviABEZHIKMNOPTYX...-------@"
INVISIBLE = "­​‌‍⁠﻿"
# Spelled digits, 0 to 9 in each language.
SPELLED = """
zero one two three four five six seven eight nine
zéro un deux trois quatre cinq six sept huit neuf
null eins zwei drei vier fünf sechs sieben acht neun
cero uno dos tres cuatro cinco seis siete ocho nueve
"""
DIGITS = {w: str(i) for line in SPELLED.strip().split("\n") for i, w in enumerate(line.split())} | {"oh": "0", "zwo": "2"}
DOTS = ("dot", "point", "punkt", "punto")


def _glyphs() -> dict[str, str]:
    out = dict(zip(LOOKS, ASCII, strict=True)) | dict.fromkeys(INVISIBLE, "")
    for c in map(chr, range(0x80, 0x20000)):
        form = unicodedata.decomposition(c).split(" ")
        if form[0] in ("<wide>", "<font>") and int(form[-1], 16) < 0x80:
            out[c] = chr(int(form[-1], 16))
        elif unicodedata.category(c) == "Nd":
            out.setdefault(c, str(unicodedata.decimal(c)))
        elif unicodedata.category(c) == "Zs":
            out[c] = " "
    return out


GLYPHS = _glyphs()
#: All but ASCII and the Latin letters that stand for themselves.
_GLYPH = re.compile("[^\x00-\x9f\xa1-\xac\xae-\u024f]")

_WORD = "|".join(sorted(DIGITS, key=len, reverse=True))
_DOT = "|".join(DOTS)
_EDGE = r"(?![^\W_])"
_UNIT = rf"(?:{_WORD}|[0-9]++){_EDGE}"
_GAP = rf"(?:\s{{1,2}}(?:{_DOT})\s{{1,2}}|[\s,.-]{{1,3}})"
_RUN = re.compile(rf"(?<![^\W_])(?:plus[\s-]{{1,2}})?{_UNIT}(?:{_GAP}{_UNIT}){{3,}}+", re.IGNORECASE)
_PART = re.compile(rf"({_WORD})|([0-9]++)|(plus[\s-]{{1,2}})|({_GAP})", re.IGNORECASE)
#: Bytes of a text as lower-case words, and those words that runs of spelled digits are made of.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
_IN_RUNS = frozenset(form.encode().translate(_LOWER) for w in [*DIGITS, *DOTS] for form in (w, w.upper()))
#: Spelled digits that must follow each other for a run to be one.
IN_A_ROW = 4

_AT_MARK = r"[\[({<]\s{0,2}(?:at|@|arobase|arroba)\s{0,2}[\])}>]|&#0{0,6}64;|&#x0{0,6}40;|&commat;|%40"
_DOT_MARK = rf"[\[({{<]\s{{0,2}}(?:{_DOT}|\.)\s{{0,2}}[\])}}>]|&#0{{0,6}}46;|&#x0{{0,6}}2e;|&period;"
_SOME_DOT = rf"\s{{0,2}}(?:{_DOT_MARK})\s{{0,2}}|\s{{1,2}}dot\s{{1,2}}"
_BARE_AT = rf"\s{{1,2}}at\s{{1,2}}(?=[a-z0-9-]{{1,63}}(?:{_SOME_DOT})[a-z])|\s{{1,2}}(?:arobase|arroba)\s{{1,2}}(?=[a-z0-9])|\s{{1,2}}@\s{{1,2}}(?=[a-z0-9-]{{1,63}}(?:{_SOME_DOT}|\s{{1,2}}\.\s{{1,2}})[a-z])"
_MARKS = re.compile(rf"(?P<at>(?<=[a-z0-9])(?:\s{{0,2}}(?:{_AT_MARK})\s{{0,2}}|{_BARE_AT})(?=[a-z0-9]))|(?P<dot>(?<=[a-z0-9])(?:{_SOME_DOT})(?=[a-z0-9]))|(?P<spaced>(?<=[a-z0-9])\s{{1,2}}\.\s{{1,2}}(?=[a-z]))", re.IGNORECASE)
_MAYBE_MARKED = re.compile(r"[\[({<&%](?:\s{0,2}(?:at|@|arobase|arroba|dot|point|punkt|punto|\.)\s{0,2}[\])}>]|#|commat;|period;|40)", re.IGNORECASE)
_SPACED_AT = re.compile(r"@\s")
_BARE = frozenset((b"dot", b"arobase", b"arroba"))

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOP_LEVEL = re.compile(r"\.[A-Za-z]{2,}$")


def emails(text: str) -> Iterator[tuple[int, int]]:
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(x) <= 3 and int(x or "0") <= 255 for x in (part.lstrip("0") for part in m.group().split("."))):
            yield m.span()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37 and 16 <= len(digits := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= sum(m.group().count(d) for d in "0123456789") <= 15:
            yield m.span()


DETECTORS: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = dict(zip(KINDS, (emails, ips, cards, phones), strict=True))


class Layer:
    """A text after one transducer: what it wrote, and where each rewritten place lies in output and input."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        """edits: start and end in text, and what takes their place; ascending, apart from each other."""
        out, self.starts, self.ends, self.of = [], [], [], []
        at = written = 0
        for start, end, new in edits:
            out += (text[at:start], new)
            written += start - at
            self.starts.append(written)
            written += len(new)
            self.ends.append(written)
            self.of.append((start, end))
            at = end
        self.text = "".join((*out, text[at:]))

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The span of the input that a non-empty span of the output comes from."""
        return self._place(start)[0], self._place(end - 1)[1]

    def _place(self, at: int) -> tuple[int, int]:
        i = bisect_right(self.starts, at) - 1
        if i >= 0 and at < self.ends[i]:
            return self.of[i]
        at += self.of[i][1] - self.ends[i] if i >= 0 else 0
        return at, at + 1


def _homoglyphs(text: str) -> list[tuple[int, int, str]]:
    return [] if text.isascii() else [(m.start(), m.end(), GLYPHS[m.group()]) for m in _GLYPH.finditer(text) if m.group() in GLYPHS]


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_LOWER).split()


def _spelled(text: str, words: list[bytes]) -> list[tuple[int, int, str]]:
    # a run's first and last word may hang together with signs outside ASCII, the words between cannot
    if b"\1" * (IN_A_ROW - 2) not in bytes(map(_IN_RUNS.__contains__, words)):
        return []
    out = []
    for run in _RUN.finditer(text):
        parts = [(m.start(), m.end(), m.lastindex, m.group().casefold()) for m in _PART.finditer(text, *run.span())]
        if b"\1" * IN_A_ROW not in bytes(kind == 1 for *_, kind, _ in parts if kind < 3):
            continue
        for i, (start, end, kind, part) in enumerate(parts):
            if kind == 1:
                out.append((start, end, DIGITS.get(part, part)))
            elif kind == 3:
                out.append((start, end, "+"))
            elif kind == 4 and (parts[i - 1][2] == 1 or parts[i + 1][2] == 1):
                out.append((start, end, "." if "." in part or part.strip() in DOTS else ""))
    return out


def _disguised(text: str, words: list[bytes]) -> list[tuple[int, int, str]]:
    if _BARE.isdisjoint(words) and not _MAYBE_MARKED.search(text) and not _SPACED_AT.search(text):
        return []
    out, domain = [], -1  # where the label begins that follows an "@" or a dot after it
    for m in _MARKS.finditer(text):
        linked = 0 <= domain and m.start() - domain < 64 and text[domain : m.start()].replace("-", "").isalnum()
        domain = m.end() if linked or m.lastgroup == "at" else -1
        if linked or m.lastgroup != "spaced":  # " . " is a dot only in a domain
            out.append((m.start(), m.end(), "@" if m.lastgroup == "at" else "."))
    return out


def layers(text: str) -> list[Layer]:
    """The transducers that rewrite something, in order."""
    out: list[Layer] = []
    if edits := _homoglyphs(text):
        out.append(Layer(text, edits))
        text = out[-1].text
    for transducer in (_spelled, _disguised):
        if edits := transducer(text, _words(text)):
            out.append(Layer(text, edits))
            text = out[-1].text
    return out


def find(text: str) -> list[tuple[str, int, int, bool]]:
    """kind, start, end, and whether it is a base span."""
    found = {(kind, *span): True for kind, detect in DETECTORS.items() for span in detect(text)}
    passed = layers(text)
    if passed:
        base = sorted(span for _, *span in found)
        reach = list(accumulate((end for _, end in base), max))
        normal = passed[-1].text
        for kind, detect in DETECTORS.items():
            for start, end in detect(normal):
                written = normal[start:end]
                if kind == "email" and not _TOP_LEVEL.search(written):
                    continue
                for layer in reversed(passed):
                    start, end = layer.source(start, end)
                before = bisect_right(base, [start, len(text)])
                if text[start:end] != written and not (before and reach[before - 1] >= end):
                    found.setdefault((kind, start, end), False)
    return sorted(((kind, start, end, own) for (kind, start, end), own in found.items()), key=lambda x: (KINDS.index(x[0]), *x[1:3]))


def _decoded(column: pa.Array, i: int) -> str:
    return (column[i].as_py() or b"").decode("utf-8", "replace")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
    for batch in batches:
        ids, texts = batch.columns
        spans = [[dict(zip(("kind", "start", "end", "base"), x, strict=True)) for x in find(_decoded(texts, i))] for i in range(len(texts))]
        yield pa.RecordBatch.from_arrays([ids, pa.array(spans, kind)], ["doc_id", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and the spans (SPANS) of every row."""
    return docs.select("doc_id", as_bytes().alias("text")).mapInArrow(_scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def masked(text: str) -> str:
    """The text with each span replaced by its kind in brackets; spans that overlap become one, named after the first."""
    out, at = [], 0
    for kind, start, end, _ in sorted(find(text), key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += (text[at:start], f"[{kind.upper()}]")
        at = max(at, end)
    return "".join((*out, text[at:]))


def redact(docs: DataFrame) -> DataFrame:
    """docs with the spans of their texts masked; a null text stays null, other columns stay as they are."""

    @F.arrow_udf("binary")
    def mask(column: pa.Array) -> pa.Array:
        return pa.array([masked(_decoded(column, i)).encode() if column[i].is_valid else None for i in range(len(column))], pa.binary())

    return docs.withColumn("text", mask(as_bytes()).cast("string"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
