"""Source divergence audit: how far each source's use of words lies from the other sources' and from its language's.

Terms are runs of letters (and of whatever is not ASCII), A-Z lower-cased. A language keeps the terms of at least
MIN_DOCS of its documents. A group (language, source) gives each kept term the smoothed share
p = 1 + floor(SCALE * (count + 1) / (N + V)), with N its count of kept terms and V their number; a language does so too (q).
The divergence of a group from another is the sum of floor((p - q)^2 / q) over all kept terms. All figures are whole numbers.

  counting      Arrow batches: a dictionary for each group counts words as they come and is sent off before it grows
                large; Spark adds up the parts by language, source and term;
  wide vectors  each kept term becomes one row; JVM higher-order functions fill an array with its share in each source of the language;
  contributions a generator pairs each source that has the term with every place of the array; what a pair of sources without the term
                contributes depends on the pair only, so it is added V times at the end and every contribution counts beyond it;
                partial aggregation sums them where they are made, so a pair leaves a task once.

A language's array has as many places as it has sources, and the result has a row for each pair of them. Terms are spread over tasks by
language and term; the 200 first terms of a group are ranked after each task has kept its own 200.

Defined cases: a null text, language or source counts as ''; every row is a document, equal ids included; a text of any length is
counted in pieces cut between terms; groups without kept terms have divergences too (0 if the language keeps none); ties
go by the item's UTF-8 bytes; other columns are ignored; no documents, no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyfix.llm.common import materialise

MIN_DOCS = 3
SCALE = 1_000_000_000
TOP = 200

#: Bytes outside terms become spaces; A-Z are lower-cased.
_TERM_BYTES = bytes(32 if b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if b <= 0x5A else b for b in range(256))
#: Bytes of a text that are split at once, and entries after which a task sends its counts off.
PIECE, ENTRIES = 1 << 20, 200_000


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    text, at = text.translate(_TERM_BYTES), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _rows(groups: dict[tuple[bytes, bytes], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (words, documents) in groups.items():
        if words:
            k = len(words)
            columns = [pa.array([lang] * k, pa.binary()), pa.array([source] * k, pa.binary()), pa.array(words, pa.binary()), pa.array(words.values(), pa.int64()), pa.array([documents[w] for w in words], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
    groups.clear()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}
    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i, key in enumerate(zip(langs, sources, strict=True)):
            words, documents = groups.setdefault(key, (Counter(), Counter()))
            own: set[bytes] = set()
            for piece in _pieces(batch.column(2)[i].as_py()):
                words.update(piece)
                own.update(piece)
            documents.update(own)
        if sum(len(words) for words, _ in groups.values()) > ENTRIES:
            yield from _rows(groups)
    yield from _rows(groups)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with the term)."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(c) for c in ("lang", "source", "text")))
    parts = rows.mapInArrow(_count, "lang binary, source binary, term binary, n long, docs long")
    return parts.groupBy(*(F.col(c).cast("string").alias(c) for c in ("lang", "source", "term"))).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)); 0 if there are no terms."""
    whole = F.call_function("div", (count + 1) * SCALE, total + terms)
    large = F.call_function("div", (count + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), (total + terms).cast("decimal(20,0)"))
    return F.when(terms == 0, 0).when(count < (1 << 62) // SCALE, 1 + whole).otherwise(1 + large)


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: each group's divergence from its language's other sources (part `pair`, all ranks) and
    the terms that it has more often than its language (part `term`, to rank `top`)."""
    wide = term_counts(docs).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("own"))
    wide = materialise(wide.filter(F.col("docs") >= min_docs).drop("docs"), "wide-terms")
    none = F.lit(0).cast("long")
    totals = wide.select("lang", F.inline("own")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    groups = groups.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", none).alias("n"))
    langs = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("sources"), F.sum("n").alias("lang_n"))
    langs = langs.join(wide.groupBy("lang").agg(F.count(F.lit(1)).alias("v")), "lang", "left").withColumn("v", F.coalesce("v", none))
    langs = materialise(langs.withColumn("zero", F.transform("sources", lambda s: _share(none, s["n"], F.col("v")))), "languages")
    return _pairs(langs, wide).unionByName(_terms(langs, wide, top))


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def _pairs(langs: DataFrame, wide: DataFrame) -> DataFrame:
    none = F.lit(0).cast("long")
    count = F.map_from_entries("own")
    counted = wide.join(langs, "lang").withColumn("counts", F.transform("sources.source", _looked_up(count)))
    shares = F.zip_with("sources", "counts", lambda s, c: F.struct(c.alias("c"), _share(c, s["n"], F.col("v")).alias("p")))
    placed = F.transform(F.arrays_zip(shares.alias("s"), F.col("zero").alias("z")), lambda x, at: F.struct(at.alias("at"), x["s"]["p"].alias("p"), x["z"].alias("z"), (x["s"]["c"] > 0).alias("has")))
    vectors = counted.select("lang", placed.alias("vector"))
    pairs = vectors.select("lang", "vector", F.inline(F.filter("vector", lambda x: x["has"])).alias("a", "p", "z", "has"))
    pairs = pairs.select("lang", "a", "p", "z", F.inline("vector").alias("b", "p_b", "z_b", "has_b")).filter("a != b")
    toward = _distance(F.col("p"), F.col("p_b")) - _distance(F.col("z"), F.col("z_b"))
    back = F.when(~F.col("has_b"), _distance(F.col("p_b"), F.col("p")) - _distance(F.col("z_b"), F.col("z"))).otherwise(0)  # else b tells it
    sums = pairs.groupBy("lang", "a", "b").agg(F.sum(toward).alias("toward"), F.sum(back).alias("back"))
    more = sums.select("lang", F.inline(F.array(F.struct("a", "b", F.col("toward").alias("more")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("back").alias("more")))))
    more = more.groupBy("lang", "a", "b").agg(F.sum("more").alias("more"))
    first = langs.select("lang", "v", "zero", "sources", F.posexplode("sources").alias("a", "own"))
    every = first.select("lang", "v", "zero", "a", "own", F.posexplode("sources").alias("b", "other")).filter("a != b")
    value = F.when(F.col("v") > 0, F.col("v") * _distance(F.get("zero", "a"), F.get("zero", "b"))).otherwise(none) + F.coalesce("more", none)
    rows = every.join(more, ["lang", "a", "b"], "left")
    return _ranked(rows.select("lang", F.col("own.source").alias("source"), F.lit("pair").alias("part"), F.col("other.source").alias("item"), value.alias("value")))


def _looked_up(counts: Column):
    return lambda source: F.coalesce(F.try_element_at(counts, source), F.lit(0).cast("long"))


def _terms(langs: DataFrame, wide: DataFrame, top: int) -> DataFrame:
    total = F.aggregate("own.n", F.lit(0).cast("long"), lambda x, n: x + n)
    rows = wide.join(langs.select("lang", "lang_n", "v", F.map_from_entries("sources").alias("of")), "lang")
    rows = rows.select("lang", "term", "v", "of", _share(total, F.col("lang_n"), F.col("v")).alias("q"), F.inline("own"))
    rows = rows.withColumn("p", _share(F.col("n"), F.element_at("of", F.col("source")), F.col("v"))).filter("p > q")
    rows = rows.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _distance(F.col("p"), F.col("q")).alias("value"))
    return _ranked(rows).filter(F.col("rank") <= top)
