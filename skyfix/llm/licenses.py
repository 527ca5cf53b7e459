"""License scans: phrase places, and an exact set-similarity join of text blocks with notices.

DataFrame expressions only. Templates are of length classes: L is the least multiple of STEP that is no less than the template's
words. For each class, blocks of 2 L words start at every L-th word, so any run of up to L + 1 words lies whole in a block, however its
lines are wrapped or its paragraphs are cut, and a short notice is not put together from a long stretch. A block's token set is compared
with each template's of its class: containment is the share of the template's distinct tokens that the block has, and a pair counts
from `threshold` on. Tokens outside the class's vocabulary cannot add to a containment, so a
block is its set of vocabulary tokens, and blocks with fewer of them than any template of the class needs are dropped. The others are
ordered by global frequency (the number of such blocks of the corpus that have the token), rarest first.

A text is split into words once: the pass that finds the phrases' places also yields the blocks.

Filters, each exact for an overlap of at least o = ceil(threshold * |T|):
  length      a block needs o vocabulary tokens;
  prefix      the first |T| - o + 1 tokens of the template and the first |B| - o + 1 of the block
              have one in common;
  positional  with a common token at places i and j (from 0), the two sides' tokens before and
              after it bound the overlap: min(i, j) + 1 + min(|T| - i - 1, |B| - j - 1) >= o.
Survivors are verified. The prefix index has as many rows as the templates have tokens, so it is
broadcast; the vocabulary's counts are the only figures that reach the driver, one per token.

Defined cases: a null or empty text has no words, blocks or labels and score 0; rows with equal
doc_id and text share their result; score is 1 where a base phrase stands, else the largest
containment of a block that meets the threshold, else 0. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfix.llm.common import materialise

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# License texts and notices that the set-similarity join looks for, as words.
TEMPLATES = {
    "apache-notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "bsd-notice": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "cc-notice": "this work is licensed under the creative commons attribution 4 0 international license to view a copy of this license visit http creativecommons org licenses by 4 0 or send a letter to creative commons po box 1866 mountain view ca 94042 usa",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    "isc-notice": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "unlicense-notice": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
}

#: Separators between words, after A-Z are lower-cased.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.8
#: Words by which the length classes of templates differ.
STEP = 16


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(text), GAPS), lambda w: w != "")


def needed(tokens: int, threshold: float) -> int:
    """Smallest overlap with a containment of at least `threshold`."""
    return max(1, math.ceil(threshold * tokens - 1e-9))


def phrase_places(phrases: dict[str, str]) -> Column:
    """From the array of words w: every place of every phrase, as its first word's number (from 0) and its label."""
    found = []
    for phrase, label in phrases.items():
        parts = phrase.split(" ")
        # the last word of a phrase is the rarest: where it is missing, nothing else is looked at
        last = F.size("w") - len(parts)
        places = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), _stands(parts))
        found.append(F.when(F.array_contains("w", parts[-1]), F.transform(places, _named(label))).otherwise(F.array().cast("array<struct<at:int,label:string>>")))
    return F.concat(*found)


def _stands(parts: list[str]):
    def test(i: Column) -> Column:
        at = [F.get(F.col("w"), i + j) == part for j, part in enumerate(parts)]
        out = at[-1]
        for x in reversed(at[:-1]):
            out = out & x
        return F.coalesce(out, F.lit(False))

    return test


def _named(label: str):
    return lambda i: F.struct(i.alias("at"), F.lit(label).alias("label"))


class Templates:
    """Token sets of the templates, the least overlap that each needs, and by class (stride): vocabulary and least overlap that any needs."""

    def __init__(self, texts: dict[str, str], threshold: float):
        self.sets = {label: sorted(set(text.split())) for label, text in texts.items()}
        self.overlap = {label: needed(len(s), threshold) for label, s in self.sets.items()}
        self.stride = {label: max(STEP, -(-len(text.split()) // STEP) * STEP) for label, text in texts.items()}
        self.classes = sorted(set(self.stride.values()))
        of = lambda stride: [label for label, own in self.stride.items() if own == stride]
        self.vocabulary = {c: sorted({t for label in of(c) for t in self.sets[label]}) for c in self.classes}
        self.least = {c: min(self.overlap[label] for label in of(c)) for c in self.classes}

    def blocks(self) -> Column:
        """From the array of words w: stride and vocabulary tokens (a set) of each block that has enough of them."""
        return F.concat(*map(self._of_class, self.classes)) if self.classes else F.array().cast("array<struct<stride:int,tokens:array<string>>>")

    def _of_class(self, stride: int) -> Column:
        known = F.array(*map(F.lit, self.vocabulary[stride])).cast("array<string>")
        starts = F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(stride))
        sets = F.transform(starts, lambda i: F.array_intersect(known, F.slice("w", i + 1, 2 * stride)))
        enough = F.array_distinct(F.filter(sets, lambda b: F.size(b) >= self.least[stride]))
        return F.transform(enough, lambda b: F.struct(F.lit(stride).alias("stride"), b.alias("tokens")))


def matches(blocks: DataFrame, templates: Templates) -> DataFrame:
    """doc_id, text_hash, label, containment of each template that a block (column block) of a row meets."""
    counts = {r["t"]: r["n"] for r in blocks.select(F.explode("block.tokens").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
    vocabulary = sorted({t for s in templates.sets.values() for t in s}, key=lambda t: (counts.get(t, 0), t))
    rank = {t: i for i, t in enumerate(vocabulary)}
    ordered = {label: sorted(s, key=rank.__getitem__) for label, s in templates.sets.items()}
    index = [(t, templates.stride[label], label, i, len(s), templates.overlap[label], s) for label, s in ordered.items() for i, t in enumerate(s[: len(s) - templates.overlap[label] + 1])]
    index = blocks.sparkSession.createDataFrame(index, "token string, stride int, label string, i int, t_size int, overlap int, template array<string>")
    by_rank = F.array_intersect(F.array(*map(F.lit, vocabulary)).cast("array<string>"), "block.tokens")
    ranked = blocks.select("doc_id", "text_hash", "block.stride", by_rank.alias("block"))
    least = F.element_at(F.create_map(*(F.lit(x) for c in templates.least.items() for x in c)), F.col("stride")) if templates.classes else F.lit(1)
    prefix = F.posexplode(F.slice("block", F.lit(1), F.size("block") - least + 1)).alias("j", "token")
    probed = ranked.select("doc_id", "text_hash", "stride", "block", F.size("block").alias("b_size"), prefix)
    pairs = probed.join(F.broadcast(index), ["token", "stride"])
    pairs = pairs.filter((F.col("b_size") >= F.col("overlap")) & (F.col("j") <= F.col("b_size") - F.col("overlap")))
    bound = F.least("i", "j") + 1 + F.least(F.col("t_size") - F.col("i") - 1, F.col("b_size") - F.col("j") - 1)
    pairs = pairs.filter(bound >= F.col("overlap"))
    met = pairs.withColumn("common", F.size(F.array_intersect("block", "template"))).filter(F.col("common") >= F.col("overlap"))
    return met.groupBy("doc_id", "text_hash", "label").agg(F.max(F.col("common") / F.col("t_size")).alias("containment"))


def _split(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, w of every row; the generator keeps Spark from splitting the text again for each use of w."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.explode(F.array(words(text))).alias("w"))


def block_labels(docs: DataFrame, templates: dict[str, str], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_hash, label, containment of each template that a block of a row meets (its best block)."""
    own = Templates(templates, threshold)
    blocks = _split(docs).select("doc_id", "text_hash", F.explode(own.blocks()).alias("block"))
    return matches(materialise(blocks, "blocks"), own)


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels (array), labels (array), score of every row."""
    own = Templates(templates, threshold)
    none = F.array().cast("array<string>")
    base = _split(docs).select("doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), phrase_places(phrases).alias("found"), own.blocks().alias("blocks"))
    base = base.select(
        "doc_id",
        "text_hash",
        "n_words",
        F.size("found").cast("long").alias("n_base"),
        F.array_min("found.at").cast("long").alias("first_word"),
        F.array_max("found.at").cast("long").alias("last_word"),
        F.array_sort(F.array_distinct("found.label")).alias("base_labels"),
        "blocks",
    )
    base = materialise(base, "phrases-and-blocks")
    blocks = matches(base.filter(F.size("blocks") > 0).select("doc_id", "text_hash", F.explode("blocks").alias("block")), own).groupBy(F.col("doc_id").alias("of"), F.col("text_hash").alias("of_hash"))
    blocks = materialise(blocks.agg(F.collect_set("label").alias("more"), F.max("containment").alias("containment")), "matches")
    out = base.join(blocks, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_hash")), "left")
    labels = F.array_sort(F.array_union("base_labels", F.coalesce("more", none)))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), score.alias("score"))
