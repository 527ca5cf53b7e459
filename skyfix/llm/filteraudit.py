"""Filter interaction audit: what each filter removes, in every order in which the filters can be applied.

A document has a mask: bit i is set if it fails filter i. All questions about orders are questions about how
many documents of a part survive a subset S of the filters, that is, have no bit of S in their mask. So the corpus is read
once, into counts by part and mask, and the rest is arithmetic on 2^n counts for each part:

  subset-zeta transform   z[T] = sum of f[M] over all M within T, in n passes over the array (pass i adds z[T - bit i]
                          to z[T]); survivors of S are z[all - S];
  order steps             a step removes z[all - P] - z[all - P - b], with P the filters before it and b its own bit: a
                          difference between neighbouring subsets. Labelled documents are counted in arrays of
                          their own and transformed alike.

The duplicate filter (a text that a smaller doc_id has too, anywhere in the table) needs the other rows: rows are
counted by the SHA-256 of their text before anything is compared, so copies meet as one row for each part, label and
mode of failing, however many there are.

Defined cases: a null text counts as empty, a null part as ''; a null doc_id is smaller than no other, never fails as a duplicate and has no
labels; rows with equal doc_id are documents of their own, and none of them makes another a duplicate; several label rows of one
document count as one that has every mark; other columns are ignored. A part's row exists for every order
and step, zeros included; without documents there are no parts. A text is split into words by the task that
holds it.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD_GAPS = r"[\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_GAPS), "")


#: Letter: whether a (non-null) text fails.
FILTERS: dict[str, Callable[[Column], Column]] = {
    "A": lambda text: F.size(_words(text)) < 200,
    "B": lambda text: 100 * F.size(F.array_distinct(_words(text))) < 50 * F.size(_words(text)),
    "C": lambda text: 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 3 * F.length(text),
    "D": lambda text: text.rlike("[#$%&*|]"),
}
DUPLICATE = "E"
#: Name of a count of labelled documents: column of the labels whose value 1 marks them.
MARKS = {"good": "quality", "toxic": "toxic"}
#: Orders are all permutations, so filters are few.
MOST = 8


def mask_counts(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable[[Column], Column]] = FILTERS, duplicate: str = DUPLICATE, part: str = "lang", marks: dict[str, str] = MARKS) -> DataFrame:
    """part, mask, n and one count for each mark: the documents of a part that fail just the filters in the mask."""
    last = 1 << len(filters)
    text = F.coalesce("text", F.lit(""))
    mask = sum((fails(text).cast("int") * (1 << i) for i, fails in enumerate(filters.values())), F.lit(0))
    rows = docs.select("doc_id", F.coalesce(part, F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("text"), mask.alias("mask"))
    rows = rows.groupBy("doc_id", "part", "text", "mask").agg(F.count(F.lit(1)).alias("n"))
    of = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("of")).agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(m) for m, c in marks.items()))
    # a null id meets no label, and is dealt out by its text
    met = F.col("doc_id").isNotNull() & (F.coalesce("doc_id", F.xxhash64("text")) == F.col("of"))
    rows = rows.join(of, met, "left").withColumns({m: F.coalesce(m, F.lit(0)) for m in marks})
    groups = rows.groupBy("text", "part", "mask", *marks, F.col("doc_id").isNull().alias("unknown"))
    groups = groups.agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("first"))
    smallest = F.min("first.doc_id").over(Window.partitionBy("text"))
    firsts = F.when(F.col("unknown"), F.col("n")).when(F.col("first.doc_id") == F.col("smallest"), F.col("first.n")).otherwise(0)
    groups = groups.withColumn("smallest", smallest).withColumn("firsts", firsts)
    both = F.inline(F.array(F.struct(F.col("mask").alias("m"), F.col("firsts").alias("k")), F.struct((F.col("mask") + last).alias("m"), (F.col("n") - F.col("firsts")).alias("k"))))
    counts = groups.select("part", *marks, both).groupBy("part", F.col("m").alias("mask"))
    return counts.agg(F.sum("k").alias("n"), *(F.sum(F.col("k") * F.col(m)).alias(f"n_{m}") for m in marks))


def zeta(frame: DataFrame, name: str, bits: int) -> DataFrame:
    """Replaces the array `name` of 2^bits counts by their sums over all subsets of each subset."""
    for i in range(bits):
        bit = 1 << i
        frame = frame.withColumn(name, F.transform(name, _with_below(name, bit)))
    return frame


def _with_below(name: str, bit: int) -> Callable[[Column, Column], Column]:
    return lambda x, at: x + F.when(at.bitwiseAND(F.lit(bit)) != 0, F.get(F.col(name), at - bit)).otherwise(0)


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable[[Column], Column]] = FILTERS, duplicate: str = DUPLICATE, part: str = "lang", marks: dict[str, str] = MARKS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, one <mark>_lost each, shapley, for every order and step.

    kept: documents left after the step; removed: those that its filter removes here; redundant: failing its filter but removed before;
    unique_fails: failing its filter only; <mark>_lost: marked ones among the removed; shapley: its filter's removed, summed over all orders.
    """
    letters = "".join(filters) + duplicate
    n = len(letters)
    if not 1 <= n <= MOST or len(set(letters)) < n or any(len(x) != 1 for x in [*filters, duplicate]):
        raise ValueError(f"one letter for each of at most {MOST} filters")
    full, names = (1 << n) - 1, {"n": "n"} | {f"n_{m}": m for m in marks}
    entries = F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*names))))  # 2^n of them at most
    parts = mask_counts(docs, labels, filters, duplicate, part, marks).groupBy("part").agg(entries.alias("by_mask"))
    found = F.transform(F.sequence(F.lit(0), F.lit(full)), lambda m: F.try_element_at("by_mask", m))
    parts = parts.withColumn("found", found)
    arrays = {c: F.transform(F.col(f"found.{c}"), lambda x: F.coalesce(x, F.lit(0))) for c in names}
    parts = parts.select("part", *(a.alias(c) for c, a in arrays.items()))
    for c in names:
        parts = zeta(parts, c, n)
    orders = [F.lit("".join(order)) for order in permutations(letters)]
    parts = parts.withColumn("shares", F.array(*(_over_all_orders(F.col("n"), i, n) for i in range(n))))
    steps = parts.withColumn("filter_order", F.explode(F.array(*orders)))
    steps = steps.select("*", F.posexplode(F.split("filter_order", "")).alias("at", "letter"))
    bits = F.create_map(*(x for i, letter in enumerate(letters) for x in (F.lit(letter), F.lit(1 << i))))
    before = F.aggregate(F.slice(F.split("filter_order", ""), F.lit(1), F.col("at")), F.lit(0), lambda total, letter: total + F.element_at(bits, letter))
    steps = steps.withColumns({"bit": F.element_at(bits, F.col("letter")), "before": before})

    def removed(c: str) -> Column:
        return F.get(c, F.lit(full) - F.col("before")) - F.get(c, F.lit(full) - F.col("before") - F.col("bit"))

    return steps.select(
        "part",
        "filter_order",
        (F.col("at") + 1).alias("step"),
        F.get("n", F.lit(full) - F.col("before") - F.col("bit")).alias("kept"),
        removed("n").alias("removed"),
        (F.get("n", F.lit(full)) - F.get("n", F.lit(full) - F.col("bit")) - removed("n")).alias("redundant"),
        (F.get("n", F.col("bit")) - F.get("n", F.lit(0))).alias("unique_fails"),
        *(removed(f"n_{m}").alias(f"{m}_lost") for m in marks),
        F.element_at("shares", F.instr(F.lit(letters), F.col("letter"))).alias("shapley"),
    )


def _over_all_orders(z: Column, i: int, n: int) -> Column:
    """What filter i removes, summed over all orders: each subset before it stands in |P|! (n - 1 - |P|)! of them."""
    full, bit, out = (1 << n) - 1, 1 << i, F.lit(0).cast("long")
    for p in range(full + 1):
        if not p & bit:
            k = p.bit_count()
            out = out + (F.get(z, F.lit(full - p)) - F.get(z, F.lit(full - p - bit))) * (factorial(k) * factorial(n - 1 - k))
    return out
