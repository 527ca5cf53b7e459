"""Mixing sources to target weights with hash-threshold histograms.

Targets are water-filled: sources share `share` of all tokens by weight, a target stops at `most`
times its source's size, and what is over is shared again by weight until no target is above.

A source's target is met by whole passes over it and one partial pass: the documents whose hash
lies below the source's threshold. The threshold comes from nested histograms: tokens are summed by
source and hash bucket (combined before the shuffle), the bucket that holds the budget's boundary
is found from running sums of the buckets, and that bucket alone is split again, until its buckets
are single hash values. Only the first histogram reads all rows; the rows of the boundary buckets (one in 256)
are written for the later ones. No documents are sorted, and no step sees a source's rows together: a
source with a third of all rows is one row of a histogram.

Everything is a DataFrame expression. The hash is the first 56 bits of MD5 of id and text, so reruns
agree, and rows that share an id, or have none, still have hashes of their own. Of rows that are equal in
id and text and lie on the boundary, as many are taken as the budget has room for.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a null
id hashes as the text ''; size-0 documents are taken with their hash, and count 0; a source of
size 0 has target 0; an empty table gives an empty result. mix() keeps all other columns; those of docs that
are named as its own results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyfix.llm.common import fresh, materialise

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
#: Bits of the hash that one histogram resolves, and all its bits.
BITS, HASH_BITS = 8, 56


def token_count(text: Column) -> Column:
    """Number of words (runs without ASCII white space); a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def row_hash(ident: Column, text: Column) -> Column:
    """The first HASH_BITS bits of MD5 of the id as text, a line feed and the text; nulls are empty."""
    whole = F.concat(*[F.coalesce(c.cast("string"), F.lit("")).cast("binary") for c in (ident, F.lit("\n"), text)])
    return F.conv(F.substring(F.md5(whole), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target of every source; sizes has one row for each source.

    The closed form of the repeated resharing: sources stop at their cap in ascending order of cap
    over weight, so the level of the rest follows from running sums over the sources.
    """
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(order))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = everything.orderBy("ratio", "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    # the level if exactly the sources before this one stand at their caps
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levelled = ranked.withColumn("level", level)
    free = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "rank", "level"))).over(everything)["level"]
    target = F.least(F.col("cap"), F.coalesce(free * F.col("weight"), F.col("cap")))
    return levelled.select("source", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """source, threshold, left: documents with a hash below it have `left` tokens less than the budget together.

    rows: source, size, hash. budgets: source, budget. The threshold is the largest such one, so
    the tokens of the first hash value that is not taken would pass the budget.
    """
    state = budgets.select("source", F.col("budget").cast("double").alias("budget"), F.lit(0).cast("long").alias("prefix"))
    for shift in range(HASH_BITS - BITS, -1, -BITS):
        if shift < HASH_BITS - BITS:  # at first every row is inside
            edge = state.select(F.col("source").alias("of"), "prefix")
            rows = rows.join(edge, F.col("source").eqNullSafe(F.col("of")) & (F.shiftright("hash", shift + BITS) == F.col("prefix")), "left_semi")
            if shift == HASH_BITS - 2 * BITS:
                rows = materialise(rows, "boundary-rows")
        histogram = rows.groupBy(F.col("source").alias("of"), F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("tokens"))
        running = histogram.withColumn("upto", F.sum("tokens").over(Window.partitionBy("of").orderBy("bucket")))
        joined = state.join(running, F.col("source").eqNullSafe(F.col("of")), "left")
        over = F.min(F.when(F.col("upto") > F.col("budget"), F.struct("bucket", (F.col("upto") - F.col("tokens")).alias("used"))))
        state = joined.groupBy("source").agg(over.alias("edge"), F.first("budget").alias("budget"), F.first("prefix").alias("old"), F.max("upto").alias("all"))
        used = F.coalesce("edge.used", "all", F.lit(0))
        state = state.select("source", (F.col("budget") - used).alias("budget"), F.coalesce("edge.bucket", F.shiftleft(F.col("old") + 1, BITS)).alias("prefix"))
        state = materialise(state, f"threshold-{shift}")
    return state.select("source", F.col("prefix").alias("threshold"), F.col("budget").alias("left"))


RESULTS = ("size", "source_size", "target", "copies", "taken")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """All rows of docs with size, source_size, target, copies and taken (copies times size).

    Sources by code point, null last, get the weights in turn.
    """
    own = [c for c in docs.columns if c.lower() not in RESULTS]
    hashed, part, number, before, of = (fresh(docs, c) for c in ("_hash", "_part", "_number", "_before", "_of"))
    size, mark = token_count(F.col("text")), row_hash(F.col("doc_id"), F.col("text"))
    rows = materialise(docs.select("source", size.alias("size"), mark.alias("hash")), "sizes")
    aims = materialise(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    aims = aims.withColumn("passes", passes)
    cut = thresholds(rows, aims.select("source", (F.col("target") - F.col("passes") * F.col("source_size")).alias("budget")))
    plan = aims.join(cut.withColumnRenamed("source", of), F.col("source").eqNullSafe(F.col(of))).drop("source")
    plan = materialise(plan.select(of, "source_size", "target", F.struct("passes", "threshold", "left").alias(number)), "plan")
    joined = docs.select(*own).withColumn(hashed, mark).join(plan, F.col("source").eqNullSafe(F.col(of)))
    result = lambda df, copies: df.withColumn("size", size).withColumn("copies", copies).select(*own, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    threshold, whole = F.col(f"{number}.threshold"), F.col(f"{number}.passes")
    sure = result(joined.filter(F.col(hashed) != threshold), whole + (F.col(hashed) < threshold).cast("long"))
    # equal rows on the boundary, numbered through by the partitions they lie in
    edge = materialise(joined.filter(F.col(hashed) == threshold).withColumn(part, F.spark_partition_id()), "boundary")
    counts = edge.groupBy(F.col(of), F.col(part)).agg(F.count(F.lit(1)).alias(before))
    earlier = F.coalesce(F.sum(before).over(Window.partitionBy(of).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col(of).alias(f"{of}_"), F.col(part).alias(f"{part}_"), earlier.alias(before))
    place = F.row_number().over(Window.partitionBy(of, part).orderBy(part)) + F.col(before)
    edge = edge.join(counts, F.col(of).eqNullSafe(F.col(f"{of}_")) & (F.col(part) == F.col(f"{part}_")))
    return sure.unionByName(result(edge, whole + (place * size <= F.col(f"{number}.left")).cast("long")))
