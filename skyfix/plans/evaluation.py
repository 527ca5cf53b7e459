"""Accuracy metrics over evaluation items and results, training histories, run lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


NO_RESULT = "no result"
CASES = "file string, note string, expected_x double, expected_y double, expect_no_match boolean"
TRUTH = f"reference_map string, map_width int, map_height int, georeference_hint struct<north:double,south:double,west:double,east:double>, cases array<struct<{CASES.replace(' ', ':').replace(',:', ',')}>>"


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """The cases of ground-truth documents (JSON, one in a file) below path: reference_map, map_width, map_height, georeference_hint, item_id (the file's
    name) and the rest of each case. A document that is no JSON fails the read."""
    docs = spark.read.schema(TRUTH).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    rows = docs.select("reference_map", "map_width", "map_height", "georeference_hint", F.inline("cases"))
    return rows.withColumnRenamed("file", "item_id").withColumn("expect_no_match", F.coalesce("expect_no_match", F.lit(False)))


def truth_documents(cases: DataFrame, maps: DataFrame) -> DataFrame:
    """reference_map and its ground-truth document (JSON text, column value): cases (reference_map, file, note, expected_x, expected_y, expect_no_match) of maps
    (reference_map, map_width, map_height, georeference_hint), by file name. Write one with .select("value").write.text(path). Keys without a value are null."""
    entry = F.struct("file", "note", "expected_x", "expected_y", "expect_no_match")
    listed = cases.groupBy("reference_map").agg(F.array_sort(F.collect_list(entry)).alias("cases"))
    out = maps.join(listed, "reference_map", "left").withColumn("cases", F.coalesce("cases", F.array().cast(listed.schema["cases"].dataType)))
    body = F.to_json(F.struct("reference_map", "map_width", "map_height", "georeference_hint", "cases"), {"ignoreNullFields": "false"})
    return out.select("reference_map", body.alias("value"))


def score_items(items: DataFrame, results: DataFrame, tolerance: float) -> DataFrame:
    """Items (item_id, expected_x, expected_y, expect_no_match) joined to results (item_id, status, x, y).

    Adds failed (no result), error_px (1 decimal; where a position was expected and returned),
    correct (null where there is nothing to judge) and error: what a result says went wrong (its column error, if there is
    one; such a result counts as none), or that there is none.
    """
    joined = items.join(results if "error" in results.columns else results.withColumn("error", F.lit(None).cast("string")), "item_id", "left")
    wrong = F.col("error").isNotNull()
    joined = joined.withColumns({c: F.when(~wrong, F.col(c)) for c in ("status", "x", "y")}).withColumn("error", F.when(wrong, F.col("error")).when(F.col("status").isNull(), NO_RESULT))
    d = F.sqrt(F.pow(F.col("x") - F.col("expected_x"), 2) + F.pow(F.col("y") - F.col("expected_y"), 2))
    out = joined.withColumn("failed", F.col("status").isNull()).withColumn("error_px", F.when(~F.col("expect_no_match"), F.round(d, 1)))
    return out.withColumn("correct", F.when(F.col("expect_no_match"), F.col("status") == "NO_MATCH").otherwise(F.col("error_px") <= tolerance))


def batch_metrics(scored: DataFrame) -> DataFrame:
    """The online evaluator's figures, to 4 decimals; scored may have found, from top5_retrieval().

    Accuracies count over the results with an expected position (at least 1), false localizations
    over all items; the no-match rate is null where none was expected.
    """
    none = F.col("expect_no_match")
    matched = F.col("status") == "MATCH_FOUND"
    judged = F.col("error_px").isNotNull()
    found = F.col("found") if "found" in scored.columns else F.lit(False)
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    out = scored.agg(
        F.count(F.lit(1)).alias("total"),
        F.greatest(n(~F.col("failed") & ~none & F.col("expected_x").isNotNull()), F.lit(1)).alias("localizable"),
        n(judged & F.col("correct")).alias("_hits"),
        n(judged & found).alias("_found"),
        n(none & ~F.col("failed")).alias("expected_no_match"),
        n(none & F.col("correct")).alias("_none"),
        n(matched & ~F.col("correct") & (none | judged)).alias("_false"),
    )
    share = lambda a, b: F.round(F.try_divide(a, b), 4)
    return out.select(
        "total", "localizable", "expected_no_match", share(F.col("_hits"), F.col("localizable")).alias("top1"), share(F.col("_found"), F.col("localizable")).alias("top5"),
        share(F.col("_none"), F.col("expected_no_match")).alias("no_match_rate"), share(F.col("_false"), F.greatest("total", F.lit(1))).alias("false_rate"),
    )


def offline_metrics(scored: DataFrame, tolerance: float) -> DataFrame:
    """correct, evaluated, no_match_ok, no_match_total, false_localizations, passed: the offline evaluator's figures.

    It compares distances without rounding, and a missing position counts as failed.
    """
    none = F.col("expect_no_match")
    near = F.sqrt(F.pow(F.col("x") - F.col("expected_x"), 2) + F.pow(F.col("y") - F.col("expected_y"), 2)) <= tolerance
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    matched = F.col("status") == "MATCH_FOUND"
    out = scored.agg(
        n(~none & near).alias("correct"),
        n(~none).alias("evaluated"),
        n(none & (F.col("status") == "NO_MATCH")).alias("no_match_ok"),
        n(none).alias("no_match_total"),
        n(matched & (none | ~near)).alias("false_localizations"),
    )
    return out.withColumn("passed", (F.col("correct") == F.col("evaluated")) & (F.col("no_match_ok") == F.col("no_match_total")))


def top5_retrieval(items: DataFrame, candidates: DataFrame, tolerance: float) -> DataFrame:
    """item_id, found: whether any candidate tile's centre lies within tolerance plus half its longer side.

    items: item_id, expected_x, expected_y; candidates: item_id, center_x, center_y, width, height.
    All of an item's candidates count, not five.
    """
    d = F.sqrt(F.pow(F.col("center_x") - F.col("expected_x"), 2) + F.pow(F.col("center_y") - F.col("expected_y"), 2))
    near = d <= tolerance + F.greatest("width", "height") / 2
    return items.join(candidates, "item_id", "left").groupBy("item_id").agg(F.coalesce(F.max(near), F.lit(False)).alias("found"))


def epoch_means(parts: DataFrame) -> DataFrame:
    """epoch, name, value: batch-size-weighted means of loss parts (epoch, name, value, size)."""
    return parts.groupBy("epoch", "name").agg((F.sum(F.col("value") * F.col("size")) / F.nullif(F.sum("size"), F.lit(0))).alias("value"))


def checkpoints(history: DataFrame) -> DataFrame:
    """Adds best_so_far and is_best (a strict new minimum) to history (run, epoch, total)."""
    before = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    low = F.min("total").over(before)
    return history.withColumn("is_best", low.isNull() | (F.col("total") < low)).withColumn("best_so_far", F.least("total", low))


def best_epoch(history: DataFrame) -> DataFrame:
    """run, epoch of the first smallest total."""
    return history.groupBy("run").agg(F.min(F.struct("total", "epoch")).alias("m")).select("run", F.col("m.epoch").alias("epoch"), F.col("m.total").alias("total"))


def run_history(jobs: DataFrame, keep: int = 8) -> DataFrame:
    """The newest `keep` jobs."""
    return jobs.orderBy(F.desc("started"), F.desc("job_id")).limit(keep)


def pair_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """The sorted intersection of two directories' file names (split, name, path)."""
    return left.select("split", "name", F.col("path").alias("left_path")).join(right.select("split", "name", F.col("path").alias("right_path")), ["split", "name"])


def numbered(rows: DataFrame, split: str = "split", name: str = "name", parts: int = 256) -> DataFrame:
    """Adds place: each row's number (from 0) in its split by name, then by the other columns of the row.

    The names are cut into about `parts` ranges at names of a sample (which decides how even they are, not the numbers). Rows are counted
    by range, and numbered inside it from the count of those before: no split is sorted by one task. Null splits and names come first.
    """
    cuts = rows.filter(F.col(name).isNotNull()).select(name).distinct().orderBy(F.xxhash64(name), name).limit(parts).collect()
    bounds = F.array(*[F.lit(c) for c in sorted((r[0] for r in cuts), key=lambda c: c.encode())]).cast("array<string>")
    # the generator keeps the optimizer from moving the lambda into the join below
    cut = rows.select(*rows.columns, F.explode(F.array(F.size(F.filter(bounds, lambda b: b <= F.col(name))))).alias("_range"))
    counts = cut.groupBy(split, "_range").agg(F.count(F.lit(1)).alias("_n"))
    # a row for each range: as many as there are cuts, for each split
    before = Window.partitionBy(split).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(split).alias("_split"), F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(split, "_range").orderBy(name, *[c for c in rows.columns if c not in (split, name)])) - 1
    placed = cut.withColumn("_own", own).join(counts, F.col(split).eqNullSafe(F.col("_split")) & (F.col("_range") == F.col("_of")))
    return placed.select(*rows.columns, (F.col("_before") + F.col("_own")).alias("place"))


def usable_pairs(stats: DataFrame) -> DataFrame:
    """Rows whose image is not null, empty or flat, numbered in name order as six digits and more (split, name, width, height, deviation)."""
    kept = numbered(stats.filter((F.col("width") > 0) & (F.col("height") > 0) & (F.col("deviation") >= 1.0)))
    digits = F.col("place").cast("string")
    return kept.withColumn("number", F.lpad(digits, F.greatest(F.lit(6), F.length(digits)), F.lit("0"))).drop("place")


def side_by_side(width, height):
    """Whether an image holds two square halves side by side, within 4 pixels."""
    return F.abs(width - 2 * height) <= 4


def hash_split(names: DataFrame, share: float, key: str = "name") -> DataFrame:
    """Adds split: val for about `share` of the names, by the first 32 bits of their MD5. A null name counts as ''."""
    bits = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")
    return names.withColumn("split", F.when(bits % 10_000 < int(share * 10_000), "val").otherwise("train"))


def image_metrics(pixels: DataFrame) -> DataFrame:
    """image_id, mae, ssim, structure_iou over pixel rows (image_id, a, b in 0..255), rounded to 4."""
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    dark_a, dark_b = F.col("a") < 110, F.col("b") < 110
    out = pixels.groupBy("image_id").agg(
        F.avg(F.abs(F.col("a") - F.col("b"))).alias("mae"),
        F.avg("a").alias("ma"),
        F.avg("b").alias("mb"),
        F.var_pop("a").alias("va"),
        F.var_pop("b").alias("vb"),
        F.covar_pop("a", "b").alias("cab"),
        F.count_if(dark_a & dark_b).alias("i"),
        F.count_if(dark_a | dark_b).alias("u"),
    )
    ssim = ((2 * F.col("ma") * F.col("mb") + c1) * (2 * F.col("cab") + c2)) / ((F.col("ma") * F.col("ma") + F.col("mb") * F.col("mb") + c1) * (F.col("va") + F.col("vb") + c2))
    return out.select("image_id", F.round("mae", 4).alias("mae"), F.round(ssim, 4).alias("ssim"), F.round(F.coalesce(F.try_divide("i", "u"), F.lit(1.0)), 4).alias("structure_iou"))
