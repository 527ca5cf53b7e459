"""Verdicts over ranked clusters, consensus of representations, fusion and re-grading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyfix.functions import scores as S

# Thresholds, caps, weights and messages.
MATCH, LOW, GAP = 0.60, 0.40, 0.06
BONUS_CAP, PENALTY_CAP = 0.20, 0.35
MESSAGES = {
    "MATCH_FOUND": "Estimated visual position recovered.",
    "LOW_CONFIDENCE": "VISUAL LOCALIZATION UNRELIABLE - low confidence.",
    "AMBIGUOUS": "Ambiguous - multiple map regions explain this frame.",
    "NO_MATCH": "No corresponding region found in the reference map.",
}


def status(any_valid: Column, best: Column, runner: Column) -> Column:
    """The verdict from the best and the second-best valid cluster's scores."""
    out = F.when(~F.coalesce(any_valid, F.lit(False)), "NO_MATCH").when(best < LOW, "NO_MATCH")
    out = out.when((best - runner < GAP) & (runner >= LOW), "AMBIGUOUS")
    return out.when(best >= MATCH, "MATCH_FOUND").otherwise("LOW_CONFIDENCE")


def decide(ranked: DataFrame, *more: Column) -> DataFrame:
    """job_id, best_cluster, score, runner_score, reason and status of every job; more: further aggregates of its clusters."""
    # one exchange: the valid clusters come first, so the best two are numbers 1 and 2
    n = F.row_number().over(Window.partitionBy("job_id").orderBy(F.coalesce("valid", F.lit(False)).desc(), "rank"))
    at = lambda i, c: F.max(F.when(F.col("valid") & (F.col("_n") == i), F.col(c)))
    partial = F.min_by("rejection", F.when(F.col("partial"), F.col("rank")))
    out = ranked.withColumn("_n", n).groupBy("job_id").agg(
        F.coalesce(partial, F.min_by("rejection", "rank"), F.lit("no_valid_homography")).alias("reason"),
        at(1, "cluster_id").alias("best_cluster"),
        at(1, "final").alias("score"),
        at(2, "final").alias("runner_score"),
        *more,
    )
    out = out.withColumn("status", status(F.col("score").isNotNull(), F.col("score"), F.col("runner_score")))
    return out.withColumn("reason", F.when(F.col("score").isNull(), F.col("reason")))


def message(of: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in MESSAGES.items() for x in kv])[of]


def accepted(of: Column) -> Column:
    return of.isin("MATCH_FOUND", "LOW_CONFIDENCE")


def normalised_weights(weights: DataFrame, key: str = "job_id") -> DataFrame:
    """Weights over their sum for each key; negative ones count 0, and all 0 gives equal shares."""
    of = Window.partitionBy(key)
    w = F.greatest(F.col("weight"), F.lit(0.0))
    total = F.sum(w).over(of)
    return weights.withColumn("weight", F.when(total > 0, w / F.nullif(total, F.lit(0.0))).otherwise(1.0 / F.count(F.lit(1)).over(of)))


def consensus(positions: DataFrame, tolerance: float | str, reference: str = "rgb") -> DataFrame:
    """job_id, max_offset, agree, participating, offsets, positions (maps), tolerance over positions (job_id, representation, x, y).

    tolerance: pixels, or the name of a column of positions that holds the job's.
    """
    ref = positions.filter(F.col("representation") == reference).select("job_id", F.col("x").alias("rx"), F.col("y").alias("ry"))
    off = F.when(F.col("representation") != reference, F.sqrt(F.pow(F.col("x") - F.col("rx"), 2) + F.pow(F.col("y") - F.col("ry"), 2)))
    joined = positions.withColumn("tolerance", _tolerance(tolerance)).join(ref, "job_id", "left").withColumn("offset", off)
    entries = lambda when, *fields: F.map_from_entries(F.array_sort(F.collect_list(F.when(when, F.struct("representation", *fields)))))
    out = joined.groupBy("job_id").agg(
        F.coalesce(F.max("offset"), F.lit(0.0)).alias("max_offset"),
        F.array_sort(F.collect_list("representation")).alias("participating"),
        entries(F.col("offset").isNotNull(), "offset").alias("offsets"),
        entries(F.col("representation").isNotNull(), F.array("x", "y").alias("at")).alias("positions"),
        F.max("tolerance").alias("tolerance"),
    )
    return out.withColumn("agree", F.col("max_offset") <= F.col("tolerance"))


def _tolerance(of: float | str) -> Column:
    return F.col(of) if isinstance(of, str) else F.lit(float(of))


def fuse(base: DataFrame, representations: DataFrame, tolerance: float | str) -> DataFrame:
    """Adjusts base (job_id, base, rgb_valid, agree) by verified auxiliary representations.

    representations: job_id, representation, geo, verified, weight, offset (from the reference, null
    if unknown). tolerance: pixels, or the name of a column of representations that holds the job's.
    Adds bonus, penalty, overall, corroborating, dissenting, aux_verified.
    """
    tol = F.greatest(_tolerance(tolerance), F.lit(1.0))
    aux = representations.filter((F.col("representation") != "rgb") & F.col("verified"))
    near = F.col("offset") <= tol
    gain = S.clamp01(1.0 - F.col("offset") / tol) * F.col("weight") * F.col("geo")
    loss = S.clamp01((F.col("offset") - tol) / tol) * F.col("weight")
    sums = aux.groupBy("job_id").agg(
        F.coalesce(F.sum(F.when(near, gain)), F.lit(0.0)).alias("_gain"),
        F.coalesce(F.sum(F.when(~near, loss)), F.lit(0.0)).alias("_loss"),
        F.array_sort(F.collect_list(F.when(near, F.col("representation")))).alias("corroborating"),
        F.array_sort(F.collect_list(F.when(~near, F.col("representation")))).alias("dissenting"),
        F.count(F.lit(1)).alias("aux_verified"),
    )
    out = base.join(sums, "job_id", "left")
    bonus = F.when(F.col("rgb_valid"), S.clamp01(F.coalesce("_gain", F.lit(0.0))) * BONUS_CAP).otherwise(F.lit(0.0))
    out = out.withColumn("bonus", bonus).withColumn("penalty", S.clamp01(F.coalesce("_loss", F.lit(0.0))) * PENALTY_CAP)
    overall = S.clamp01(S.clamp01(F.col("base")) * (1.0 + F.col("bonus") - F.col("penalty")))
    none = F.array().cast("array<string>")
    return out.withColumns({"overall": overall, "corroborating": F.coalesce("corroborating", none), "dissenting": F.coalesce("dissenting", none), "aux_verified": F.coalesce("aux_verified", F.lit(0))}).drop("_gain", "_loss")


def regrade(of: Column, overall: Column, agree: Column, corroborating: Column, aux_verified: Column, rgb_valid: Column) -> Column:
    """The verdict after fusion; agreement can promote it, disagreement or a low score demotes it."""
    promoted = (overall >= MATCH) & (aux_verified >= 1) & F.coalesce(agree, F.lit(False)) & (F.size(corroborating) > 0)
    out = F.when(~F.coalesce(rgb_valid, F.lit(False)) | of.isin("NO_MATCH", "AMBIGUOUS"), of).when(overall < LOW, "NO_MATCH")
    out = out.when((of == "MATCH_FOUND") & ((overall < MATCH) | ~F.coalesce(agree, F.lit(True))), "LOW_CONFIDENCE")
    return out.when((of == "LOW_CONFIDENCE") & promoted, "MATCH_FOUND").otherwise(of)
