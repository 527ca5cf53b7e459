"""Score curves as Column expressions. A NaN score counts as 0, a null one stays as each docstring says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the score components and the thresholds of the verdict.
TILE_WEIGHTS = {"retrieval": 0.15, "inliers": 0.30, "geometry": 0.25, "coverage": 0.15, "ambiguity": 0.15}
CLUSTER_WEIGHTS = {"retrieval": 0.12, "inliers": 0.28, "geometry": 0.20, "coverage": 0.12, "consensus": 0.18, "ambiguity": 0.10}
MAX_ERROR = 12.0
UNVERIFIED_CAP = 0.35


def clamp01(v: Column) -> Column:
    """v limited to 0..1; NaN gives 0, null stays null."""
    limited = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.nanvl(v, F.lit(0.0))))
    return F.when(v.isNotNull(), limited)


def saturating(v: Column, half: float) -> Column:
    """0 at 0 and below, 0.5 at `half`, towards 1."""
    up = F.greatest(F.lit(0.0), v.cast("double"))
    return up / (up + F.lit(max(half, 1e-6)))


def retrieval(similarity: Column) -> Column:
    return clamp01((similarity - 0.30) / 0.60)


def inliers(count: Column, ratio: Column) -> Column:
    return clamp01(0.6 * saturating(count, 45.0) + 0.4 * clamp01(ratio / 0.60))


def geometry(error: Column, shear: Column, valid: Column, max_error: float = MAX_ERROR) -> Column:
    """0 where the homography is not valid or its error was not measured."""
    usable = valid & error.isNotNull() & ~F.isnan(error) & (F.abs(error) != F.lit(float("inf")))
    score = clamp01(0.75 * F.exp(-error / F.lit(max(max_error, 1e-6))) + 0.25 * clamp01(1.0 - shear / 0.7))
    return F.when(F.coalesce(usable, F.lit(False)), score).otherwise(F.lit(0.0))


def coverage(share: Column) -> Column:
    return clamp01(share / 0.60)


def consensus(support: Column) -> Column:
    return saturating(F.greatest(support - 1, F.lit(0)), 1.0)


def ambiguity(best: Column, runner_up: Column) -> Column:
    """1 where there is no runner-up."""
    return F.when(runner_up.isNull(), F.lit(1.0)).otherwise(clamp01((best - runner_up) / 0.25))


def weighted(components: dict[str, Column], weights: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for name, weight in weights.items():
        out = out + F.lit(weight) * F.coalesce(components[name], F.lit(0.0))
    return out


def geometric(inlier: Column, geo: Column, cover: Column, valid: Column) -> Column:
    """The part of a tile's score that verification alone gives."""
    raw = 0.45 * inlier + 0.35 * geo + 0.20 * cover
    return clamp01(F.when(valid, raw).otherwise(raw * 0.25))
