"""Labels and small text conversions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "--"

# Wording of the rejection codes, and known shapes of frames.
REJECTIONS = {
    "too_few_matches": "Too few correspondences to solve a homography",
    "homography_failed": "RANSAC could not fit a homography",
    "insufficient_inliers": "Not enough inliers survived RANSAC",
    "non_finite_projection": "Projection produced invalid coordinates",
    "non_convex_projection": "Projected frame is not a convex quadrilateral",
    "degenerate_scale": "Transform collapses the frame",
    "implausible_scale_ratio": "Implausible area change between frame and map",
    "excessive_shear": "Excessive shear for a planar aerial view",
    "degenerate_edges": "Projected frame has degenerate edges",
    "extreme_perspective": "Extreme perspective distortion",
    "below_min_inliers": "Below the minimum inlier count",
    "below_min_inlier_ratio": "Below the minimum inlier ratio",
    "reprojection_error_too_high": "Reprojection error above threshold",
    "features_too_concentrated": "Inliers concentrated in too few grid cells",
    "no_valid_homography": "No valid homography",
}
ASPECTS = ((1.0, "1:1"), (4 / 3, "4:3"), (3 / 2, "3:2"), (16 / 9, "16:9"), (3 / 4, "3:4"), (2 / 3, "2:3"), (9 / 16, "9:16"))


def _fixed(v: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", v.cast("double"))


def _or_missing(v: Column, text: Column) -> Column:
    return F.when(v.isNull() | F.isnan(v.cast("double")), MISSING).otherwise(text)


def percent(v: Column, digits: int = 1) -> Column:
    return _or_missing(v, F.concat(_fixed(v * 100, digits), F.lit("%")))


def pixels(v: Column, digits: int = 1) -> Column:
    return _or_missing(v, F.concat(_fixed(v, digits), F.lit(" px")))


def byte_size(v: Column, largest: str = "GB") -> Column:
    """A size in the unit that leaves less than 1024 of it; nothing is told in more than `largest` (KB, MB or GB)."""
    out, units = F.when(v < 1024, F.concat(_fixed(v, 0), F.lit(" B"))), ("KB", "MB", "GB")
    last = units.index(largest) + 1
    told = lambda power: F.concat(_fixed(v / 1024**power, 1), F.lit(f" {units[power - 1]}"))
    for power in range(1, last):
        out = out.when(v < 1024 ** (power + 1), told(power))
    return _or_missing(v, out.otherwise(told(last)))


def aspect(ratio: Column) -> Column:
    out = F.when(ratio.isNull() | (ratio == 0), MISSING)
    for value, label in ASPECTS:
        out = out.when(F.abs(ratio - value) < 0.02, label)
    return out.otherwise(F.concat(_fixed(ratio, 2), F.lit(":1")))


def rejection(code: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in REJECTIONS.items() for x in kv])
    return F.when(code != "", F.coalesce(F.try_element_at(known, code), F.replace(code, F.lit("_"), F.lit(" "))))


def float_list(raw: Column) -> Column:
    """Numbers of a comma-separated text; empty parts are skipped."""
    return F.transform(F.filter(F.transform(F.split(raw, ","), lambda p: F.trim(p)), lambda p: p != ""), lambda p: p.cast("double"))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
