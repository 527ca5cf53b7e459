"""Planar geometry as Column expressions: homographies, polygons, plausibility gates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The limits of the gates.
GATES = {"min_inliers": 15, "min_ratio": 0.30, "max_error": 12.0, "min_coverage": 0.25}
GRID = 4


def project(h: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """A point under a homography of 9 entries, row by row; null where it has no image."""
    w = F.nullif(h[6] * x + h[7] * y + h[8], F.lit(0.0))
    return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w


def frame_corners(width: Column, height: Column) -> list[tuple[Column, Column]]:
    """Clockwise from the top left."""
    zero = F.lit(0.0)
    return [(zero, zero), (width.cast("double"), zero), (width.cast("double"), height.cast("double")), (zero, height.cast("double"))]


def polygon_area(points: list[tuple[Column, Column]]) -> Column:
    total = F.lit(0.0)
    for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1], strict=True):
        total = total + (x1 * y2 - x2 * y1)
    return F.abs(total) / 2


def is_convex(points: list[tuple[Column, Column]]) -> Column:
    """All turns to the same side, none straight."""
    n = len(points)
    turns = []
    for i in range(n):
        (ax, ay), (bx, by), (cx, cy) = points[i], points[(i + 1) % n], points[(i + 2) % n]
        turns.append((bx - ax) * (cy - by) - (by - ay) * (cx - bx))
    return (F.least(*turns) > 0) | (F.greatest(*turns) < 0)


def affine_parts(h: list[Column]) -> tuple[Column, Column, Column]:
    """Scale, rotation in degrees and shear of the affine part; (0, 0, 1) where a column vanishes."""
    sx, sy = F.sqrt(h[0] * h[0] + h[3] * h[3]), F.sqrt(h[1] * h[1] + h[4] * h[4])
    thin = (sx < 1e-9) | (sy < 1e-9)
    shear = F.abs(h[0] * h[1] + h[3] * h[4]) / F.when(~thin, sx * sy)
    return F.when(thin, 0.0).otherwise(F.sqrt(sx * sy)), F.when(thin, 0.0).otherwise(F.degrees(F.atan2(h[3], h[0]))), F.when(thin, 1.0).otherwise(shear)


def edges(points: list[tuple[Column, Column]]) -> list[Column]:
    return [F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1], strict=True)]


def structural_rejection(points: list[tuple[Column, Column]], scale: Column, scale_ratio: Column, shear: Column, convexity: bool = True) -> Column:
    """The first structural gate that a projected frame fails, or null."""
    flat = [c for p in points for c in p]
    finite = F.lit(True)
    for c in flat:
        finite = finite & F.coalesce(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), F.lit(False))
    e = edges(points)
    out = F.when(~finite, "non_finite_projection")
    if convexity:
        out = out.when(~is_convex(points), "non_convex_projection")
    out = out.when(scale <= 1e-3, "degenerate_scale").when(~scale_ratio.between(0.04, 25.0), "implausible_scale_ratio").when(shear > 0.7, "excessive_shear")
    out = out.when(F.least(*e) < 1e-6, "degenerate_edges")
    for a, b in ((e[0], e[2]), (e[1], e[3])):
        out = out.when(F.greatest(a, b) / F.greatest(F.least(a, b), F.lit(1e-6)) > 4.0, "extreme_perspective")
    return out


def strength_rejection(inliers: Column, ratio: Column, error: Column, coverage: Column, gates: dict = GATES) -> Column:
    """The first strength threshold that is missed, or null."""
    out = F.when(inliers < gates["min_inliers"], "below_min_inliers").when(ratio < gates["min_ratio"], "below_min_inlier_ratio")
    return out.when(error > gates["max_error"], "reprojection_error_too_high").when(coverage < gates["min_coverage"], "features_too_concentrated")


def verdict_label(structural: Column, strength: Column) -> Column:
    return F.when(structural.isNotNull(), "rejected").when(strength.isNotNull(), "partial").otherwise("verified")


def rescale(h: list[Column], query_scale: Column, target_scale: Column) -> list[Column]:
    """A homography between resized images, between their full-size images."""
    t = 1.0 / F.greatest(target_scale, F.lit(1e-9))
    q = query_scale
    return [h[0] * q * t, h[1] * q * t, h[2] * t, h[3] * q * t, h[4] * q * t, h[5] * t, h[6] * q, h[7] * q, h[8]]


def translate(h: list[Column], dx: Column, dy: Column) -> list[Column]:
    """A homography followed by a shift."""
    return [h[0] + dx * h[6], h[1] + dx * h[7], h[2] + dx * h[8], h[3] + dy * h[6], h[4] + dy * h[7], h[5] + dy * h[8], h[6], h[7], h[8]]


def clamp_pixel(v: Column, size: Column) -> Column:
    """A projected coordinate, kept within one size of the map and rounded half to even."""
    return F.rint(F.least(F.greatest(v, -size.cast("double")), 2.0 * size)).cast("int")


def grid_cell(v: Column, size: Column, grid: int = GRID) -> Column:
    """The coverage cell of a coordinate, limited to the grid."""
    return F.least(F.greatest((v / size * grid).cast("int"), F.lit(0)), F.lit(grid - 1))


def unrotate(x: Column, y: Column, k: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """A point of a frame that was turned k quarter turns, in the frame as it was (width by height)."""
    ux = F.when(k == 1, width - 1 - y).when(k == 2, width - 1 - x).when(k == 3, y).otherwise(x)
    uy = F.when(k == 1, x).when(k == 2, height - 1 - y).when(k == 3, height - 1 - x).otherwise(y)
    return ux, uy
