"""Descriptor matching and homography estimation."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

RATIO = 0.78
MIN_MATCHES = 8
#: Numbers and rows that a block of one side holds at most, numbers that are worked on at once, and a square below which products do not overflow.
BLOCK, BLOCK_ROWS, _CELL, _SAFE = 1 << 20, 1 << 14, 1 << 23, 1e300


def _contenders(q: np.ndarray, t: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, target) among which each query's two nearest are, slice by slice.

    Matrix products give the squared distances but for rounding, so whatever lies within its bound of the second nearest is a contender.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        own, far = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", t, t)
        odd, always = ~(far < _SAFE), ~(own < _SAFE)
        slack = 16 * (q.shape[1] + 8) * np.finfo(float).eps * (own + far[~odd].max(initial=0.0)) + 1 / _SAFE
        left = np.column_stack([-2 * q, np.ones(len(q))])
        right = np.column_stack([np.where(odd[:, None], 0.0, t), np.where(odd, np.inf, far)]).T
        rows = max(1, (_CELL >> 3) // len(t))
        for i in range(0, len(q), rows):
            d = left[i : i + rows] @ right
            at, near = np.arange(len(d)), d.argmin(axis=1)
            least = d[at, near]
            d[at, near] = np.inf
            limit = d.min(axis=1) + slack[i : i + rows]
            d[at, near] = least
            some = ~(d > limit[:, None])
            some[:, odd] = some[always[i : i + rows]] = True
            of, to = np.divmod(np.flatnonzero(some), len(t))
            yield of + i, to


def _two_nearest(key: tuple, queries: pd.DataFrame, targets: pd.DataFrame) -> pd.DataFrame:
    """Of each query of a cell the two nearest targets of the cell, ties by id."""
    if queries.empty or targets.empty:
        return pd.DataFrame({"group": [], "query_id": [], "target_id": [], "d": []})
    targets = targets.sort_values("_id")
    q, t = (np.stack(side["_vector"]).astype(float) for side in (queries, targets))
    pairs, found = max(1, _CELL // max(q.shape[1], 1)), []
    for of, to in _contenders(q, t):
        far = np.concatenate([np.sqrt(((q[of[i : i + pairs]] - t[to[i : i + pairs]]) ** 2).sum(axis=1)) for i in range(0, len(of), pairs)] or [np.empty(0)])
        order = np.lexsort((to, far, of))
        order = order[np.isfinite(far[order])]
        third = np.zeros(len(order), bool)
        third[2:] = of[order[2:]] == of[order[:-2]]
        order = order[~third]
        found.append((of[order], to[order], far[order]))
    of, to, far = (np.concatenate(part) for part in zip(*found, strict=True))
    return pd.DataFrame({"group": key[0], "query_id": queries["_id"].to_numpy()[of], "target_id": targets["_id"].to_numpy()[to], "d": far})


def knn_ratio_match(queries: DataFrame, targets: DataFrame, ratio: float = RATIO, block: int | None = None) -> DataFrame:
    """group, query_id, target_id, confidence: nearest targets that pass the ratio test (strictly).

    Both sides: group (one candidate's two images), id, descriptor. Exact, by L2, ties by id; a set with fewer than
    two descriptors matches nothing. Each side of a group is dealt to blocks of about `block` rows (by default as many as
    hold BLOCK numbers), and every pair of blocks is one task's cell, which two rows of each query leave: no group is held
    whole. A row is shuffled once for each block of the other side, and all pairs are compared, by matrix products. A null group or descriptor is no row, a distance that is not finite
    none, and only descriptors of one length are compared.
    """
    key = ["group", "_width"]
    q, t = (side.filter("group is not null and descriptor is not null").select("group", "id", "descriptor", F.size("descriptor").alias("_width")) for side in (queries, targets))
    count = lambda side, name: side.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    sizes = count(q, "_q").join(count(t, "_t"), key).filter("_q >= 2 and _t >= 2")
    most = F.lit(block) if block else F.least(F.lit(BLOCK_ROWS), F.greatest(F.lit(1), F.floor(BLOCK / F.greatest("_width", F.lit(1)))))
    sizes = sizes.select(*key, *[F.ceil(F.col(c) / most).cast("int").alias(c) for c in ("_q", "_t")])

    def cells(side: DataFrame, own: str, other: str) -> DataFrame:
        rows = side.join(sizes, key).withColumn(f"{own}_at", F.pmod(F.xxhash64("id"), F.col(own)).cast("int"))
        rows = rows.withColumn(f"{other}_at", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        # new names, as both sides may come from one table
        names = {"group": "_group", "_width": "_size", "_q_at": "_row", "_t_at": "_column", "id": "_id", "descriptor": "_vector"}
        return rows.select(*[F.col(old).alias(new) for old, new in names.items()]).groupBy("_group", "_size", "_row", "_column")

    fields = [("group", q.schema["group"].dataType), ("query_id", q.schema["id"].dataType), ("target_id", t.schema["id"].dataType), ("d", DoubleType())]
    pairs = cells(q, "_q", "_t").cogroup(cells(t, "_t", "_q")).applyInPandas(_two_nearest, StructType([StructField(*f) for f in fields]))
    two = F.row_number().over(Window.partitionBy("group", "query_id").orderBy("d", "target_id"))
    near = pairs.withColumn("_n", two).filter("_n <= 2").groupBy("group", "query_id")
    near = near.agg(F.min_by("target_id", "_n").alias("target_id"), F.min_by("d", "_n").alias("d1"), F.max_by("d", "_n").alias("d2"), F.count(F.lit(1)).alias("_c"))
    passed = near.filter((F.col("_c") == 2) & (F.col("d1") < ratio * F.col("d2")))
    return passed.select("group", "query_id", "target_id", (1 - F.col("d1") / F.greatest("d2", F.lit(1e-6))).alias("confidence"))


def dispatch(counts: DataFrame) -> DataFrame:
    """Adds backend: the learned matcher if it ran and found enough, else whichever found more.

    counts: learned (null where it failed) and classical, the two matchers' numbers of matches.
    """
    learned = F.col("learned")
    keep = (learned >= MIN_MATCHES) | (learned.isNotNull() & (F.col("classical") <= learned))
    return counts.withColumn("backend", F.when(keep, "learned").otherwise("classical"))


# ---------------------------------------------------------------- robust homography


def _unit(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sets of points (sets, points, 2) moved and scaled for conditioning, and the transforms that did it."""
    mean = p.mean(axis=1, keepdims=True)
    spread = np.sqrt(((p - mean) ** 2).sum(axis=2)).mean(axis=1)
    s = np.sqrt(2) / np.maximum(spread, 1e-12)
    move = np.zeros((len(p), 3, 3))
    move[:, 0, 0] = move[:, 1, 1] = s
    move[:, :2, 2] = -s[:, None] * mean[:, 0]
    move[:, 2, 2] = 1
    return (p - mean) * s[:, None, None], move


def solve_homographies(q: np.ndarray, t: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Least-squares direct linear transforms of many sets (sets, points, 2) at once; NaN where the points do not fix one. weights: sets, points."""
    (a, ta), (b, tb) = _unit(q), _unit(t)
    x, y, u, v = a[..., 0], a[..., 1], b[..., 0], b[..., 1]
    one, nil = np.ones_like(x), np.zeros_like(x)
    rows = np.concatenate([np.stack([x, y, one, nil, nil, nil, -u * x, -u * y, -u], 2), np.stack([nil, nil, nil, x, y, one, -v * x, -v * y, -v], 2)], axis=1)
    if weights is not None:
        rows = rows * np.sqrt(np.concatenate([weights, weights], axis=1))[:, :, None]
    out = np.full((len(q), 3, 3), np.nan)
    good = np.flatnonzero(np.isfinite(rows).all(axis=(1, 2)))
    # four points give eight rows, whose null space only the full factors hold
    _, s, vt = np.linalg.svd(rows[good], full_matrices=rows.shape[1] < 9)
    fixed = s[:, 7] >= 1e-10
    good = good[fixed]
    h = np.linalg.inv(tb[good]) @ vt[fixed][:, -1].reshape(-1, 3, 3) @ ta[good]
    usable = np.abs(h[:, 2, 2]) > 1e-12
    out[good[usable]] = h[usable] / h[usable, 2, 2][:, None, None]
    return out


def solve_homography(q: np.ndarray, t: np.ndarray) -> np.ndarray | None:
    """The transform of one set of points, or None."""
    h = solve_homographies(q[None], t[None])[0]
    return None if np.isnan(h).any() else h


def transfer_errors(h: np.ndarray, q: np.ndarray, t: np.ndarray) -> np.ndarray:
    """How far h, or each of several, takes every point from its target."""
    p = np.column_stack([q, np.ones(len(q))]) @ np.swapaxes(h, -1, -2)
    with np.errstate(divide="ignore", invalid="ignore"):
        e = np.sqrt(((p[..., :2] / p[..., 2:] - t) ** 2).sum(axis=-1))
    return np.where(np.isfinite(e), e, np.inf)


#: Standard deviations within which a point supports a transform, and places of the table of support.
REACH, _PLACES = 3.64, 2048


def _gamma(x: float) -> float:
    """The upper incomplete gamma function of 3/2."""
    return 0.5 * math.sqrt(math.pi) * math.erfc(math.sqrt(x)) + math.sqrt(x) * math.exp(-x)


_SUPPORT = np.array([_gamma((REACH * i / _PLACES) ** 2 / 2) for i in range(_PLACES + 1)])
_SUPPORT = (_SUPPORT - _SUPPORT[-1]) / (_SUPPORT[0] - _SUPPORT[-1])


def support(errors: np.ndarray, threshold: float) -> np.ndarray:
    """How well points with these errors fit: 1 at 0, falling to 0 at the threshold and beyond.

    The noise is not known, only that it is at most threshold / REACH, so the likelihood of an error is averaged over all levels up to that (a
    residual of four numbers; the average is an incomplete gamma function).
    """
    return np.interp(np.minimum(errors / threshold, 1.0), np.linspace(0, 1, _PLACES + 1), _SUPPORT)


def _fours(n: int, rounds: int, seed: int) -> np.ndarray:
    """Random fours of n places, or each of them once where there are no more than `rounds`."""
    draw = np.random.default_rng(seed)
    every = comb(n, 4) <= rounds
    return np.array(list(combinations(range(n), 4)) if every else [draw.choice(n, 4, replace=False) for _ in range(rounds)])


def marginal_consensus(q: np.ndarray, t: np.ndarray, threshold: float, seed: int, rounds: int = 1000) -> tuple[np.ndarray | None, np.ndarray]:
    """The homography with the most support over random fours, refined by least squares that weigh each point by its support.

    Points within the threshold of the result are inliers.
    """
    found = solve_homographies(q[fours := _fours(len(q), rounds, seed)], t[fours])
    found = found[~np.isnan(found).any(axis=(1, 2))]
    if not len(found):
        return None, np.zeros(len(q), bool)
    step = max(1, _CELL // (4 * len(q)))
    held = np.concatenate([support(transfer_errors(found[i : i + step], q, t), threshold).sum(axis=1) for i in range(0, len(found), step)])
    best, most = found[held.argmax()], held.max()
    for _ in range(10):
        w = support(transfer_errors(best, q, t), threshold)
        if (w > 0).sum() < 4 or np.isnan(h := solve_homographies(q[None], t[None], w[None])[0]).any():
            break
        if (now := support(transfer_errors(h, q, t), threshold).sum()) <= most:
            break
        best, most = h, now
    return best, transfer_errors(best, q, t) <= threshold


def ransac(q: np.ndarray, t: np.ndarray, threshold: float, seed: int, rounds: int = 500) -> tuple[np.ndarray | None, np.ndarray]:
    """The homography with the least truncated error over random fours, refined on its inliers.

    Where there are no more than `rounds` fours, each is tried once.
    """
    found = solve_homographies(q[fours := _fours(len(q), rounds, seed)], t[fours])
    found = found[~np.isnan(found).any(axis=(1, 2))]
    if not len(found):
        return None, np.zeros(len(q), bool)
    step = max(1, _CELL // (4 * len(q)))
    cost = np.concatenate([np.minimum(transfer_errors(found[i : i + step], q, t), threshold).sum(axis=1) for i in range(0, len(found), step)])
    best = found[cost.argmin()]
    for _ in range(5):
        inside = transfer_errors(best, q, t) <= threshold
        if inside.sum() < 4 or (h := solve_homography(q[inside], t[inside])) is None or (transfer_errors(h, q, t) <= threshold).sum() < inside.sum():
            break
        best = h
    return best, transfer_errors(best, q, t) <= threshold


HOMOGRAPHY = "group long, raw_matches int, inliers int, ratio double, error double, error_median double, error_p90 double, cells int, coverage double, h array<double>, rejection string"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "string": pa.string()}
_HOMOGRAPHY = pa.schema([(part.split(" ")[0], _KINDS[part.split(" ")[1]]) for part in HOMOGRAPHY.split(", ")])


def verified(q: np.ndarray, t: np.ndarray, frame_w: float, frame_h: float, seed: int, threshold: float = 7.5, grid: int = 4) -> dict:
    """The columns of HOMOGRAPHY but group: marginal consensus, and truncated RANSAC where that finds nothing."""
    order = np.lexsort((t[:, 1], t[:, 0], q[:, 1], q[:, 0]))
    q, t = q[order], t[order]
    out = {"raw_matches": len(q), "inliers": 0, "ratio": 0.0, "error": None, "error_median": None, "error_p90": None, "cells": 0, "coverage": 0.0, "h": None, "rejection": None}
    if len(q) < 4:
        return out | {"rejection": "too_few_matches"}
    h, inside = marginal_consensus(q, t, threshold, seed)
    if h is None:
        h, inside = ransac(q, t, threshold, seed)
    if h is None:
        return out | {"rejection": "homography_failed"}
    out |= {"h": h.ravel().tolist(), "inliers": int(inside.sum()), "ratio": float(inside.sum() / len(q))}
    if out["inliers"] < 4:
        return out | {"rejection": "insufficient_inliers"}
    e = transfer_errors(h, q[inside], t[inside])
    cells = {tuple(c) for c in np.clip((q[inside] / [frame_w, frame_h] * grid).astype(int), 0, grid - 1).tolist()}
    return out | {"error": float(e.mean()), "error_median": float(np.median(e)), "error_p90": float(np.percentile(e, 90)), "cells": len(cells), "coverage": len(cells) / grid**2}


def verified_alike(q: np.ndarray, t: np.ndarray, frame_w: float, frame_h: float, threshold: float = 7.5, grid: int = 4, rounds: int = 1000) -> list[dict]:
    """verified() of many groups of one size (groups, points, 2), all at once, where every four of a group is tried and no seed is needed."""
    groups, n = q.shape[:2]
    fours = _fours(n, rounds, 0)
    step = max(1, (_CELL >> 8) // len(fours))
    if groups > step:
        return [r for i in range(0, groups, step) for r in verified_alike(q[i : i + step], t[i : i + step], frame_w, frame_h, threshold, grid, rounds)]
    order = np.lexsort((t[..., 1], t[..., 0], q[..., 1], q[..., 0]), axis=-1)[..., None]
    q, t = np.take_along_axis(q, order, 1), np.take_along_axis(t, order, 1)
    ones = np.concatenate([q, np.ones((groups, n, 1))], axis=2)

    def errors(h: np.ndarray, of: np.ndarray) -> np.ndarray:
        p = ones[of, None] @ np.swapaxes(h, -1, -2)
        with np.errstate(divide="ignore", invalid="ignore"):
            e = np.sqrt(((p[..., :2] / p[..., 2:] - t[of, None]) ** 2).sum(axis=-1))
        return np.where(np.isfinite(e), e, np.inf)

    every = np.arange(groups)
    found = solve_homographies(q[:, fours].reshape(-1, 4, 2), t[:, fours].reshape(-1, 4, 2)).reshape(groups, -1, 3, 3)
    held = np.where(np.isnan(found).any(axis=(2, 3)), -1.0, support(errors(found, every), threshold).sum(axis=2))
    best, most = found[every, held.argmax(axis=1)], held.max(axis=1)
    open_ = np.flatnonzero(most >= 0)
    for _ in range(10):
        w = support(errors(best[open_, None], open_)[:, 0], threshold)
        open_, w = open_[(some := (w > 0).sum(axis=1) >= 4)], w[some]
        if not len(open_):
            break
        h = solve_homographies(q[open_], t[open_], w)
        now = np.where(np.isnan(h).any(axis=(1, 2)), -1.0, support(errors(h[:, None], open_)[:, 0], threshold).sum(axis=1))
        better = now > most[open_]
        open_ = open_[better]
        best[open_], most[open_] = h[better], now[better]
    out = {"raw_matches": n, "inliers": 0, "ratio": 0.0, "error": None, "error_median": None, "error_p90": None, "cells": 0, "coverage": 0.0, "h": None, "rejection": None}
    e = errors(best[:, None], every)[:, 0]
    inside = (e <= threshold) & (most >= 0)[:, None]
    number, ranked = inside.sum(axis=1), np.sort(np.where(inside, e, np.inf), axis=1)

    def quantile(share: float) -> np.ndarray:
        at = share * np.maximum(number - 1, 0)
        low = np.floor(at).astype(int)
        a, b = ranked[every, low], ranked[every, np.minimum(low + 1, np.maximum(number - 1, 0))]
        return a + (b - a) * (at - low)

    with np.errstate(invalid="ignore"):
        figures = np.stack([np.where(inside, e, 0.0).sum(axis=1) / np.maximum(number, 1), quantile(0.5), quantile(0.9)], axis=1).tolist()
    cell = np.clip((np.where(inside[..., None], q, 0.0) / [frame_w, frame_h] * grid).astype(int), 0, grid - 1)
    met = np.zeros((groups, grid * grid), bool)
    of, point = np.nonzero(inside)
    met[of, (cell[..., 0] * grid + cell[..., 1])[of, point]] = True
    rows, flat, number, cells = [], best.reshape(groups, 9).tolist(), number.tolist(), met.sum(axis=1).tolist()
    for i in range(groups):
        if most[i] < 0:  # the rarer way
            rows.append(verified(q[i], t[i], frame_w, frame_h, 0, threshold, grid))
            continue
        row = out | {"h": flat[i], "inliers": number[i], "ratio": number[i] / n}
        error, median, p90 = figures[i]
        rows.append(row | ({"rejection": "insufficient_inliers"} if number[i] < 4 else {"error": error, "error_median": median, "error_p90": p90, "cells": cells[i], "coverage": cells[i] / grid**2}))
    return rows


def estimate_homographies(matches: DataFrame, frame_w: float, frame_h: float, threshold: float = 7.5, grid: int = 4) -> DataFrame:
    """One row for each group of correspondences (group, qx, qy, tx, ty).

    A group is one candidate's matches, bounded by the keypoint cap of extraction, so it is one row with a list. Groups so small that every four
    is tried are solved together, by size; a larger one is solved from a seed of its own, so retries give the same result.
    """

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column("group").to_pylist(), batch.column("points")
            ends, flat = np.diff(lists.offsets.to_numpy()), lists.flatten()
            points = np.stack([flat.field(i).to_numpy(zero_copy_only=False).astype(float) for i in range(4)], axis=1)
            first, rows = np.concatenate([[0], np.cumsum(ends)[:-1]]).astype(int), [None] * len(ids)
            for n in np.unique(ends):
                own = np.flatnonzero(ends == n)
                if 4 <= n and comb(int(n), 4) <= 500:  # as many as the truncated RANSAC tries
                    at = points[first[own][:, None] + np.arange(n)]
                    found = verified_alike(at[..., :2], at[..., 2:], frame_w, frame_h, threshold, grid)
                else:
                    found = [verified(p[:, :2], p[:, 2:], frame_w, frame_h, abs(int(ids[i] or 0)), threshold, grid) for i in own for p in [points[first[i] : first[i] + n]]]
                for i, row in zip(own, found, strict=True):
                    rows[i] = {"group": ids[i]} | row
            yield pa.RecordBatch.from_pylist(rows, schema=_HOMOGRAPHY)

    rows = matches.select(F.col("group").cast("long"), F.struct(*(F.col(c).cast("double") for c in ("qx", "qy", "tx", "ty"))).alias("p"))
    return rows.groupBy("group").agg(F.collect_list("p").alias("points")).mapInArrow(solve, HOMOGRAPHY)


def inlier_sample(points: DataFrame, most: int = 400) -> DataFrame:
    """At most `most` evenly spaced rows (by point_id) of each group."""
    of = Window.partitionBy("group")
    ranked = points.withColumn("_i", F.row_number().over(of.orderBy("point_id")) - 1).withColumn("_n", F.count(F.lit(1)).over(of))
    step = (F.col("_n") - 1) / F.lit(float(max(most - 1, 1)))
    near = F.floor(F.col("_i") / F.nullif(step, F.lit(0.0)))
    hit = F.lit(False)
    for d in (-1, 0, 1, 2):
        hit = hit | ((near + d).between(0, most - 1) & (F.rint((near + d) * step) == F.col("_i")))
    return ranked.filter((F.col("_n") <= most) | hit).drop("_i", "_n")


def unavailable() -> dict[str, str]:
    """Models that need weights or native libraries which are not here; never imitated."""
    return {name: "unavailable" for name in ("neural descriptor", "learned matcher", "learned translator", "SIFT")}

