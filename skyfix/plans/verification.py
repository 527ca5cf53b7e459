"""Match, then verify: candidate tiles against a frame in every rotation, and the best rotation of each.

The steps are operators of this library, joined: descriptors are matched by their two nearest neighbours (matching.knn_ratio_match), points of
turned frames are turned back (geometry.unrotate), a table function solves each candidate and rotation (VerifyMatches), the gates judge what it found,
and the best attempt of each candidate is kept (scoring.best_rotation).

VerifyMatches is polymorphic: it takes any table with qx, qy, tx, ty, partitions it by all its other columns, and returns these with the homography's.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, PartitioningColumn
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

from skyfix.functions import geometry
from skyfix.operators import matching, scoring

POINTS = ("qx", "qy", "tx", "ty")
_FOUND = [("raw_matches", IntegerType()), ("inliers", IntegerType()), ("ratio", DoubleType()), ("error", DoubleType()), ("error_median", DoubleType()), ("error_p90", DoubleType()), ("cells", IntegerType()), ("coverage", DoubleType()), ("h", ArrayType(DoubleType())), ("rejection", StringType())]


class VerifyMatches:
    """Table function (matches, frame_w, frame_h): one row for each partition of the matches. A partition is held whole: the keypoint cap bounds it."""

    def __init__(self) -> None:
        self.key, self.rows, self.frame = None, [], (1.0, 1.0)

    @staticmethod
    def analyze(matches: AnalyzeArgument, frame_w: AnalyzeArgument, frame_h: AnalyzeArgument) -> AnalyzeResult:
        if not matches.isTable or any(c not in matches.dataType.names for c in POINTS):
            raise ValueError(f"the first argument is a table with the columns {', '.join(POINTS)}")
        keys = [f for f in matches.dataType.fields if f.name not in POINTS]
        if not keys:
            raise ValueError("the table needs a column that tells its candidates apart")
        schema = StructType(list(keys))
        for name, kind in _FOUND:
            schema = schema.add(name, kind)
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn(f.name) for f in keys])

    def eval(self, row, frame_w, frame_h) -> None:
        if self.key is None:
            self.key, self.frame = tuple(row[c] for c in row.__fields__ if c not in POINTS), (float(frame_w), float(frame_h))
        self.rows.append([row[c] for c in POINTS])

    def terminate(self) -> Iterator[tuple]:
        if self.key is not None:
            at = np.array([r for r in self.rows if None not in r], float).reshape(-1, 4)
            found = matching.verified(at[:, :2], at[:, 2:], *self.frame, seed=zlib.crc32(repr(self.key).encode()))
            yield *self.key, *(found[name] for name, _ in _FOUND)


def verify(matches: DataFrame, frame_w: float, frame_h: float) -> DataFrame:
    """The keys of the matches (all columns but qx, qy, tx, ty) with each one's homography and figures."""
    spark = matches.sparkSession
    spark.udtf.register("verify_matches", F.udtf(VerifyMatches))
    return spark.sql("SELECT * FROM verify_matches(TABLE({m}), {w}, {h})", m=matches, w=float(frame_w), h=float(frame_h))


def judged(found: DataFrame, frame_w: float, frame_h: float) -> DataFrame:
    """Adds verdict (verified, partial, rejected), valid, partial and the first gate that is missed (rejection) to verify()'s rows."""
    # each step has columns of its own, which the next refers to: written out in one expression they would not compile
    out = found.withColumns({f"_h{i}": F.get("h", i) for i in range(9)})
    h = [F.col(f"_h{i}") for i in range(9)]
    corners = [geometry.project(h, x, y) for x, y in geometry.frame_corners(F.lit(frame_w), F.lit(frame_h))]
    scale, _, shear = geometry.affine_parts(h)
    out = out.withColumns({f"_{axis}{i}": c for i, corner in enumerate(corners) for axis, c in zip("xy", corner, strict=True)} | {"_scale": scale, "_shear": shear})
    points = [(F.col(f"_x{i}"), F.col(f"_y{i}")) for i in range(4)]
    out = out.withColumn("_ratio", geometry.polygon_area(points) / (frame_w * frame_h))
    structural = F.coalesce("rejection", geometry.structural_rejection(points, F.col("_scale"), F.col("_ratio"), F.col("_shear")))
    strength = geometry.strength_rejection(F.col("inliers"), F.col("ratio"), F.col("error"), F.col("coverage"))
    out = out.withColumns({"_structural": structural, "_strength": strength})
    verdict = geometry.verdict_label(F.col("_structural"), F.col("_strength"))
    out = out.withColumns({"verdict": verdict, "rejection": F.coalesce("_structural", "_strength")}).select(*found.columns, "verdict")
    return out.withColumns({"valid": F.col("verdict") == "verified", "partial": F.col("verdict") == "partial"})


def match_then_verify(frames: DataFrame, tiles: DataFrame, frame_w: float, frame_h: float, ratio: float = matching.RATIO) -> DataFrame:
    """job_id, candidate_id, rotation and the homography of each candidate's best rotation, judged.

    frames: job_id, rotation (quarter turns), id, x, y, descriptor of the frame's features as they are in the turned frame; tiles: job_id, candidate_id, id, x,
    y, descriptor. A rotation without matches is an attempt without matches.
    """
    turns = frames.select("job_id", "rotation").distinct()
    attempts = tiles.select("job_id", "candidate_id").distinct().join(turns, "job_id")
    group = F.concat_ws(":", "job_id", "candidate_id", "rotation").alias("group")
    q = frames.join(attempts, ["job_id", "rotation"]).select(group, "id", "x", "y", "descriptor")
    t = tiles.join(attempts, ["job_id", "candidate_id"]).select(group, "id", "x", "y", "descriptor")
    near = matching.knn_ratio_match(q.select("group", "id", "descriptor"), t.select("group", "id", "descriptor"), ratio)
    met = near.join(q.select("group", F.col("id").alias("query_id"), F.col("x").alias("fx"), F.col("y").alias("fy")), ["group", "query_id"])
    met = met.join(t.select("group", F.col("id").alias("target_id"), F.col("x").alias("tx"), F.col("y").alias("ty")), ["group", "target_id"])
    key = F.split("group", ":")
    met = met.select(F.get(key, 0).cast("long").alias("job_id"), F.get(key, 1).cast("long").alias("candidate_id"), F.get(key, 2).cast("int").alias("rotation"), "fx", "fy", "tx", "ty")
    qx, qy = geometry.unrotate(F.col("fx"), F.col("fy"), F.col("rotation"), F.lit(frame_w), F.lit(frame_h))
    pairs = met.select("job_id", "candidate_id", "rotation", qx.cast("double").alias("qx"), qy.cast("double").alias("qy"), F.col("tx").cast("double"), F.col("ty").cast("double"))
    found = verify(pairs, frame_w, frame_h)
    every = attempts.select(F.col("job_id").cast("long"), F.col("candidate_id").cast("long"), F.col("rotation").cast("int"))
    all_ = every.join(found, ["job_id", "candidate_id", "rotation"], "left")
    all_ = all_.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("raw_matches", "inliers", "cells")} | {c: F.coalesce(c, F.lit(0.0)) for c in ("ratio", "coverage")})
    all_ = all_.withColumn("rejection", F.when(F.col("raw_matches") < 4, "too_few_matches").otherwise(F.col("rejection")))
    return scoring.best_rotation(judged(all_, frame_w, frame_h))
