"""Clusters of candidates that point at one place, and the clusters' combined evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyfix.functions import scores as S


def same_place_radius(candidates: DataFrame, frame_w: float, frame_h: float) -> DataFrame:
    """job_id, radius: a third of the box diagonal of the first valid projection, else of the frame's."""
    diag = F.sqrt(F.pow(F.col("x_max") - F.col("x_min"), 2) + F.pow(F.col("y_max") - F.col("y_min"), 2)) / 3
    usable = F.col("valid") & (diag > 0)
    first = F.min_by(F.when(usable, diag), F.when(usable, F.col("candidate_id")))
    return candidates.groupBy("job_id").agg(F.coalesce(first, F.lit((frame_w**2 + frame_h**2) ** 0.5 / 3)).alias("radius"))


def assign(scored: DataFrame, radius: float) -> DataFrame:
    """Adds cluster_id (from 0) to rows with job_id, candidate_id, geo, x, y.

    In falling order of score each positioned candidate joins the nearest cluster whose running
    centroid lies within the radius, else founds one; candidates without a position follow as
    clusters of their own. The order matters, so this is a fold over a job's candidates, an array
    whose length the request bounds (some two dozen); jobs are spread over the cluster.
    """
    row = F.struct(*[F.col(c) for c in scored.columns if c != "job_id"])
    member = F.struct((-F.col("geo")).alias("g"), F.col("candidate_id").alias("c"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), row.alias("r"))
    jobs = scored.groupBy("job_id").agg(F.array_sort(F.collect_list(member)).alias("all"))
    jobs = jobs.select("job_id", F.filter("all", lambda m: m["x"].isNotNull() & m["y"].isNotNull()).alias("at"), F.filter("all", lambda m: m["x"].isNull() | m["y"].isNull()).alias("loose"))
    empty = F.struct(F.array().cast("array<struct<n:int,sx:double,sy:double>>").alias("clusters"), F.array().cast("array<int>").alias("of"))

    def step(state, m):
        clusters = state["clusters"]
        far = F.transform(clusters, lambda c: F.sqrt(F.pow(m["x"] - c["sx"] / c["n"], 2) + F.pow(m["y"] - c["sy"] / c["n"], 2)))
        at = F.array_position(far, F.array_min(F.filter(far, lambda d: d <= radius))).cast("int")
        own = F.struct(F.lit(1).alias("n"), m["x"].alias("sx"), m["y"].alias("sy"))
        # how far all clusters are is found once for each member: the place is a list of one, which is gone through
        grown = lambda p: F.transform(clusters, lambda c, i: F.when(i + 1 == p, F.struct((c["n"] + 1).alias("n"), (c["sx"] + m["x"]).alias("sx"), (c["sy"] + m["y"]).alias("sy"))).otherwise(c))
        done = lambda p: F.struct(F.when(p.isNull(), F.concat(clusters, F.array(own))).otherwise(grown(p)).alias("clusters"), F.concat(state["of"], F.array(F.coalesce(p - 1, F.size(clusters)))).alias("of"))
        return F.get(F.transform(F.array(at), done), 0)

    folded = jobs.select("job_id", "at", "loose", F.aggregate("at", empty, step).alias("state"))
    placed = F.transform("at", lambda m, i: F.struct(m["r"].alias("r"), F.get("state.of", i).alias("cluster_id")))
    alone = F.transform("loose", lambda m, i: F.struct(m["r"].alias("r"), (F.size("state.clusters") + i).alias("cluster_id")))
    out = folded.select("job_id", F.inline(F.concat(placed, alone))).filter("job_id IS NOT NULL AND r.candidate_id IS NOT NULL")
    return out.select(*["job_id" if c == "job_id" else F.col(f"r.{c}") for c in scored.columns], "cluster_id")


def members(assigned: DataFrame, best_: DataFrame) -> DataFrame:
    """The rows of each job's one cluster (best_: job_id, cluster_id, one row a job). Joined by job alone, so nothing is dealt anew."""
    return assigned.join(best_.select("job_id", F.col("cluster_id").alias("_own")), "job_id").filter(F.col("cluster_id") == F.col("_own")).drop("_own")


def aggregate(scored: DataFrame, *more: Column) -> DataFrame:
    """One row for each job_id and cluster_id with the cluster's evidence and representative.

    Valid members' evidence is summed; a cluster without one keeps the largest single evidence.
    more: further aggregates of the members, under their own names.
    """
    v = F.col("valid")
    only = lambda c: F.when(v, F.col(c))
    strength = F.when(F.col("final") > 0, F.col("final")).otherwise(F.col("geo"))
    first = F.struct(v.cast("int").alias("a"), F.col("partial").cast("int").alias("b"), strength.alias("c"), (-F.col("order")).alias("d"))
    measured = v & F.col("error").isNotNull()
    out = scored.groupBy("job_id", "cluster_id").agg(
        F.count_if(v).cast("int").alias("support"),
        F.count(F.lit(1)).cast("int").alias("members"),
        F.max("similarity").alias("similarity"),
        F.when(F.max(v), F.sum(only("raw_matches"))).otherwise(F.max("raw_matches")).alias("raw_matches"),
        F.coalesce(F.sum(only("inliers")), F.lit(0)).alias("inliers"),
        F.when(F.max(v), F.max(only("coverage"))).otherwise(F.max("coverage")).alias("coverage"),
        (F.sum(F.when(measured, F.col("error") * F.col("inliers"))) / F.nullif(F.sum(F.when(measured, F.col("inliers"))), F.lit(0))).alias("error"),
        F.max(v).alias("valid"),
        (~F.max(v) & F.max("partial")).alias("partial"),
        F.max_by("candidate_id", first).alias("representative_id"),
        F.max_by("tile_id", first).alias("tile_id"),
        F.max_by("shear", first).alias("shear"),
        F.max_by("rejection", first).alias("_rejection"),
        F.min_by(F.col("rejection"), F.when(F.col("partial"), F.col("order"))).alias("_partial_rejection"),
        *more,
    )
    ratio = F.when(F.col("valid"), F.col("inliers") / F.greatest(F.col("raw_matches"), F.lit(1))).otherwise(F.lit(0.0))
    rejection = F.when(~F.col("valid"), F.when(F.col("partial"), F.col("_partial_rejection")).otherwise(F.col("_rejection")))
    return out.withColumn("ratio", ratio).withColumn("rejection", rejection).drop("_rejection", "_partial_rejection")


def rank(clusters: DataFrame) -> DataFrame:
    """Adds the clusters' components, geo, final and rank."""
    out = clusters.withColumns(
        {
            "c_retrieval": S.retrieval(F.col("similarity")),
            "c_inliers": S.inliers(F.col("inliers"), F.col("ratio")),
            "c_geometry": S.geometry(F.col("error"), F.col("shear"), F.col("valid")),
            "c_coverage": S.coverage(F.col("coverage")),
            "c_consensus": S.consensus(F.col("support")),
        }
    )
    raw = 0.38 * F.col("c_inliers") + 0.28 * F.col("c_geometry") + 0.14 * F.col("c_coverage") + 0.20 * F.col("c_consensus")
    out = out.withColumn("geo", S.clamp01(F.when(F.col("valid"), raw).otherwise(raw * 0.25)))
    by_geo = Window.partitionBy("job_id").orderBy(F.desc("geo"), "cluster_id")
    out = out.withColumn("c_ambiguity", S.ambiguity(F.col("geo"), F.lead("geo").over(by_geo)))
    final = S.clamp01(S.weighted({k: F.col(f"c_{k}") for k in S.CLUSTER_WEIGHTS}, S.CLUSTER_WEIGHTS))
    out = out.withColumn("final", F.when(F.col("valid"), final).otherwise(F.least(final, F.lit(S.UNVERIFIED_CAP))))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("final"), F.desc("geo"), "cluster_id")))


def best(ranked: DataFrame) -> DataFrame:
    """Each job's first valid cluster by rank, else its first partial one, else its first."""
    order = Window.partitionBy("job_id").orderBy(F.desc("valid"), F.desc("partial"), "rank")
    return ranked.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def center(axis: str) -> Column:
    """Aggregate: the valid, positioned members' inlier-weighted mean of a coordinate."""
    at, w = F.col("valid") & F.col("x").isNotNull(), F.greatest(F.col("inliers"), F.lit(1)).cast("double")
    return F.sum(F.when(at, F.col(axis) * w)) / F.sum(F.when(at, w))


def weighted_center(scored: DataFrame) -> DataFrame:
    """job_id, cluster_id, center_x, center_y: the valid members' inlier-weighted mean position."""
    w = F.greatest(F.col("inliers"), F.lit(1)).cast("double")
    mean = lambda c: F.sum(F.col(c) * w) / F.sum(w)
    return scored.filter(F.col("valid") & F.col("x").isNotNull()).groupBy("job_id", "cluster_id").agg(mean("x").alias("center_x"), mean("y").alias("center_y"))


def weighted_geometry(scored: DataFrame) -> DataFrame:
    """job_id, cluster_id, center_x, center_y and corners: the valid members' inlier-weighted mean position and mean corners (corners: array of four x, y).

    Members without a position do not count; a cluster whose members do not all have four corners has none.
    """
    w = F.greatest(F.col("inliers"), F.lit(1)).cast("double")
    mean = lambda c: F.sum(c * w) / F.sum(w)
    corner = lambda i: F.struct(*(mean(F.get("corners", i)[axis]).alias(axis) for axis in "xy"))
    whole = F.min((F.coalesce(F.size("corners"), F.lit(0)) == 4).cast("int")) == 1
    own = scored.filter(F.col("valid") & F.col("x").isNotNull()).groupBy("job_id", "cluster_id")
    return own.agg(mean(F.col("x")).alias("center_x"), mean(F.col("y")).alias("center_y"), F.when(whole, F.array(*map(corner, range(4)))).alias("corners"))
