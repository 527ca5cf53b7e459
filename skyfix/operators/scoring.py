"""Scores and ranks of a job's candidates, from rows keyed by job_id and candidate_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyfix.functions import scores as S


def evaluate(candidates: DataFrame) -> DataFrame:
    """Adds the components retrieval, inlier, geometry, cover and the geometric score geo."""
    out = candidates.withColumns(
        {
            "c_retrieval": S.retrieval(F.col("similarity")),
            "c_inliers": S.inliers(F.col("inliers"), F.col("ratio")),
            "c_geometry": S.geometry(F.col("error"), F.col("shear"), F.col("valid")),
            "c_coverage": S.coverage(F.col("coverage")),
        }
    )
    return out.withColumn("geo", S.geometric(F.col("c_inliers"), F.col("c_geometry"), F.col("c_coverage"), F.col("valid")))


def with_runner_up(scored: DataFrame, radius: float) -> DataFrame:
    """Adds runner_up: the geometric score of the next candidate, in geometric order, at another place.

    Two candidates stand at one place if both have positions (x, y) at most `radius` apart. A job has
    a few dozen candidates at most, so they are one array per job, which is looked through from each candidate on.
    """
    rows = F.array_sort(F.collect_list(F.struct((-F.col("geo")).alias("g"), F.col("candidate_id").alias("c"), F.struct(*[F.col(c) for c in scored.columns]).alias("r"))))
    jobs = scored.groupBy("job_id").agg(rows.alias("_all"))

    def with_next(e, i):
        here, later = e["r"], F.slice("_all", i + 2, F.size("_all"))
        placed = here["x"].isNotNull() & here["y"].isNotNull() & F.lit(radius > 0)
        near = lambda o: F.sqrt(F.pow(o["r"]["x"] - here["x"], 2) + F.pow(o["r"]["y"] - here["y"], 2)) <= radius
        other = F.filter(later, lambda o: ~F.coalesce(placed & near(o), F.lit(False)))
        return F.struct(here.alias("r"), F.get(other, 0)["r"]["geo"].alias("runner_up"))

    # the grouping's own job_id, so that the rows are still known to lie by job
    out = jobs.select("job_id", F.inline(F.transform("_all", with_next)))
    return out.select(*["job_id" if c == "job_id" else F.col(f"r.{c}") for c in scored.columns], "runner_up")


def finalize(scored: DataFrame, radius: float) -> DataFrame:
    """Adds c_ambiguity, final (at most UNVERIFIED_CAP unless valid) and rank."""
    out = with_runner_up(scored, radius).withColumn("c_ambiguity", S.ambiguity(F.col("geo"), F.col("runner_up")))
    final = S.clamp01(S.weighted({k: F.col(f"c_{k}") for k in S.TILE_WEIGHTS}, S.TILE_WEIGHTS))
    out = out.withColumn("final", F.when(F.col("valid"), final).otherwise(F.least(final, F.lit(S.UNVERIFIED_CAP))))
    order = Window.partitionBy("job_id").orderBy(F.desc("final"), F.desc("geo"), "candidate_id")
    return out.withColumn("rank", F.row_number().over(order))


def best_rotation(attempts: DataFrame) -> DataFrame:
    """Of each candidate's attempts (rotation, valid, inliers) the best: valid first, then inliers, then the smaller rotation."""
    order = Window.partitionBy("job_id", "candidate_id").orderBy(F.desc("valid"), F.desc("inliers"), "rotation")
    return attempts.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def refine_set(scored: DataFrame, clusters: int = 2, top: int = 3) -> DataFrame:
    """The candidates to look at again: of the first clusters' members the valid ones if any, by geometric score."""
    near = scored.filter(F.col("cluster_rank") <= clusters)
    any_valid = F.max(F.col("valid").cast("int")).over(Window.partitionBy("job_id"))
    pool = near.withColumn("_any", any_valid).filter((F.col("_any") == 0) | F.col("valid"))
    order = Window.partitionBy("job_id").orderBy(F.desc("geo"), "candidate_id")
    return pool.withColumn("pick", F.row_number().over(order)).filter(F.col("pick") <= top).drop("_any")
