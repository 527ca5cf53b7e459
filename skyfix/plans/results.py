"""Result documents: rounded projections, members of the winning cluster, samples for drawing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyfix.operators import clustering, verdict


def settled(value: Column | str, digits: int = 4) -> Column:
    """To 9 decimals first: a value halfway between two steps goes up, whatever its last bits are."""
    return F.round(F.round(value, 9), digits)


def _round(name: str, digits: int = 4, of: str | None = None) -> Column:
    return settled(of or name, digits).alias(name)


def verdict_of(valid: Column, partial: Column) -> Column:
    return F.when(valid, "verified").when(partial, "partial").otherwise("rejected")


def _components(row: DataFrame) -> Column:
    names = [c for c in row.columns if c.startswith("c_")]
    return F.create_map(*[x for c in names for x in (F.lit(c[2:]), settled(c))]).alias("components")


def _evidence(row: DataFrame) -> list[str | Column]:
    return [
        _round("similarity"), "raw_matches", "inliers", _round("ratio"), _round("coverage"), _round("error", 3),
        "valid", verdict_of(F.col("valid"), F.col("partial")).alias("verdict"), "partial", "rejection", _round("geo"), _round("final"),
    ]


def candidates(finalized: DataFrame) -> DataFrame:
    """The candidates' document rows: scores to 4 decimals, the error to 3, null where it was not measured."""
    return finalized.select("job_id", "candidate_id", "tile_id", "rank", *_evidence(finalized), _components(finalized))


def clusters(ranked: DataFrame) -> DataFrame:
    return ranked.select("job_id", "cluster_id", "tile_id", "rank", "members", "support", *_evidence(ranked), _components(ranked))


#: The weights of the representations in the fusion.
WEIGHTS = {"rgb": 0.40, "structural": 0.25, "map": 0.15, "retrieval": 0.20}


def cross_representation(best: DataFrame, estimates: DataFrame, weights: dict[str, float] = WEIGHTS, tolerance: float = 0.0) -> DataFrame:
    """One row for each representation of a job that has a winning place: `rgb` from its cluster, the others from their estimates.

    best: job_id, similarity, raw_matches, inliers, ratio, error, valid, geo, x, y and radius (the
    same-place radius). estimates: job_id, representation and the same without similarity and radius,
    one row for each representation (representation_best). Weights are shared among rgb, the job's
    estimates and retrieval; negative ones count 0, unknown names 0, and all 0 gives equal shares. Only
    valid estimates have a position; an error that is not finite is null. `tolerance` is the given
    one if above 0, else the radius. Jobs without a winning place have no rows.
    """
    shared = ("raw_matches", "inliers", "ratio", "error", "valid", "geo", "x", "y")
    rgb = best.select("job_id", F.lit("rgb").alias("representation"), "similarity", *shared, "radius")
    placed = F.coalesce("valid", F.lit(False))
    aux = estimates.withColumns({c: F.when(placed, F.col(c)) for c in ("x", "y")}).join(best.select("job_id", "radius"), "job_id")
    rows = rgb.unionByName(aux.select("job_id", "representation", F.lit(0.0).alias("similarity"), *shared, "radius"))
    known = F.create_map(*[F.lit(x) for name, w in weights.items() for x in (name, max(float(w), 0.0))])
    w = F.coalesce(F.try_element_at(known, F.col("representation")), F.lit(0.0))
    of = Window.partitionBy("job_id")
    total = F.sum(w).over(of) + max(float(weights.get("retrieval", 0.0)), 0.0)
    share = F.when(total > 0, w / F.nullif(total, F.lit(0.0))).otherwise(1.0 / (F.count(F.lit(1)).over(of) + 1))
    error = F.when(F.abs("error") < float("inf"), F.col("error"))
    wanted = F.lit(float(tolerance)) if tolerance > 0 else F.col("radius")
    return rows.withColumns({"error": error, "valid": F.coalesce("valid", F.lit(False)), "weight": share, "tolerance": wanted}).drop("radius")


def positions(rows: DataFrame) -> DataFrame:
    """The rows of cross_representation that have a position."""
    return rows.filter("x is not null and y is not null")


def representations(rows: DataFrame) -> DataFrame:
    center = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.array(F.round("x", 1), F.round("y", 1)))
    return rows.select(
        "job_id", "representation", _round("similarity"), "raw_matches", "inliers", _round("ratio"), _round("error", 3), "valid", _round("geo"), _round("weight"), center.alias("map_center"),
    )


def consensus(agreed: DataFrame, reference: str = "rgb") -> DataFrame:
    """The document rows of verdict.consensus: pixels to 1 decimal."""
    tenth = lambda m: F.transform_values(m, lambda _, v: F.round(v, 1))
    at = F.transform_values("positions", lambda _, p: F.transform(p, lambda v: F.round(v, 1)))
    return agreed.select(
        "job_id", F.lit(reference).alias("reference"), "agree", _round("tolerance_px", 1, "tolerance"), _round("max_disagreement_px", 1, "max_offset"),
        tenth(F.col("offsets")).alias("offsets_px"), at.alias("positions"), "participating",
    )


def fused(fusion: DataFrame, rows: DataFrame) -> DataFrame:
    """The document rows of verdict.fuse, with each representation's score and weight: all to 4 decimals."""
    of = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("representation", settled(c).alias("v")))))
    parts = rows.groupBy("job_id").agg(of("geo").alias("components"), of("weight").alias("weights"))
    return fusion.join(parts, "job_id", "left").select(
        "job_id", _round("overall"), _round("base_rgb", of="base"), "components", "weights",
        _round("applied_bonus", of="bonus"), _round("applied_penalty", of="penalty"), F.col("agree").alias("consensus"), "corroborating", "dissenting",
    )


def features(sets: DataFrame) -> DataFrame:
    """The document rows of feature sets (image_id, backend, detected, selected, width, height); missing numbers are 0."""
    number = lambda c, name: F.coalesce(c, F.lit(0)).cast("int").alias(name)
    return sets.select("image_id", F.coalesce("backend", F.lit("unknown")).alias("backend"), number("detected", "detected_keypoints"), number("selected", "selected_keypoints"), number("width", "width"), number("height", "height"))


def with_clusters(rows: DataFrame, assigned: DataFrame, ranked: DataFrame) -> DataFrame:
    """Candidate rows with their cluster's id and rank. A job has a few dozen of either, so they are lists, joined by job alone."""
    of = assigned.groupBy("job_id").agg(F.collect_list(F.struct("candidate_id", "cluster_id")).alias("_of"))
    ranks = ranked.groupBy("job_id").agg(F.collect_list(F.struct("cluster_id", F.col("rank").alias("cluster_rank"))).alias("_ranks"))
    own = F.get(F.filter("_of", lambda m: m["candidate_id"] == F.col("candidate_id")), 0)["cluster_id"]
    met = rows.join(of.join(ranks, "job_id"), "job_id", "left").withColumn("_own", own)
    met = met.withColumn("_cluster", F.get(F.filter("_ranks", lambda c: c["cluster_id"] == F.col("_own")), 0))
    return met.select(*rows.columns, "_cluster.cluster_id", "_cluster.cluster_rank")


def supporting_members(assigned: DataFrame, best: DataFrame) -> DataFrame:
    """job_id, member_tile_ids (sorted) and supporting of the best cluster's valid members."""
    members = clustering.members(assigned, best)
    return members.groupBy("job_id").agg(F.array_sort(F.collect_list(F.when(F.col("valid"), F.col("tile_id")))).alias("member_tile_ids"), F.count_if("valid").alias("supporting"))


#: Fixed value.
COVERAGE_NOTE = "Estimated visual position - not a guaranteed fix. Verify against onboard sensors before use."


def _listed(rows: DataFrame, name: str) -> DataFrame:
    """job_id and an array of the rows' other columns, by rank."""
    entry = F.struct("rank", *[c for c in rows.columns if c not in ("job_id", "rank", "components")], *[c for c in rows.columns if c == "components"])
    return rows.groupBy("job_id").agg(_by_rank(F.collect_list(entry)).alias(name))


def _by_rank(entries: Column) -> Column:
    """Maps cannot be ordered, so the entries are ordered by their rank alone."""
    return F.array_sort(entries, lambda a, b: F.when(a["rank"] < b["rank"], -1).when(a["rank"] > b["rank"], 1).otherwise(0))


def document(decided: DataFrame, best: DataFrame, centers: DataFrame, rows: DataFrame, ranked: DataFrame | None = None, members: DataFrame | None = None, extras: DataFrame | None = None) -> DataFrame:
    """job_id, status, px, py and `body`, the JSON document of a job.

    decided: verdict.decide; best, ranked: the winning and all clusters; centers: clustering.weighted_center;
    rows: candidates(), with their clusters if with_clusters() added them; members: supporting_members().
    extras: job_id and one column for each further key (polygon, gps, renders, keypoints, representations,
    consensus, fused ...), which goes into the body under its name. The pixel is given only if the verdict
    is accepted. A job without a winning cluster has no best_candidate, and its metrics are 0, false and null.
    """
    center = clustering.members(centers, best).select("job_id", "center_x", "center_y")
    facts = rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("candidate_count"), F.max("similarity").alias("best_similarity"))
    out = decided.join(center, "job_id", "left").join(_listed(rows, "candidates"), "job_id", "left").join(facts, "job_id", "left")
    winner = best.select("job_id", F.struct([c for c in best.columns if c != "job_id"]).alias("_best"))
    out = out.join(winner, "job_id", "left")
    if ranked is not None:
        out = out.join(_listed(clusters(ranked), "location_clusters"), "job_id", "left")
    if members is not None:
        out = out.join(members.select("job_id", "member_tile_ids"), "job_id", "left")
    further = [c for c in extras.columns if c != "job_id"] if extras is not None else []
    if further:
        out = out.join(extras, "job_id", "left")
    return _told(out, ranked is not None, members is not None, further)


def documents_of(cells: DataFrame) -> DataFrame:
    """document() of every job with its clusters and members, from all its candidates (clustering.assign of scoring.finalize, with `order`).

    One pass: candidates are gathered by cluster and clusters by job, where they lie, so the clusters are found once and nothing is joined.
    """
    rows = F.struct("rank", "candidate_id", "tile_id", *_evidence(cells), _components(cells))
    tiles = F.array_sort(F.collect_list(F.when(F.col("valid"), F.col("tile_id"))))
    gathered = {"_rows": F.collect_list(rows), "member_tile_ids": tiles, "center_x": clustering.center("x"), "center_y": clustering.center("y")}
    found = clustering.aggregate(cells, *[c.alias(name) for name, c in gathered.items()])
    ranked = clustering.rank(found)
    # the order of clustering.best: true before false before null
    first = F.struct(*[F.coalesce(-F.col(c).cast("int"), F.lit(1)).alias(c) for c in ("valid", "partial")], "rank")
    names = [f.name for f in found.schema["_rows"].dataType.elementType.fields if f.name != "components"]
    own = F.transform("_rows", lambda r: F.struct(*[r[c].alias(c) for c in names], F.col("cluster_id"), F.col("rank").alias("cluster_rank"), r["components"].alias("components")))
    out = verdict.decide(
        ranked,
        F.min_by(F.struct([c for c in ranked.columns if c not in ("job_id", "_rows")]), first).alias("_best"),
        F.flatten(F.collect_list(own)).alias("candidates"),
        F.collect_list(F.struct("rank", "cluster_id", "tile_id", "members", "support", *_evidence(ranked), _components(ranked))).alias("location_clusters"),
        F.sum("members").alias("candidate_count"),
        F.max("similarity").alias("best_similarity"),
    )
    of_best = {c: F.col("_best")[c] for c in ("member_tile_ids", "center_x", "center_y")}
    return _told(out.withColumns({c: _by_rank(F.col(c)) for c in ("candidates", "location_clusters")} | of_best), True, True, [])


def _told(out: DataFrame, with_clusters: bool, with_members: bool, further: list[str]) -> DataFrame:
    """The document rows of jobs: verdict.decide, center_x, center_y, candidates, candidate_count, best_similarity, _best (a struct) and what is asked for."""
    w = F.col("_best")
    accepted = F.col("status").isin("MATCH_FOUND", "LOW_CONFIDENCE")
    pixel = F.when(accepted & F.col("center_x").isNotNull(), F.struct(F.rint("center_x").cast("int").alias("x"), F.rint("center_y").cast("int").alias("y")))
    chosen = [w["representative_id"].alias("candidate_id"), w["tile_id"].alias("tile_id"), settled(w["similarity"]).alias("similarity"), w["support"].alias("supporting_tiles")]
    if with_members:
        chosen.append(F.col("member_tile_ids"))
    zero = lambda c, name, digits: settled(F.coalesce(c, F.lit(0)), digits).alias(name)
    metrics = F.struct(
        zero(w["raw_matches"], "raw_matches", 0), zero(w["inliers"], "ransac_inliers", 0), zero(w["ratio"], "inlier_ratio", 4), zero(w["coverage"], "spatial_coverage", 4),
        settled(w["error"], 3).alias("reprojection_error"), F.coalesce(w["valid"], F.lit(False)).alias("homography_valid"), verdict_of(w["valid"], w["partial"]).alias("verdict"),
        F.coalesce(w["partial"], F.lit(False)).alias("partial"), w["rejection"].alias("rejection"), zero(w["support"], "supporting_tiles", 0),
    )
    body = F.struct(
        "status", verdict.message(F.col("status")).alias("status_message"), F.col("reason"), settled(F.coalesce("score", F.lit(0.0))).alias("confidence"), accepted.alias("accepted"),
        F.when(w.isNotNull(), F.struct(*chosen)).alias("best_candidate"), metrics.alias("feature_metrics"), pixel.alias("map_pixel"), "candidates",
        F.struct(F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"), settled(F.coalesce("best_similarity", F.lit(0.0))).alias("best_similarity")).alias("retrieval"),
        *(["location_clusters"] if with_clusters else []), *further, F.lit(COVERAGE_NOTE).alias("coverage_note"),
    )
    return out.select("job_id", "status", pixel["x"].alias("px"), pixel["y"].alias("py"), F.to_json(body).alias("body"))


def keypoints_to_draw(points: DataFrame, most: int = 1200) -> DataFrame:
    """Each image's strongest keypoints (image_id, kp_id, score)."""
    order = Window.partitionBy("image_id").orderBy(F.desc("score"), "kp_id")
    return points.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")


def lines_to_draw(matches: DataFrame, most: int = 220) -> DataFrame:
    """Evenly spaced matches of each pair, outliers before inliers (pair_id, match_id, inlier), with their place."""
    of = Window.partitionBy("pair_id")
    ranked = matches.withColumn("_i", F.row_number().over(of.orderBy("inlier", "match_id")) - 1).withColumn("_n", F.count(F.lit(1)).over(of))
    # place k takes row floor(k * n / most); row i is taken by k = ceil(i * most / n), if that lands on i
    step = F.col("_n") / F.lit(float(most))
    k = F.ceil(F.col("_i") / step)
    hit = F.lit(False)
    for d in (-1, 0, 1):
        hit = hit | ((k + d).between(0, most - 1) & (F.floor((k + d) * step) == F.col("_i")))
    kept = ranked.filter((F.col("_n") <= most) | hit).drop("_i", "_n")
    return kept.withColumn("place", F.row_number().over(of.orderBy("inlier", "match_id")))


def crop_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, margin: float = 0.45) -> Column:
    """The box around a polygon's bounds with a margin, cut to the map; null if nothing is left."""
    px, py = (x1 - x0) * margin, (y1 - y0) * margin
    a, b = F.greatest(F.lit(0.0), x0 - px).cast("int"), F.greatest(F.lit(0.0), y0 - py).cast("int")
    c, d = F.least(width.cast("double"), x1 + px).cast("int"), F.least(height.cast("double"), y1 + py).cast("int")
    return F.when((c > a) & (d > b), F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1")))


def branches(built: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """job_id, name, state (ready or skipped), error of each representation; missing ones are skipped."""
    wanted = built.select("job_id").distinct().withColumn("name", F.explode(F.array(*map(F.lit, names))))
    out = wanted.join(built.select("job_id", "name", F.lit(True).alias("_ready"), "error"), ["job_id", "name"], "left")
    return out.select("job_id", "name", F.when(F.col("_ready") & F.col("error").isNull(), "ready").otherwise("skipped").alias("state"), F.when(F.col("_ready").isNull(), "unavailable").otherwise(F.col("error")).alias("error"))


def with_fallback(found: DataFrame, fallback: DataFrame) -> DataFrame:
    """Candidates, and a job's valid whole-map fallback if none of its candidates is valid."""
    lucky = found.filter("valid").select("job_id").distinct()
    return found.unionByName(fallback.filter("valid").join(lucky, "job_id", "left_anti"), allowMissingColumns=True)


def representation_best(attempts: DataFrame) -> DataFrame:
    """Each job's best attempt of each representation: valid first, then inliers, then the smaller candidate_id."""
    order = Window.partitionBy("job_id", "representation").orderBy(F.desc("valid"), F.desc("inliers"), "candidate_id")
    return attempts.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def inlier_evidence(points: DataFrame, members: DataFrame, decided: DataFrame) -> DataFrame:
    """job_id, points: the winning members' inlier points in map pixels, 1 decimal, only for accepted verdicts.

    points: job_id, candidate_id, point_id, x, y, sampled per candidate before (inlier_sample), so a job's list is bounded.
    """
    accepted = decided.filter(F.col("status").isin("MATCH_FOUND", "LOW_CONFIDENCE")).select("job_id")
    winners = members.groupBy("job_id").agg(F.collect_set("candidate_id").alias("_own")).join(accepted, "job_id", "left_semi")
    own = points.join(winners, "job_id").filter(F.array_contains("_own", F.col("candidate_id")))
    entry = F.struct("candidate_id", "point_id", F.round("x", 1).alias("x"), F.round("y", 1).alias("y"))
    return own.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda p: F.array(p["x"], p["y"])).alias("points"))


def pixel_statistics(pixels: DataFrame) -> DataFrame:
    """image_id, mean, deviation (population), edge_density, dark_share of pixel rows (image_id, grey, edge), 4 decimals."""
    share = lambda c: F.round(F.count_if(c) / F.count(F.lit(1)), 4)
    return pixels.groupBy("image_id").agg(F.round(F.avg("grey"), 4).alias("mean"), F.round(F.stddev_pop("grey"), 4).alias("deviation"), share(F.col("edge") > 0).alias("edge_density"), share(F.col("grey") < 128).alias("dark_share"))
