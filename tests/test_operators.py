"""Examples and edge cases that the SQL twins cannot catch."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyfix.functions import geo
from skyfix.functions import scores as S
from skyfix.operators import clustering, matching, retrieval, scoring, tiling, verdict
from skyfix.plans import evaluation, mission, results
from skyfix.sources import registry


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_clamp_of_nan_and_null(spark):
    assert one(spark, S.clamp01(F.lit(float("nan")))) == 0.0
    assert one(spark, S.clamp01(F.lit(None).cast("double"))) is None
    assert one(spark, S.clamp01(F.lit(7.0))) == 1.0
    assert one(spark, S.geometry(F.lit(float("inf")), F.lit(0.0), F.lit(True))) == 0.0


@pytest.mark.parametrize(("overlap", "tiles"), [(0.25, 100), (0.35, 116)])
def test_tile_count_of_a_3000_map(spark, overlap, tiles):
    maps = spark.createDataFrame([(1, 3000, 3000)], "map_id int, map_w int, map_h int")
    grid = tiling.tile_grid(maps, overlap=overlap)
    assert grid.count() == tiles
    box = tiling.bounds(grid).first()
    assert (box.x_min, box.y_min, box.x_max, box.y_max) == (0, 0, 3000, 3000)


@pytest.mark.parametrize("most", [1, 10])
def test_budget(spark, most):
    maps = spark.createDataFrame([(1, 3000, 3000), (2, 60, 50)], "map_id int, map_w int, map_h int")
    kept = tiling.within_budget(tiling.tile_grid(maps), most).filter("map_id = 1").orderBy("tile_id").collect()
    assert [r.tile_id for r in kept] == list(range(most))


BANK = [[1, 0, 0, 0, 0], [0.9, 0.1, 0, 0, 0], [0.8, 0.2, 0, 0, 0], [0, 0, 0, 1, 0], [0, 0, 0, 0.9, 0.1]]


def _bank(spark):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(BANK)], "tile_id int, embedding array<double>")


def _frame(spark, v):
    return spark.createDataFrame([(0, [float(x) for x in v])], "frame_id int, query array<double>")


def test_union_of_domains(spark):
    rgb, other = _frame(spark, BANK[0]), _frame(spark, BANK[3])
    alone = retrieval.multi_domain_union(_bank(spark), [("rgb", rgb, 3)], 18).orderBy("place").collect()
    assert [(r.tile_id, r.sources) for r in alone] == [(0, ["rgb"]), (1, ["rgb"]), (2, ["rgb"])]
    both = retrieval.multi_domain_union(_bank(spark), [("rgb", rgb, 3), ("map", other, 3)], 18).orderBy("place").collect()
    assert [r.tile_id for r in both][:3] == [0, 1, 2] and {r.tile_id for r in both} == {0, 1, 2, 3, 4}
    assert next(r for r in both if r.tile_id == 0).sources == ["rgb", "map"]
    assert retrieval.multi_domain_union(_bank(spark), [("rgb", rgb, 3), ("map", other, 3)], 3).count() == 3


def greedy(rows, radius):
    """A plain twin of the fold."""
    clusters, loose = [], []
    for c, g, x, y in sorted(rows, key=lambda r: (-r[1], r[0])):
        if x is None or y is None:
            loose.append([c])
            continue
        best = None
        for k in clusters:
            d = math.hypot(x - k["x"] / k["n"], y - k["y"] / k["n"])
            if d <= radius and (best is None or d < best[0]):
                best = d, k
        if best:
            k = best[1]
            k["n"], k["x"], k["y"] = k["n"] + 1, k["x"] + x, k["y"] + y
            k["ids"].append(c)
        else:
            clusters.append({"n": 1, "x": x, "y": y, "ids": [c]})
    groups = [k["ids"] for k in clusters] + loose
    return {c: i for i, ids in enumerate(groups) for c in ids}


def test_greedy_clusters_match_their_twin(spark):
    rng = np.random.default_rng(3)
    rows = [(j, c, round(float(rng.random()), 2), None if rng.random() < 0.1 else float(rng.integers(0, 300)), float(rng.integers(0, 300))) for j in range(20) for c in range(15)]
    df = spark.createDataFrame(rows, "job_id int, candidate_id int, geo double, x double, y double")
    got = {(r.job_id, r.candidate_id): r.cluster_id for r in clustering.assign(df, 90.0).collect()}
    for j in range(20):
        for c, k in greedy([r[1:] for r in rows if r[0] == j], 90.0).items():
            assert got[j, c] == k


def _matches(spark, n, sigma, seed=1):
    rng = np.random.default_rng(seed)
    side = math.ceil(math.sqrt(n))
    grid = [(x, y) for y in np.linspace(20, 220, side) for x in np.linspace(20, 300, side)][:n]
    rows = [(1, float(x), float(y), float(x + 100 + rng.normal(0, sigma)), float(y + 100 + rng.normal(0, sigma))) for x, y in grid]
    return spark.createDataFrame(rows, "group long, qx double, qy double, tx double, ty double")


def test_homography_of_clean_points(spark):
    r = matching.estimate_homographies(_matches(spark, 40, 0.0), 320, 240).first()
    assert r.inliers == 40 and r.error < 1e-6
    assert np.allclose(r.h, [1, 0, 100, 0, 1, 100, 0, 0, 1], atol=1e-6)
    assert matching.estimate_homographies(_matches(spark, 3, 0.0), 320, 240).first().rejection == "too_few_matches"


def test_reruns_of_ransac_agree(spark):
    m = _matches(spark, 40, 0.15)
    assert matching.estimate_homographies(m, 320, 240).first() == matching.estimate_homographies(m.repartition(3), 320, 240).first()


def _places(spark, rows):
    return spark.createDataFrame([(1, n, float(x), float(y)) for n, x, y in rows], "job_id int, representation string, x double, y double")


def test_consensus(spark):
    near = [("rgb", 1000, 500), ("structural", 1008, 494), ("map", 995, 505)]
    assert verdict.consensus(_places(spark, near), 40).first().agree
    far = [*near[:2], ("map", 1600, 900)]
    r = verdict.consensus(_places(spark, far), 40).first()
    assert not r.agree and r.max_offset > 600
    assert verdict.consensus(_places(spark, near[:1]), 40).first().agree


@pytest.mark.parametrize(
    ("status", "overall", "agree", "corroborating", "aux", "valid", "wanted"),
    [
        ("MATCH_FOUND", 0.30, True, [], 0, True, "NO_MATCH"),
        ("MATCH_FOUND", 0.70, False, [], 1, True, "LOW_CONFIDENCE"),
        ("MATCH_FOUND", 0.70, None, [], 0, True, "MATCH_FOUND"),
        ("LOW_CONFIDENCE", 0.63, True, ["map"], 1, True, "MATCH_FOUND"),
        ("NO_MATCH", 0.90, True, ["map"], 1, False, "NO_MATCH"),
        ("AMBIGUOUS", 0.90, True, ["map"], 1, True, "AMBIGUOUS"),
    ],
)
def test_regrade(spark, status, overall, agree, corroborating, aux, valid, wanted):
    df = spark.createDataFrame([(status, overall, agree, corroborating, aux, valid)], "s string, o double, a boolean, c array<string>, n int, v boolean")
    assert df.select(verdict.regrade(*map(F.col, "soacnv")).alias("r")).first().r == wanted


@pytest.mark.parametrize(("score", "runner", "wanted"), [(None, None, "NO_MATCH"), (0.39, None, "NO_MATCH"), (0.40, None, "LOW_CONFIDENCE"), (0.60, None, "MATCH_FOUND"), (0.70, 0.66, "AMBIGUOUS"), (0.75, 0.50, "MATCH_FOUND"), (0.44, 0.39, "LOW_CONFIDENCE")])
def test_status(spark, score, runner, wanted):
    s, r = (F.lit(v).cast("double") for v in (score, runner))
    assert one(spark, verdict.status(F.lit(score is not None), s, r)) == wanted


def test_corner_georeference(spark):
    corners = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in ((10.0, 20.0), (10.0, 21.0), (9.0, 21.0), (9.0, 20.0))])
    lat, lon = geo.corners_latlon(F.lit(50.0), F.lit(25.0), corners, F.lit(100.0), F.lit(100.0))
    assert one(spark, lat) == 9.75 and one(spark, lon) == 20.5
    assert one(spark, geo.corners_error(F.slice(corners, 1, 3), F.lit(1), F.lit(1))) == "needs_four_corners"


def test_broken_plans(spark):
    rows = [(1, "{"), (2, "[1]"), (3, "{}"), (4, '﻿{"mission": {"items": []}}'), (5, None)]
    got = {r.plan_id: r.error for r in mission.parse(spark.createDataFrame(rows, "plan_id int, body string")).collect()}
    assert got == {1: "invalid_json", 2: "not_an_object", 3: "no_mission", 4: None, 5: "invalid_json"}


def test_nested_items(spark):
    body = '''{"mission": {"items": [7, {"type": "SimpleItem", "command": 21, "params": [0, 0, 0, 0, 1.5, "2.5"], "Altitude": 9},
      {"type": "ComplexItem", "complexItemType": "survey", "Items": [{"type": "SimpleItem", "params": [0, 0, 0, 0, 0, 0, 4]}, {"type": "ComplexItem", "complexItemType": "corridor"}]}]}}'''
    parsed = mission.parse(spark.createDataFrame([(1, body)], "plan_id int, body string"))
    got = sorted((r.seq, r.command_name, r.latitude, r.longitude, r.altitude) for r in mission.waypoints(parsed).collect())
    assert got == [(2, "LAND", 1.5, 2.5, 9.0), (3, "CMD_0", None, None, 4.0)]
    r = mission.summary(parsed).first()
    assert (r.n_waypoints, r.n_positions) == (2, 1)
    assert r.warnings == ["No plannedHomePosition in this plan.", "Complex mission item 'corridor' was not expanded."]


def test_missions_nest_without_limit(spark):
    body = '{"mission":{"plannedHomePosition":[1,2,3],"items":[' + '{"type":"ComplexItem","Items":[' * 9 + '{"command":16,"params":[0,0,0,0,1.5,2.5,9]}' + "]}" * 9 + "]}}"
    parsed = mission.parse(spark.createDataFrame([(1, body), (2, '{"mission":5}'), (3, '{"mission":[]}'), (4, '{"mission":null}')], "plan_id int, body string"))
    assert {r.plan_id: r.error for r in parsed.collect()} == {1: None, 2: "no_mission", 3: "no_mission", 4: "no_mission"}
    assert [(r.plan_id, r.seq, r.latitude, len(r.path)) for r in mission.waypoints(parsed).collect()] == [(1, 1, 1.5, 10)]
    assert mission.summary(parsed).first().warnings == []


def test_two_hundred_levels_are_one_job(spark):
    deep = '{"command":21,"doJumpId":7,"params":[0,0,0,0,0.10,2e1,12345678901234567890]}'
    for i in range(200):
        inner = f'"Items":[{i}.50,{deep}]' if i % 3 else f'"TransectStyleComplexItem":{{"Items":[null,{deep}]}},"Items":[1,2,3]'
        deep = f'{{"type":"ComplexItem","complexItemType":"k{i}",{inner}}}'
    empty = '{"type":"ComplexItem","complexItemType":"survey","TransectStyleComplexItem":{"Items":[]},"Items":7}'
    body = f'{{"mission":{{"items":[{deep},{{"type":"ComplexItem","Items":[{empty}]}}]}}}}'
    parsed = mission.parse(spark.createDataFrame([(1, body)], "plan_id int, body string"))
    tracker, group = spark.sparkContext.statusTracker(), "missions"
    spark.sparkContext.setJobGroup(group, "")
    rows = mission.items(parsed).select("path", "is_complex", "n_inner", F.col("item").cast("string").alias("text")).collect()
    spark.sparkContext.setJobGroup("", "")
    assert len(tracker.getJobIdsForGroup(group)) == 1
    assert len(rows) == 1 + 2 * 200 + 2 and max(len(r.path) for r in rows) == 201
    assert sum(r.is_complex for r in rows) == 202 and {r.n_inner for r in rows} == {0, 1, 2}
    point = mission.waypoints(parsed).first()
    assert (point.seq, point.latitude, point.longitude, point.altitude, len(point.path)) == (7, 0.1, 20.0, 12345678901234567890.0, 201)
    assert mission.summary(parsed).first().warnings == [mission.NO_HOME, "Complex mission item 'survey' was not expanded."]


def test_search_in_blocks_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    bank = [(i, rng.normal(size=6).tolist()) for i in range(300)] + [(900, None), (901, [1.0]), (902, [0.0] * 6)]
    bank.append((903, bank[7][1]))
    frames = [(i, bank[i][1]) for i in range(0, 300, 30)] + [(7, bank[7][1]), (999, None)]
    unit = lambda v: np.array(v) / max(np.linalg.norm(v), 1e-8)
    wanted = {(f, rk + 1): t for f, q in frames if q for rk, (_, t) in enumerate(sorted((-round(float(unit(q) @ unit(v)), 12), t) for t, v in bank if v and len(v) == 6)[:4])}
    tiles, queries = spark.createDataFrame(bank, "tile_id long, embedding array<double>"), spark.createDataFrame(frames, "frame_id long, query array<double>")
    for block in (1000, 3):
        got = {(r.frame_id, r.rk): r.tile_id for r in retrieval.top_k_batch(tiles, queries, 4, block).collect()}
        assert got == wanted


def test_failing_sources_are_left_out(spark):
    def broken():
        raise RuntimeError("no backend")

    frame = spark.createDataFrame([(0, [1.0, 0.0])], "frame_id int, query array<double>")
    good, errors = retrieval.usable_sources([("rgb", frame, 3), ("map", broken, 3), ("structural", frame.withColumn("query", F.lit(None).cast("array<double>")), 3)])
    assert [name for name, _, _ in good] == ["rgb"] and errors == {"map": "no backend", "structural": "no vector"}
    with pytest.raises(RuntimeError):
        retrieval.usable_sources([("rgb", broken, 3)])


def test_georeferences(spark):
    kind = "kind string, north double, south double, west double, east double, corners array<array<double>>, width int, height int"
    rows = [("bbox", 2.0, 1.0, 0.0, 1.0, None, 10, 10), ("bbox", 1.0, 2.0, 0.0, 1.0, None, 10, 10), ("corners", None, None, None, None, [[1.0, 1.0]], 10, 10)]
    stored = spark.createDataFrame([(r,) for r in rows] + [(None,)], f"g struct<{kind.replace(' ', ':').replace(',:', ',')}>")
    assert [r.g is not None for r in stored.select(geo.georeference(F.col("g")).alias("g")).collect()] == [True, False, False, False]


def test_records(spark):
    maps = spark.sql("select 'm1' map_id, 'a/b/x.png' path, 'x.png' filename, 10 width, 20 height, 99L file_size, 5 tiles_generated, 'failed' embedding_status, 'classical' embedding_backend, 1.2345D index_seconds, cast(null as string) georeference, 'boom' error")
    r = registry.map_record(maps).first()
    assert (r.status, r.index_seconds, r.georeferenced, r.preview_url) == ("error", 1.23, False, "/files/uploads/x.png")
    frame = spark.sql("select 'd1' drone_id, 'a/y.png' path, 'y.png' filename, 30 width, stack(2, 20, 0) height, 9L file_size")
    assert [r.aspect_ratio for r in registry.frame_record(frame).collect()] == [1.5, 0.0]


BEST = "job_id int, similarity double, raw_matches int, inliers int, ratio double, error double, valid boolean, geo double, x double, y double, radius double"
ESTIMATE = "job_id int, representation string, raw_matches int, inliers int, ratio double, error double, valid boolean, geo double, x double, y double"


def test_cross_representation(spark):
    inf = float("inf")
    best = spark.createDataFrame([(1, 0.9, 80, 60, 0.75, 1.5, True, 0.8, 1000.0, 500.0, 40.0), (2, 0.5, 0, 0, 0.0, inf, None, None, None, None, 40.0)], BEST)
    found = [(1, "structural", 50, 30, 0.6, 2.0, True, 0.5, 1008.0, 494.0), (1, "map", 20, 4, 0.2, inf, False, 0.1, 1600.0, 900.0), (3, "map", 9, 9, 1.0, 1.0, True, 0.5, 1.0, 1.0)]
    rows = results.cross_representation(best, spark.createDataFrame(found, ESTIMATE))
    got = {(r.job_id, r.representation): r for r in rows.collect()}
    assert set(got) == {(1, "rgb"), (1, "structural"), (1, "map"), (2, "rgb")}  # job 3 has no winning place
    assert got[1, "map"].x is None and got[1, "map"].error is None and not got[2, "rgb"].valid
    assert [round(got[1, n].weight, 6) for n in ("rgb", "structural", "map")] == [0.4, 0.25, 0.15]
    assert round(got[2, "rgb"].weight, 6) == round(0.4 / 0.6, 6)
    agreed = verdict.consensus(results.positions(rows), "tolerance")
    one = results.consensus(agreed).first()
    assert (one.job_id, one.agree, one.tolerance_px, one.offsets_px, one.participating) == (1, True, 40.0, {"structural": 10.0}, ["rgb", "structural"])
    assert one.positions == {"rgb": [1000.0, 500.0], "structural": [1008.0, 494.0]}
    assert not verdict.consensus(results.positions(results.cross_representation(best, spark.createDataFrame(found, ESTIMATE), tolerance=5.0)), "tolerance").first().agree
    none = results.cross_representation(best, spark.createDataFrame(found, ESTIMATE), weights={"rgb": -1.0})
    assert {round(r.weight, 6) for r in none.filter("job_id = 1").collect()} == {0.25}
    assert results.cross_representation(best.limit(0), spark.createDataFrame(found, ESTIMATE)).count() == 0


def test_fused_document(spark):
    best = spark.createDataFrame([(1, 0.9, 80, 60, 0.75, 1.5, True, 0.8, 1000.0, 500.0, 40.0)], BEST)
    found = [(1, "structural", 50, 30, 0.6, 2.0, True, 0.5, 1010.0, 500.0), (1, "map", 20, 14, 0.7, 1.0, True, 0.4, 1000.0, 560.0)]
    rows = results.cross_representation(best, spark.createDataFrame(found, ESTIMATE))
    agreed = verdict.consensus(results.positions(rows), "tolerance")
    offsets = rows.withColumn("verified", F.col("valid")).join(agreed.select("job_id", "offsets"), "job_id").withColumn("offset", F.try_element_at("offsets", F.col("representation")))
    base = best.select("job_id", F.lit(0.6).alias("base"), F.col("valid").alias("rgb_valid")).join(agreed.select("job_id", "agree"), "job_id")
    one = results.fused(verdict.fuse(base, offsets, "tolerance"), rows).first()
    bonus, penalty = 0.75 * 0.25 * 0.5 * 0.20, 0.5 * 0.15 * 0.35
    assert (one.applied_bonus, one.applied_penalty) == (round(bonus + 1e-12, 4), round(penalty + 1e-12, 4))
    assert one.overall == round(0.6 * (1 + bonus - penalty), 4) and one.base_rgb == 0.6
    assert (one.consensus, one.corroborating, one.dissenting) == (False, ["structural"], ["map"])
    assert one.components == {"map": 0.4, "rgb": 0.8, "structural": 0.5} and one.weights == {"map": 0.15, "rgb": 0.4, "structural": 0.25}


def test_feature_records(spark):
    rows = results.features(spark.createDataFrame([("a", "classical", 3000, 2048, 640, 480), ("b", None, None, None, None, None)], "image_id string, backend string, detected int, selected int, width int, height int"))
    assert [tuple(r) for r in rows.sort("image_id").collect()] == [("a", "classical", 3000, 2048, 640, 480), ("b", "unknown", 0, 0, 0, 0)]


def test_mission_documents(spark):
    import json

    plan = {"fileType": "Plan", "version": 1, "groundStation": "g", "mission": {"vehicleType": 2, "cruiseSpeed": 15, "hoverSpeed": "x", "items": [
        {"type": "SimpleItem", "command": 16, "params": [0, 0, 0, None, 12.5, 77.5, 30]}, {"type": "SimpleItem", "command": 22, "params": [0, 0, 0, None, 0, 0, 30]}]}}
    plan |= {"geoFence": {"polygons": [[], []]}, "rallyPoints": {"points": [1, 2, 3]}}
    bare = {"mission": {"items": []}}
    plans = spark.createDataFrame([("a", json.dumps(plan), "a.plan"), ("b", json.dumps(bare), None), ("c", "no json", "c"), ("d", None, "d")], "plan_id string, body string, filename string")
    got = {r.plan_id: json.loads(r.body) for r in mission.documents(mission.parse(plans)).collect()}
    assert set(got) == {"a", "b"}
    a = got["a"]
    assert (a["file_type"], a["version"], a["ground_station"], a["vehicle_type"], a["cruise_speed"]) == ("Plan", 1, "g", 2, 15.0)
    assert "hover_speed" not in a and "planned_home_position" not in a
    assert (a["filename"], a["geofence_polygons"], a["rally_points"]) == ("a.plan", 2, 3) and "filename" not in got["b"] and got["b"]["rally_points"] == 0
    assert a["waypoint_count"] == len(a["waypoints"]) == 2 and a["coordinates"] == [[12.5, 77.5]]
    assert a["bounds"] == {"north": 12.5, "south": 12.5, "west": 77.5, "east": 77.5}
    assert a["suggested_georeference"] == {"north": 12.5001, "south": 12.4999, "west": 77.4999, "east": 77.5001}
    assert got["b"]["waypoints"] == [] and "bounds" not in got["b"] and len(got["b"]["warnings"]) == 2


def test_numbers_run_through_each_split_in_name_order(spark):
    rng = random.Random(4)
    names = [None, "", "é", "z" * 50] + [f"{rng.randrange(300):03d}" for _ in range(500)]
    rows = [(rng.choice(("a", "b", None)), n, i) for i, n in enumerate(names)]
    frame = spark.createDataFrame(rows, "split string, name string, other int")
    for parts in (1, 7, 256):
        got = {(r.split, r.place): (r.name, r.other) for r in evaluation.numbered(frame, parts=parts).collect()}
        assert len(got) == len(rows)
        for split in ("a", "b", None):
            own = sorted(((n is not None, (n or "").encode(), i), n, i) for s, n, i in rows if s == split)
            assert [got[split, k] for k in range(len(own))] == [(n, i) for _, n, i in own]
    assert evaluation.numbered(frame.limit(0)).collect() == []


def test_the_next_place_of_every_candidate(spark):
    rng = random.Random(5)
    rows = [(j, c, rng.choice((0.1, 0.5, 0.9)), None if rng.random() < 0.2 else float(rng.randrange(6)), float(rng.randrange(6))) for j in range(30) for c in range(rng.randrange(1, 12))]
    frame = spark.createDataFrame(rows, "job_id int, candidate_id int, geo double, x double, y double")
    for radius in (0.0, 1.5, 3.0):
        got = {(r.job_id, r.candidate_id): r.runner_up for r in scoring.with_runner_up(frame, radius).collect()}
        for j, c, geo, x, y in rows:
            later = sorted(((-g, d, a, b) for k, d, g, a, b in rows if k == j and (-g, d) > (-geo, c)), key=lambda t: t[:2])
            other = [-g for g, _, a, b in ((g, d, a, b) for g, d, a, b in later) if not (radius > 0 and None not in (x, y, a, b) and ((a - x) ** 2 + (b - y) ** 2) ** 0.5 <= radius)]
            assert got[j, c] == (other[0] if other else None)


def test_ground_truth_documents_read_back(spark, tmp_path):
    cases = [("m.jpg", "b.jpg", None, 3.0, 4.0, False), ("m.jpg", "a.jpg", "turned", None, None, True), ("other.jpg", "c.jpg", None, 1.5, 2.0, False)]
    maps = [("m.jpg", 640, 480, (12.9, 12.8, 77.5, 77.6)), ("bare.jpg", 10, 10, None), ("other.jpg", 5, 5, None)]
    frame = spark.createDataFrame(cases, "reference_map string, file string, note string, expected_x double, expected_y double, expect_no_match boolean")
    of = spark.createDataFrame(maps, "reference_map string, map_width int, map_height int, georeference_hint struct<north:double,south:double,west:double,east:double>")
    documents = evaluation.truth_documents(frame, of)
    for i, r in enumerate(documents.orderBy("reference_map").collect()):
        (tmp_path / f"truth{i}.json").write_text(json.dumps(json.loads(r.value), indent=2))
    got = sorted((r.reference_map, r.item_id, r.note, r.expected_x, r.expect_no_match, r.map_width, r.georeference_hint and r.georeference_hint.north) for r in evaluation.read_truth(spark, str(tmp_path)).collect())
    assert got == [("m.jpg", "a.jpg", "turned", None, True, 640, 12.9), ("m.jpg", "b.jpg", None, 3.0, False, 640, 12.9), ("other.jpg", "c.jpg", None, 1.5, False, 5, None)]
    (tmp_path / "broken.json").write_text("{")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        evaluation.read_truth(spark, str(tmp_path)).collect()


def test_items_whose_run_failed_are_rows_with_an_error(spark):
    items = spark.createDataFrame([(1, 1.0, 1.0, False), (2, 1.0, 1.0, False), (3, 0.0, 0.0, True)], "item_id int, expected_x double, expected_y double, expect_no_match boolean")
    found = spark.createDataFrame([(1, "MATCH_FOUND", 1.0, 1.0, "decoder failed"), (3, "NO_MATCH", None, None, None)], "item_id int, status string, x double, y double, error string")
    got = sorted((r.item_id, r.failed, r.error_px, r.correct, r.error) for r in evaluation.score_items(items, found, 5).collect())
    assert got == [(1, True, None, None, "decoder failed"), (2, True, None, None, evaluation.NO_RESULT), (3, False, None, True, None)]


def test_georeferences_from_text(spark):
    good = '{"kind":"bbox","north":2.0,"south":1.0,"west":3.0,"east":4.0,"width":100,"height":50}'
    texts = [good, good.replace("2.0", "0.5"), "{", "[1]", None, '{"kind":"corners"}', good.replace("100", "0")]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", geo.restored(F.col("text")).alias("g")).orderBy("i").collect()
    assert [r.g is not None for r in rows] == [True] + [False] * 6 and rows[0].g.north == 2.0


def test_corners_of_clusters(spark):
    box = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    rows = [(1, 0, True, 3, 5.0, 5.0, box), (1, 0, True, 0, 9.0, 1.0, [(x + 4, y) for x, y in box]), (1, 0, False, 9, 0.0, 0.0, box), (1, 1, True, 2, 1.0, 1.0, box[:3]), (1, 2, True, 2, None, 1.0, box)]
    frame = spark.createDataFrame(rows, "job_id int, cluster_id int, valid boolean, inliers int, x double, y double, corners array<struct<x:double,y:double>>")
    got = {r.cluster_id: r for r in clustering.weighted_geometry(frame).collect()}
    assert set(got) == {0, 1} and (got[0].center_x, got[0].center_y) == (6.0, 4.0) and got[1].corners is None
    assert [tuple(c) for c in got[0].corners] == [(1.0, 0.0), (2.0, 0.0), (2.0, 1.0), (1.0, 1.0)]
