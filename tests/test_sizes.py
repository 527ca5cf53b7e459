"""Work and plans that must not outgrow the input."""

import json
import re
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from skyfix import queries
from skyfix.functions import text
from skyfix.operators import clustering, matching, raster, scoring, tiling, verdict
from skyfix.plans import results

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_images_are_described_by_kinds_of_pixels():
    rng = np.random.default_rng(2)
    for shape in ((8, 8, 1), (5, 9, 3), (1, 1, 1), (3, 224, 4)):
        images = rng.integers(0, 256, (2, *shape), dtype=np.uint8)
        got = raster.descriptors(images)
        for image, v in zip(images, got, strict=True):
            rgb = np.repeat(image, 3, axis=2) if shape[2] == 1 else image[..., :3]
            small = raster.area_resize(rgb, 224, 224)
            gx, gy = raster.sobel(raster.grey(small) / 255)
            size, turn, colour, wanted = np.hypot(gx, gy), (np.degrees(np.arctan2(gy, gx)) + 180) % 180, raster.hsv(small), []
            for y in range(0, 224, 56):
                for x in range(0, 224, 56):
                    at = slice(y, y + 56), slice(x, x + 56)
                    counts, _ = np.histogram(turn[at], 9, (0, 180), weights=size[at])
                    patch = colour[at]
                    wanted += [*(counts / max(counts.sum(), 1e-6)), patch[..., 0].mean() / 180, patch[..., 1].mean() / 255, patch[..., 2].mean() / 255, patch[..., 2].std() / 255]
            assert np.allclose(v, np.array(wanted) / max(np.linalg.norm(wanted), 1e-8), atol=1e-6)
    began = time.process_time()
    raster.descriptors(rng.integers(0, 256, (300, 8, 8, 1), dtype=np.uint8))
    assert time.process_time() - began < 5  # 0.1 s an image before


@pytest.mark.parametrize("largest, wanted", [("GB", ["1023.0 MB", "1.0 GB"]), ("MB", ["1023.0 MB", "1024.0 MB"])])
def test_sizes_stop_at_the_largest_unit(spark, largest, wanted):
    rows = spark.createDataFrame([(1023 << 20,), (1 << 30,)], "v long").select(text.byte_size(F.col("v"), largest).alias("t"))
    assert [r.t for r in rows.collect()] == wanted


def test_formatters_of_large_keys_match_their_sql(spark, tmp_path):
    from oracle import rows_of, rows_of_sql

    for name in "region nation customer supplier orders lineitem events documents embeddings pages benchmark labels conversations".split():
        (tmp_path / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    spark.read.parquet(f"{SF}/part.parquet").withColumn("p_partkey", F.col("p_partkey") + 1_099_000).coalesce(1).write.parquet(str(tmp_path / "p"))
    next((tmp_path / "p").glob("*.parquet")).rename(tmp_path / "part.parquet")
    assert rows_of(queries.formatters(spark, str(tmp_path))) == rows_of_sql(queries.SQL["formatters"], str(tmp_path))


@pytest.mark.parametrize("name", ["tile_grid", "region_filter", "region_fallback", "tile_center"])
def test_tiles_are_neither_sorted_nor_shuffled(spark, name):
    plan = plan_of(queries.QUERIES[name](spark, SF))
    assert "Window" not in plan and "Sort" not in plan
    assert len(re.findall(r"\bExchange\b", plan)) == 1 and plan.index("Generate") < plan.index("Exchange")  # the maps are dealt before they become tiles


def test_budget_shuffles_maps_and_not_tiles(spark):
    plan = plan_of(queries.tile_grid_budget(spark, SF))
    assert len(re.findall(r"\bExchange\b", plan)) == 1 and plan.rindex("Window") < plan.index("Generate") < plan.index("Exchange")


@pytest.mark.parametrize("most", [1, 2, 40, 400])
def test_budget_of_the_grid_is_that_of_its_tiles(spark, most):
    maps = spark.createDataFrame([(1, 800, 600), (2, 50, 3000), (4, 700, 700)], "map_id long, map_w int, map_h int")
    columns = ["map_id", "tile_id", "x", "y", "width", "height", "scale"]
    got, wanted = (sorted(map(tuple, df.select(columns).collect())) for df in (tiling.tile_grid(maps, max_tiles=most), tiling.within_budget(tiling.tile_grid(maps), most)))
    assert got == wanted and {r[0] for r in got} == {1, 2, 4}


def test_waits_read_no_frame_to_the_end_of_its_map(spark):
    assert "unboundedfollowing" not in plan_of(queries.index_wait(spark, SF)).lower()


def test_small_groups_are_solved_together():
    rng = np.random.default_rng(4)
    for n in (4, 7):
        q = rng.uniform(0, 600, (40, n, 2)).round()
        t = q * 1.1 + [30, 5] + rng.integers(0, 7, q.shape) / 7
        t[rng.random((40, n)) < 0.2] += 500
        q[0], q[1, 0], q[2, 1] = 5, np.nan, q[2, 0]
        for got, wanted in zip(matching.verified_alike(q, t, 640, 480), [matching.verified(a, b, 640, 480, 1) for a, b in zip(q, t, strict=True)], strict=True):
            assert got["rejection"] == wanted["rejection"] and got["inliers"] == wanted["inliers"] and got["cells"] == wanted["cells"]
            for k in ("error", "error_median", "error_p90", "h"):
                assert (got[k] is None) == (wanted[k] is None) and (got[k] is None or np.allclose(got[k], wanted[k], atol=1e-6))


def test_pixels_are_made_where_their_image_lies(spark):
    plan = plan_of(queries.drawn_figures(spark, SF))
    assert len(re.findall(r"\bExchange\b.*image_id", plan)) == 1 and plan.rindex("HashAggregate") < plan.index("REPARTITION_BY_NUM")


@pytest.mark.parametrize("name", ["cluster_aggregate", "cluster_rank", "best_cluster", "decide", "refine_set", "supporting_members", "result_document", "inlier_evidence", "project_clusters"])
def test_jobs_are_dealt_once(spark, name):
    plan = plan_of(queries.QUERIES[name](spark, SF))
    dealt = [line for line in plan.splitlines() if re.search(r"\bExchange\b", line)]
    assert all("REPARTITION_BY_NUM" in line and "l_orderkey" in line for line in dealt if "hashpartitioning" in line) and dealt


def test_nearest_descriptors_are_found_by_products():
    rng = np.random.default_rng(6)
    for n, kinds in ((90, None), (90, 2), (2, 2), (1, None)):
        q, t = ((rng.normal(size=(m, 8)) if kinds is None else rng.integers(0, kinds, (m, 8)).astype(float)) for m in (70, n))
        q[:4] = 1e8 + q[:4] * 1e-6
        t = np.concatenate([t, q[2:6], 1e160 * t[:1], np.full((1, 8), np.nan)])
        ids = rng.permutation(len(t))
        got = matching._two_nearest((1,), pd.DataFrame({"_id": range(70), "_vector": list(q)}), pd.DataFrame({"_id": ids, "_vector": list(t)}))
        with np.errstate(over="ignore"):
            far = np.sqrt(((q[:, None] - t[None]) ** 2).sum(axis=2))
        wanted = sorted((i, d, int(k)) for i in range(70) for d, k in sorted(zip(far[i], ids, strict=True))[:2] if np.isfinite(d))
        assert sorted(zip(got["query_id"], got["d"], got["target_id"], strict=True)) == wanted
    q = rng.normal(size=(2000, 64))
    assert sum(len(of) for of, _ in matching._contenders(q, q)) < 3 * len(q)  # every pair was measured before: 4,000,000


def test_outlines_read_their_runs_once(spark):
    plan = plan_of(queries.block_outlines(spark, SF))
    assert plan.count("FileScan") == 1 and len(re.findall(r"\bExchange\b", plan)) == 4 and "Join" not in plan


def test_masks_of_one_strip_take_no_rounds(spark):
    from pathlib import Path

    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.glob("*"))
    plan = plan_of(queries.mask_regions(spark, SF))
    assert set(shared.glob("*")) == before and "Join" not in plan and len(re.findall(r"\bExchange\b", plan)) == 3


@pytest.mark.parametrize("name", ["mask_regions", "block_outlines"])
def test_pixels_become_few_rows_before_they_are_shuffled(spark, name):
    """A task's pixels of a mask are two rows at most, where it had one for each of the 40 lines, and strips are dealt to as many tasks as read the table at least."""
    plan = plan_of(queries.QUERIES[name](spark, SF)).splitlines()
    dealt = [line for line in plan if re.search(r"\bExchange\b", line)]
    assert "REPARTITION_BY_NUM" in dealt[-2] and "strip" in dealt[-2] and "image_id" in dealt[-1] and "y#" not in dealt[-1]
    first = next(line for line in reversed(plan) if "HashAggregate" in line)
    assert first.count("partial_bit_or") == queries.BAND and queries.MASK_SIDE / queries.BAND <= 2


@pytest.mark.parametrize("name", ["plan_warnings", "plan_summary", "mission_documents"])
def test_plans_are_told_in_one_pass(spark, name):
    plan = plan_of(queries.QUERIES[name](spark, SF))
    assert plan.count("FileScan") == plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan and "Join" not in plan


@pytest.mark.parametrize("name", ["result_body", "result_document"])
def test_documents_find_their_clusters_once(spark, name):
    plan = plan_of(queries.QUERIES[name](spark, SF))
    assert plan.count("FileScan") == 1 and "Join" not in plan and len(re.findall(r"\bExchange\b", plan)) == 1


def test_documents_in_one_pass_are_those_of_the_joins(spark):
    rng, rows = np.random.default_rng(11), []
    some = lambda v: None if rng.random() < 0.15 else v
    for job in range(60):
        for k in range(int(rng.integers(1, 8))):
            n, near = int(rng.integers(1, 90)), float(rng.integers(0, 4) * 60)
            valid = some(bool(rng.random() < 0.5))
            partial = some(not valid and bool(rng.random() < 0.5))
            rows.append((job, k, int(rng.integers(0, 9)), some(float(rng.integers(0, 12)) / 11), n, n // 2, some(0.5), some(0.25 * k), some(float(rng.integers(0, 20)) / 3), valid, partial, some("odd"), some(0.1), some(near), some(near)))
    schema = "job_id long, candidate_id int, tile_id long, similarity double, raw_matches long, inliers int, ratio double, coverage double, error double, valid boolean, partial boolean, rejection string, shear double, x double, y double"
    order = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("geo"), "candidate_id"))
    for frame in (rows, []):
        scored = scoring.evaluate(spark.createDataFrame(frame, schema))
        cells = clustering.assign(scoring.finalize(scored, queries.RADIUS).withColumn("order", order), queries.RADIUS)
        ranked = clustering.rank(clustering.aggregate(cells))
        best = clustering.best(ranked)
        listed = results.with_clusters(results.candidates(cells), cells, ranked)
        wanted = results.document(verdict.decide(ranked), best, clustering.weighted_center(cells), listed, ranked, results.supporting_members(cells, best))
        got = results.documents_of(cells)
        assert got.columns == wanted.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, wanted.collect()), key=repr)


def test_documents_hold_every_candidate_and_cluster(spark):
    rows = {r.job_id: json.loads(r.body) for r in queries.result_document(spark, SF).collect()}
    wanted = {}
    for r in queries.cluster_assign(spark, SF).collect():
        wanted.setdefault(r.job_id, set()).add((r.candidate_id, r.cluster_id))
    assert {j: {(c["candidate_id"], c["cluster_id"]) for c in b["candidates"]} for j, b in rows.items()} == wanted
    assert {j: {c["cluster_id"] for c in b["location_clusters"]} for j, b in rows.items()} == {j: {c for _, c in own} for j, own in wanted.items()}
    assert all(len(c["components"]) == 5 for b in rows.values() for c in b["candidates"])
