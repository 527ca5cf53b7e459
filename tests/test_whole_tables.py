"""Queries without a twin cover every row of their tables."""

from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from skyfix import queries
from skyfix.operators import matching
from skyfix.sources import registry

SF = "/root/testdata/sf0.001"


def test_every_correspondence_is_in_its_candidates_group(spark):
    wanted = spark.read.parquet(f"{SF}/lineitem.parquet").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).collect()
    got = queries.ransac_homography(spark, SF).select("group", "raw_matches").collect()
    assert sorted((r["group"], r.raw_matches) for r in got) == sorted((r.l_orderkey, r.n) for r in wanted)


def test_every_embedding_gets_a_descriptor(spark):
    ids = {str(r.vec_id) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").collect()}
    assert {r.path for r in queries.classical_descriptor(spark, SF).select("path").collect()} == ids


def test_small_groups_try_every_four():
    rng = np.random.default_rng(3)
    q = rng.uniform(0, 600, (7, 2))
    t = q + [100, 50]
    t[:2] += 300
    h, inside = matching.ransac(q, t, 7.5, seed=1)
    most = max((matching.transfer_errors(m, q, t) <= 7.5).sum() for f in combinations(range(7), 4) if (m := matching.solve_homography(q[list(f)], t[list(f)])) is not None)
    assert h is not None and inside.sum() >= most and inside[2:].all()


def test_blocks_of_descriptors_match_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(int(g), i, rng.integers(0, 4, 3).astype(float).tolist()) for i, g in enumerate(rng.choice([1, 2, 3], 240, p=[0.7, 0.29, 0.01]))]
    rows += [(None, 900, [1.0, 1.0, 1.0]), (1, 902, None), (4, 904, [0.0, 0.0, 0.0]), (1, 906, [float("nan")] * 3), (1, 908, [1.0])]
    sides = [[r for r in rows if r[1] % 2 == odd] for odd in (0, 1)]
    wanted = {}
    for g, i, d in sides[0]:
        mates = [r for r in sides[0] if r[0] == g and r[2] and len(r[2]) == len(d or [])]
        near = sorted((float(np.sqrt(((np.array(d) - x) ** 2).sum())), j) for h, j, x in sides[1] if h == g and d and x and len(x) == len(d)) if g else []
        if len(mates) > 1 and len(near) > 1 and near[0][0] < 0.9 * near[1][0]:
            wanted[(g, i, near[0][1])] = 1 - near[0][0] / max(near[1][0], 1e-6)
    schema = "group long, id long, descriptor array<double>"
    queries_, targets = (spark.createDataFrame(side, schema) for side in sides)
    for block in (7, 2048):
        got = {(r["group"], r.query_id, r.target_id): r.confidence for r in matching.knn_ratio_match(queries_, targets, 0.9, block).collect()}
        assert got.keys() == wanted.keys() and len(got) > 3
        assert all(abs(got[k] - wanted[k]) < 1e-9 for k in got)


def test_ids_do_not_change_between_runs(spark):
    made = [sorted(r.id for r in spark.range(20).repartition(n).select(registry.new_id("job", F.col("id")).alias("id")).collect()) for n in (1, 5)]
    assert made[0] == made[1] and len(set(made[0])) == 20 and all(i.startswith("job_") and len(i) == 16 for i in made[0])
