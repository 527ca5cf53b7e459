"""The two solvers against planted homographies, and matching, turning back, solving and judging together."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyfix.operators import matching
from skyfix.plans import verification

H = np.array([[0.9, 0.2, 40.0], [-0.15, 1.05, 30.0], [1e-4, -5e-5, 1.0]])


def planted(rng, n, outliers, noise, h=H, w=640, ht=480):
    q = rng.random((n, 2)) * [w, ht]
    p = np.column_stack([q, np.ones(n)]) @ h.T
    t = p[:, :2] / p[:, 2:] + rng.normal(0, noise, (n, 2))
    wrong = rng.random(n) < outliers
    t[wrong] = rng.random((wrong.sum(), 2)) * [900, 700]
    return q, t


def corner_error(h, w=640, ht=480):
    c = np.array([[0, 0], [w, 0], [w, ht], [0, ht]], float)
    p = np.column_stack([c, np.ones(4)]) @ H.T
    return matching.transfer_errors(h, c, p[:, :2] / p[:, 2:]).mean()


def with_near_misses(rng, n, outliers, noise):
    """Half of the outliers lie a few pixels off, where a threshold takes them in."""
    q, t = planted(rng, n, 0.0, noise)
    wrong = rng.random(n) < outliers
    k = int(wrong.sum())
    t[wrong] = np.where((rng.random(k) < 0.5)[:, None], t[wrong] + rng.normal(0, 8, (k, 2)) + [6, 3], rng.random((k, 2)) * [900, 700])
    return q, t


@pytest.mark.parametrize(("points", "share"), [(planted, 0.0), (with_near_misses, 0.8)])
def test_marginal_consensus_beats_truncated_ransac_at_sixty_percent_outliers(points, share):
    marginal, truncated = [], []
    for seed in range(12):
        q, t = points(np.random.default_rng(seed), 200, 0.6, 1.0)
        marginal.append(corner_error(matching.marginal_consensus(q, t, 7.5, seed)[0]))
        truncated.append(corner_error(matching.ransac(q, t, 7.5, seed, rounds=1000)[0]))
    assert np.mean(marginal) < np.mean(truncated) and np.max(marginal) < 1.5
    assert np.mean(np.array(marginal) < np.array(truncated)) >= share


def test_exact_points_and_degenerate_ones():
    rng = np.random.default_rng(3)
    q, t = planted(rng, 60, 0.5, 0.0)
    h, inside = matching.marginal_consensus(q, t, 7.5, 1)
    assert corner_error(h) < 1e-6 and inside.sum() >= 25
    line = np.column_stack([np.arange(20.0), np.zeros(20)])
    assert matching.marginal_consensus(line, line, 7.5, 1)[0] is None
    assert matching.verified(line, line, 640, 480, 1)["rejection"] == "homography_failed"
    assert matching.verified(q[:3], t[:3], 640, 480, 1)["rejection"] == "too_few_matches"
    assert matching.support(np.array([0.0, 7.5, 7.6, np.inf]), 7.5).tolist()[2:] == [0.0, 0.0]


def test_verify_keeps_any_keys(spark):
    q, t = planted(np.random.default_rng(5), 50, 0.2, 0.0)
    rows = [("a", k, *map(float, (*a, *b))) for k in (1, 2) for a, b in zip(q, t, strict=True)] + [("b", 1, 1.0, 1.0, 2.0, 2.0), (None, 7, None, 1.0, 2.0, 2.0)]
    frame = spark.createDataFrame(rows, "name string, k int, qx double, qy double, tx double, ty double")
    found = {(r.name, r.k): r for r in verification.verify(frame, 640, 480).collect()}
    assert set(found) == {("a", 1), ("a", 2), ("b", 1), (None, 7)}
    assert found["b", 1].rejection == found[None, 7].rejection == "too_few_matches" and found[None, 7].raw_matches == 0
    assert corner_error(np.array(found["a", 1].h).reshape(3, 3)) < 1e-6
    again = {(r.name, r.k): r for r in verification.verify(frame.repartition(5), 640, 480).collect()}
    assert again == found
    with pytest.raises(Exception, match="columns qx, qy, tx, ty"):
        verification.verify(frame.drop("qx"), 640, 480)
    with pytest.raises(Exception, match="tells its candidates apart"):
        verification.verify(frame.select(*verification.POINTS), 640, 480)


@pytest.mark.parametrize("turns", [0, 1, 2, 3])
def test_planted_homographies_are_found_in_their_rotation(spark, turns):
    rng = np.random.default_rng(turns)
    q, t = planted(rng, 80, 0.0, 0.0)
    x, y = {0: (q[:, 0], q[:, 1]), 1: (q[:, 1], 639 - q[:, 0]), 2: (639 - q[:, 0], 479 - q[:, 1]), 3: (479 - q[:, 1], q[:, 0])}[turns]
    looks, noise = rng.normal(size=(80, 16)), rng.normal(size=(80, 16))
    frames = [(1, k, i, float(x[i]), float(y[i]), (looks[i] if k == turns else noise[i] + k).tolist()) for k in range(4) for i in range(80)]
    other = rng.normal(size=(80, 16)) * 3 + 9
    tiles = [(1, 5, i, float(t[i, 0]), float(t[i, 1]), looks[i].tolist()) for i in range(80)] + [(1, 6, i, float(t[i, 0]), float(t[i, 1]), other[i].tolist()) for i in range(80)]
    out = verification.match_then_verify(
        spark.createDataFrame(frames, "job_id long, rotation int, id long, x double, y double, descriptor array<double>"), spark.createDataFrame(tiles, "job_id long, candidate_id long, id long, x double, y double, descriptor array<double>"), 640, 480
    )
    got = {r.candidate_id: r for r in out.collect()}
    assert set(got) == {5, 6}
    assert (got[5].rotation, got[5].inliers, got[5].verdict, got[5].rejection) == (turns, 80, "verified", None)
    assert corner_error(np.array(got[5].h).reshape(3, 3)) < 1e-6
    assert not got[6].valid and got[6].rejection is not None
    assert out.filter(F.col("candidate_id") == 6).count() == 1
