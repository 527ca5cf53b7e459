"""Exact search in cells, and inverted lists against it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyfix import queries
from skyfix.operators import index, retrieval
from skyfix.sources import registry

BANK, FRAMES = "tile_id long, embedding array<float>", "frame_id long, query array<float>"


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def clustered(n, d=12, centres=20, seed=1):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, d))
    return (c[rng.integers(0, centres, n)] + 0.15 * rng.normal(size=(n, d))).astype(np.float32)


def frame(spark, vectors, schema, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(vectors)], schema)


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_cells_are_exact(spark, monkeypatch, block):
    monkeypatch.setattr(retrieval, "_ROWS", 16)
    rng = np.random.default_rng(0)
    bank = rng.integers(-2, 3, (90, 3)).astype(np.float32)  # many equal vectors and similarities
    asked = np.concatenate([bank[:9], np.zeros((1, 3), np.float32)])
    got = rows_of(retrieval.top_k_batch(frame(spark, bank, BANK), frame(spark, asked, FRAMES), 5, block))
    unit = lambda v: v / np.maximum(np.sqrt((v.astype(float) ** 2).sum(1)), 1e-8)[:, None]
    s = np.einsum("id,jd->ij", unit(asked), unit(bank))
    wanted = [(i, int(j), round(float(s[i, j]), 6), r + 1) for i in range(10) for r, j in enumerate(sorted(range(90), key=lambda j: (-s[i, j], j))[:5])]
    assert [(a, b, round(c, 6) + 0.0, d) for a, b, c, d in sorted(got, key=lambda r: (r[0], r[3]))] == [(a, b, c + 0.0, d) for a, b, c, d in wanted]


def test_scans_do_not_grow_with_the_frames(spark, tmp_path):
    frame(spark, clustered(300), BANK).write.parquet(str(tmp_path / "bank"))
    bank = spark.read.parquet(str(tmp_path / "bank"))
    many = frame(spark, clustered(60, seed=2), FRAMES)
    plan = retrieval.top_k_batch(bank, many, 3, block=4)._jdf.queryExecution().executedPlan().toString()
    few = retrieval.top_k_batch(bank, many.limit(1), 3, block=4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == few.count("FileScan") <= 3  # one to compare, the others (one exchange, reused) to count


@pytest.mark.parametrize("dims", [4, 12])
def test_recall_on_clustered_vectors_with_few_probes(spark, dims):
    bank, asked = frame(spark, clustered(3000, dims), BANK), frame(spark, clustered(3000, dims)[::30], FRAMES)
    fitted = index.fit(bank)
    found = {r[:2] for r in rows_of(index.search(index.build(bank, fitted), asked, fitted, 8))}
    true = {r[:2] for r in rows_of(retrieval.top_k_batch(bank, asked, 8))}
    assert len(found & true) >= 0.9 * len(true) and fitted.probes < len(fitted.centroids) / 3


def test_recall_of_the_query(spark):
    """The driver's vectors have no structure, so about half of the lists are looked at."""
    for sf in ("sf0.001", "sf0.01"):
        found = {r[:2] for r in rows_of(queries.QUERIES["ann_topk"](spark, f"/root/testdata/{sf}"))}
        true = {r[:2] for r in rows_of(queries.QUERIES["cosine_topk_batch"](spark, f"/root/testdata/{sf}"))}
        assert len(found) == len(true) and len(found & true) >= 0.9 * len(true)


def test_all_lists_are_the_exact_search(spark):
    vectors = clustered(400)
    bank = frame(spark, vectors, BANK).unionByName(spark.createDataFrame([(900, [0.0] * 12), (901, [1.0, 2.0]), (902, None), (None, [1.0, 2.0])], BANK))
    asked = frame(spark, vectors[:20], FRAMES).unionByName(spark.createDataFrame([(50, [1.0, 1.0]), (51, [0.0] * 12), (52, None)], FRAMES))
    fitted = index.fit(bank, lists=9)
    built = index.build(bank, fitted)
    assert built.count() == 402 and built.groupBy("tile_id").count().filter("count > 1").isEmpty()
    for block in (3, 1024):
        assert rows_of(index.search(built, asked, fitted, 6, probes=9, block=block)) == rows_of(retrieval.top_k_batch(bank, asked, 6))


def test_small_and_empty_banks(spark):
    none = spark.createDataFrame([], BANK)
    assert index.fit(none) is None and retrieval.top_k_batch(none, frame(spark, clustered(2), FRAMES), 3).collect() == []
    one = frame(spark, clustered(1), BANK)
    fitted = index.fit(one, lists=50)
    assert len(fitted.centroids) == 1
    assert [r[:2] for r in rows_of(index.search(index.build(one, fitted), frame(spark, clustered(2), FRAMES), fitted, 3))] == [(0, 0), (1, 0)]


def test_a_written_index_reads_the_lists_that_are_asked_for(spark, tmp_path):
    bank = frame(spark, clustered(500), BANK)
    fitted = index.fit(bank)
    index.build(bank, fitted).write.partitionBy("part").parquet(str(tmp_path / "lists"))
    built = spark.read.parquet(str(tmp_path / "lists"))
    asked = frame(spark, clustered(500)[:5], FRAMES)
    assert rows_of(index.search(built, asked, fitted, 4)) == rows_of(index.search(index.build(bank, fitted), asked, fitted, 4))
    assert built.select(F.countDistinct("part")).first()[0] > 5


def test_bucketed_tiles_and_bank_join_without_an_exchange(spark, tmp_path):
    tiles = spark.range(600).selectExpr("id % 23 AS map_id", "id AS tile_id", "id * 3 AS x")
    bank = spark.range(600).selectExpr("id % 23 AS map_id", "id AS tile_id", "array(cast(id AS float)) AS embedding")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = registry.save_bucketed(tiles, "bucketed_tiles", str(tmp_path / "tiles"), 6)
        right = registry.save_bucketed(bank, "bucketed_bank", str(tmp_path / "bank"), 6)
        joined = registry.tiles_with_bank(left, right)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        one = registry.tiles_with_bank(left.filter("map_id = 7"), right)
        assert sorted(map(tuple, one.select("tile_id", "x").collect())) == [(i, 3 * i) for i in range(7, 600, 23)]
        assert joined.count() == 600
        plain = registry.tiles_with_bank(tiles, bank)._jdf.queryExecution().executedPlan().toString()
        assert plain.count("Exchange") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        for name in ("bucketed_tiles", "bucketed_bank"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
