"""The data source of image pairs and the sink of image files, over folders of the test."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from skyfix.sources import images, imagesets


def png(seed, h=4, w=6, c=3):
    return images.encode_png(np.random.default_rng(seed).integers(0, 255, (h, w, c), dtype=np.uint8))


def image_set(root):
    """train: 7 rows in two files of row groups of two; test: 3 rows of structs, one a path, one broken; val: none."""
    (root / "train").mkdir(parents=True)
    (root / "pictures").mkdir()
    (root / "pictures/a.png").write_bytes(png(100))
    raw = lambda ns: pa.table({"imageA": [png(n) for n in ns], "imageB": [png(50 + n) for n in ns], "other": ns})
    pq.write_table(raw([0, 1, 2, 3, 4]), root / "train/0.parquet", row_group_size=2)
    pq.write_table(raw([5, 6]), root / "train/1.parquet")
    kind = pa.struct([("bytes", pa.binary()), ("path", pa.string())])
    dicts = pa.table({"imageA": pa.array([{"bytes": png(7), "path": "x"}, {"bytes": None, "path": "pictures/a.png"}, {"bytes": None, "path": None}], kind), "imageB": pa.array([{"bytes": png(57), "path": None}, {"bytes": png(58), "path": None}, {"bytes": png(59), "path": None}], kind)})
    pq.write_table(dicts, root / "test-00000-of-00001.parquet")
    pq.write_table(raw([]).cast(pa.schema([("imageA", pa.binary()), ("imageB", pa.binary()), ("other", pa.int64())])), root / "val-0.parquet")
    (root / "notes.txt").write_text("no data")


def load(spark, root, **options):
    spark.dataSource.register(imagesets.ImagePairs)
    return spark.read.format("image_pairs").options(**options).load(str(root))


def test_pairs_of_all_splits(spark, tmp_path):
    image_set(tmp_path)
    rows = {r.number: r for r in load(spark, tmp_path).collect()}
    assert [(n, rows[n].split) for n in sorted(rows)] == [(0, "test"), (1, "test"), (2, "test")] + [(n, "train") for n in range(3, 10)]
    assert bytes(rows[0].aerial) == png(7) and bytes(rows[1].aerial) == png(100) and bytes(rows[9].map) == png(56)
    assert rows[2].aerial is None and "cannot decode" in rows[2].error and rows[3].error is None
    assert load(spark, tmp_path).rdd.getNumPartitions() == 5  # one for each row group that has rows


@pytest.mark.parametrize(("limit", "numbers", "groups"), [(2, [0, 1], 1), (3, [0, 1, 2], 1), (5, [0, 1, 2, 3, 4, 5, 6, 7], 4), (50, list(range(10)), 5)])
def test_the_limit_is_for_each_split(spark, tmp_path, limit, numbers, groups):
    image_set(tmp_path)
    out = load(spark, tmp_path, limit=limit)
    assert sorted(r.number for r in out.select("number").collect()) == numbers
    assert len(imagesets.row_groups(str(tmp_path), limit)) == groups


def test_named_splits_columns_and_an_empty_set(spark, tmp_path):
    image_set(tmp_path)
    out = load(spark, tmp_path, splits="val,train", limit=1, aerial="imageB", map="imageA").collect()
    assert [(r.split, r.number, bytes(r.aerial)) for r in out] == [("train", 0, png(50))]
    (tmp_path / "empty").mkdir()
    assert load(spark, tmp_path / "empty").collect() == []


def files_below(root):
    return sorted(str(p.relative_to(root)) for p in root.rglob("*") if p.is_file())


def test_numbered_files_of_a_set(spark, tmp_path):
    image_set(tmp_path / "in")
    spark.dataSource.register(imagesets.ImageFiles)
    pairs = load(spark, tmp_path / "in").filter("error IS NULL")
    for side in ("aerial", "map"):
        imagesets.numbered(pairs.select("number", F.col(side).alias("content"))).write.format("image_files").mode("append").save(str(tmp_path / "out" / side))
    names = [f"{n:06d}.png" for n in range(10) if n != 2]
    assert files_below(tmp_path / "out") == sorted(f"{side}/{n}" for side in ("aerial", "map") for n in names)
    assert (tmp_path / "out/map/000009.png").read_bytes() == png(56)


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    spark.dataSource.register(imagesets.ImageFiles)
    rows = spark.range(40).repartition(4).select(F.format_string("%03d.png", "id").alias("name"), F.when(F.col("id") != 33, F.lit(b"x")).alias("content"))
    root = tmp_path / "out"
    with pytest.raises(Exception, match="no content"):
        rows.write.format("image_files").mode("append").save(str(root))
    assert files_below(tmp_path) == []
    rows.filter("id <> 33").select("name", "content").write.format("image_files").mode("append").save(str(root))
    assert len(files_below(root)) == 39 and not any("_writing" in f for f in files_below(tmp_path))
    twice = spark.createDataFrame([("a.png", b"1"), ("a.png", b"2")], imagesets.FILE_SCHEMA)
    for bad in (twice, spark.createDataFrame([("../a.png", b"1")], imagesets.FILE_SCHEMA)):
        with pytest.raises(Exception, match="one name|not a file name"):
            bad.write.format("image_files").mode("append").save(str(root))
    assert len(files_below(tmp_path)) == 39
    spark.createDataFrame([("b/c.png", b"1")], imagesets.FILE_SCHEMA).write.format("image_files").mode("overwrite").save(str(root))
    assert files_below(root) == ["b/c.png"]


def test_renders_of_jobs(spark, tmp_path):
    grey, rgb = np.arange(12, dtype=np.uint8).reshape(3, 4, 1), np.arange(36, dtype=np.uint8).reshape(3, 4, 3)
    rows = [(7, "edges", 3, 4, 1, bytearray(grey.tobytes())), (7, "result", 3, 4, 3, bytearray(rgb.tobytes())), (7, "broken", 9, 9, 3, bytearray(b"12")), (8, "none", None, None, None, None)]
    frame = spark.createDataFrame(rows, "job_id int, name string, height int, width int, channels int, px binary")
    told = {(r.job_id, r.name): (r.path, r.error is None) for r in imagesets.save_renders(frame, str(tmp_path)).collect()}
    assert told == {("7", "edges"): ("7/edges.png", True), ("7", "result"): ("7/result.png", True), ("7", "broken"): (None, False)}
    assert files_below(tmp_path) == ["7/edges.png", "7/result.png"]
    assert (images.decode_png((tmp_path / "7/edges.png").read_bytes()) == np.repeat(grey, 3, axis=2)).all()
