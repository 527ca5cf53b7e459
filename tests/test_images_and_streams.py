"""Image sources and kernels on small rasters, and the stage log as a stream against the batch."""

import numpy as np
from pyspark.sql import functions as F

from skyfix.operators import raster
from skyfix.plans import evaluation
from skyfix.sources import images, registry
from skyfix.streaming import stages


def write_images(folder, arrays):
    for name, a in arrays.items():
        (folder / name).write_bytes(images.encode_png(a))
    (folder / "broken.png").write_bytes(b"no image")


def test_png_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    arrays = {"a.png": rng.integers(0, 255, (7, 5, 3), dtype=np.uint8), "b.png": rng.integers(0, 255, (4, 9), dtype=np.uint8)}
    write_images(tmp_path, arrays)
    files = images.read_files(spark, str(tmp_path))
    heads = {r.path.rsplit("/", 1)[1]: (r.width, r.height, r.channels) for r in images.header(files).collect()}
    assert heads == {"a.png": (5, 7, 3), "b.png": (9, 4, 1), "broken.png": (None, None, None)}
    pixels = {r.path.rsplit("/", 1)[1]: r for r in images.decode(files).collect()}
    assert pixels["broken.png"].px is None
    assert bytes(pixels["a.png"].px) == arrays["a.png"].tobytes() and bytes(pixels["b.png"].px) == arrays["b.png"].tobytes()


def test_png_filters():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 255, (6, 8, 3)).astype(np.int64)
    import struct
    import zlib

    rows = b""
    for y in range(6):
        kind = y % 5
        line = bytearray([kind])
        for x in range(8):
            for c in range(3):
                left, up = (image[y, x - 1, c] if x else 0), (image[y - 1, x, c] if y else 0)
                corner = image[y - 1, x - 1, c] if x and y else 0
                p = left + up - corner
                near = min((abs(p - v), i, v) for i, v in enumerate((left, up, corner)))[2]
                line.append(int(image[y, x, c] - [0, left, up, (left + up) // 2, near][kind]) & 255)
        rows += bytes(line)
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    data = images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 8, 6, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    assert (images.decode_png(data) == image).all()


def _rasters(spark, arrays):
    rows = [(i, n, a.shape[0], a.shape[1], a.shape[2], bytearray(a.tobytes())) for i, (n, a) in enumerate(arrays.items())]
    return spark.createDataFrame(rows, "map_id int, path string, height int, width int, channels int, px binary")


def test_kernels(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 255, (60, 90, 3), dtype=np.uint8)
    rasters = _rasters(spark, {"a": a})
    v = np.array(raster.embed(rasters).first().embedding)
    assert v.shape == (208,) and abs(np.linalg.norm(v) - 1) < 1e-5
    turned = raster.rotate(rasters, 1).first()
    assert (np.frombuffer(turned.px, np.uint8).reshape(90, 60, 3) == np.rot90(a)).all()
    figures = raster.statistics(rasters).first()
    assert abs(figures.mean - (a @ [0.299, 0.587, 0.114]).mean()) < 1e-3
    tiles = spark.createDataFrame([(0, 0, 0, 0, 30, 30), (0, 1, 80, 50, 30, 30), (0, 2, 200, 200, 5, 5)], "map_id int, tile_id int, x int, y int, width int, height int")
    assert raster.embed_tiles(rasters, tiles).count() == 3
    halves = raster.split_pairs(_rasters(spark, {"p": rng.integers(0, 255, (30, 60, 3), dtype=np.uint8), "q": a})).collect()
    assert [(r.path, r.side, r.width) for r in halves] == [("p", "aerial", 30), ("p", "map", 30)]


def test_area_resize_keeps_the_mean():
    a = np.random.default_rng(3).random((50, 70))
    assert abs(raster.area_resize(a, 224, 224).mean() - a.mean()) < 1e-9
    assert np.allclose(raster.area_resize(a, 25, 35), a.reshape(25, 2, 35, 2).mean(axis=(1, 3)))


def test_bank_cache(spark, tmp_path):
    bank = spark.createDataFrame([(1, 0, [1.0]), (2, 0, [2.0])], "map_id int, tile_id int, embedding array<double>")
    registry.save_bank(bank, str(tmp_path / "bank"))
    assert registry.load_bank(spark, str(tmp_path / "bank"), 2, lambda: None).first().embedding == [2.0]
    assert registry.load_bank(spark, str(tmp_path / "none"), 2, lambda: "rebuilt") == "rebuilt"
    assert registry.load_bank(spark, str(tmp_path / "bank"), 9, lambda: "rebuilt") == "rebuilt"
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_bytes(b"no table")
    assert registry.load_bank(spark, str(tmp_path / "broken"), 1, lambda: "rebuilt") == "rebuilt"


def test_calibration(spark):
    rows = [({"fx": "1", "fy": "2", "cx": "3", "cy": "4", "k1": "0.5"},), ({"fx": "x", "fy": "2", "cx": "3", "cy": "4"},), ({"fx": "1"},), (None,)]
    got = [r.c for r in spark.createDataFrame(rows, "raw map<string,string>").select(registry.calibration(F.col("raw")).alias("c")).collect()]
    assert got[0].k1 == 0.5 and got[0].k3 == 0.0 and got[1:] == [None, None, None]


def test_hash_split_is_about_the_share(spark):
    names = spark.range(4000).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))
    n = evaluation.hash_split(names, 0.25).filter("split = 'val'").count()
    assert 850 < n < 1150


def test_late_rows_are_dropped(spark, tmp_path):
    import datetime as dt

    schema = "ts timestamp, event_type string, value double"
    at = lambda h: dt.datetime(2024, 1, 1, h)
    folder = str(tmp_path / "in")
    out = stages.tumbling(spark.readStream.schema(schema).parquet(folder) if spark.createDataFrame([(at(0), "x", 1.0)], schema).coalesce(1).write.parquet(folder) is None else None, "1 hour")
    running = out.writeStream.outputMode("append").format("memory").queryName("hours").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        running.processAllAvailable()
        for h in (5, 0, 9):
            spark.createDataFrame([(at(h), "x", 1.0)], schema).coalesce(1).write.mode("append").parquet(folder)
            running.processAllAvailable()
        got = {r.start.hour: r.n for r in spark.table("hours").collect()}
    finally:
        running.stop()
    assert got == {0: 1, 5: 1}  # the second row of hour 0 came after the watermark
