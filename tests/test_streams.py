"""Jobs, index waits and the index service as streams over files, against their batch twins."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyfix.sources import images
from skyfix.streaming import indexing, jobs

LOG = "job_id long, key string, state string, detail string, ts timestamp, seq long"


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def fed(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _log(seed, n=400):
    """Jobs of some stages each: some end, some fall silent, some begin again."""
    rng, out = random.Random(seed), []
    for job in range(n // 8):
        t = rng.randrange(20_000)
        for _ in range(rng.randrange(1, 9)):
            t += rng.choice((1, 30, 200, 899, 900, 901, 3000))
            key = rng.choice(("load", "match", "verify", None))
            out.append((job, key, rng.choice(("running", "done", "error", "queued")), rng.choice(("", None, "x", "y")), at(t), len(out)))
    return out


def _run_stream(spark, tmp_path, batches, late, **more):
    folder, running, sizes = str(tmp_path / "in"), None, []
    with jobs.rocksdb(spark, 2):
        try:
            for rows in batches:
                fed(spark, folder, rows, LOG)
                if running is None:
                    stream = jobs.stream_runs(spark.readStream.schema(LOG).parquet(folder), late=late, **more)
                    running = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).start()
                running.processAllAvailable()
                sizes.append(running.lastProgress["stateOperators"][0]["numRowsTotal"])
        finally:
            running.stop()
    return rows_of(spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))), sizes


def test_late_repeated_and_disordered_rows_give_the_batchs_runs(spark, tmp_path):
    rows = sorted(_log(1), key=lambda r: r[4])
    rng = random.Random(2)
    late = sorted(rows, key=lambda r: r[4] + dt.timedelta(seconds=rng.randrange(3_500)))  # within the watermark's hour
    batches = [late[i : i + 90] for i in range(0, len(late), 90)]
    batches = [b + (batches[i - 1][-40:] if i else []) for i, b in enumerate(batches)]  # the newest rows of a file come once more
    got, _ = _run_stream(spark, tmp_path, batches, "2 hours")
    wanted = rows_of(jobs.runs(spark.createDataFrame(rows, LOG), late="2 hours"))
    assert got == wanted and len(got) > 50
    assert {r[3] for r in got} == {"done", "error"}


def test_a_silent_job_fails_and_rows_after_the_watermark_are_dropped(spark, tmp_path):
    first = [(1, "load", "running", "a", at(0), 1), (1, "match", "running", "", at(10), 2), (2, None, "running", None, at(5), 3), (3, "load", "done", "b", at(20), 4), (3, None, "done", None, at(30), 5)]
    got, _ = _run_stream(spark, tmp_path, [first, [(9, "x", "running", None, at(5_000), 6)], [(1, "match", "done", "too late", at(11), 7)], [(9, None, "done", None, at(5_001), 8), (8, "x", "queued", None, at(9_000), 9)]], "60 seconds")
    short = [(r[0], r[3], r[4], r[5], r[6], r[7], r[8], r[9]) for r in got]
    assert short == [
        (1, "error", 910.0, 1, "load", "running", "a", 0.0),
        (1, "error", 910.0, 2, "match", "error", jobs.SILENT, 900.0),
        (2, "error", 900.0, 1, "error", "error", jobs.SILENT, 0.0),
        (3, "done", 10.0, 1, "load", "done", "b", 0.0),
        (9, "done", 1.0, 1, "x", "running", None, 0.0),
    ]


def test_state_does_not_grow_with_the_jobs_seen(spark, tmp_path):
    batches = [[(100 * i + j, k, s, "d", at(2_000 * i + j + n), 0) for j in range(30) for n, (k, s) in enumerate((("load", "running"), ("load", "done"), (None, "done")))] for i in range(8)]
    got, sizes = _run_stream(spark, tmp_path, batches, "60 seconds")
    assert len({r[0] for r in got}) == 7 * 30
    assert max(sizes[2:]) <= sizes[1] * 1.2 and sizes[-1] < 300


def test_runs_of_odd_logs(spark):
    rows = [(None, "a", "done", "", at(0), 1), (1, "a", "done", "x", None, 1), (2, "a", "running", "p", at(0), None), (2, "a", "done", "", at(0), 1), (2, "a", "done", "", at(0), 1), (3, None, "error", "boom", at(1), 2), (4, None, "done", "", at(2), 3), (5, "z", "queued", None, at(99_999), 4)]
    got = [(r[0], r[3], *r[5:]) for r in rows_of(jobs.runs(spark.createDataFrame(rows, LOG), late="1 second"))]
    assert got == [(2, "error", 1, "a", "error", jobs.SILENT, 900.0), (3, "error", 1, "error", "error", "boom", 0.0), (4, "done", None, None, None, None, None)]
    assert jobs.runs(spark.createDataFrame([], LOG)).collect() == []


ASKED, TOLD = "request_id long, map_id long, ts timestamp", "map_id long, status string, error string, ts timestamp"


def _waits():
    asked = [(1, 1, at(100)), (2, 1, at(1_000)), (3, 2, at(100)), (4, 3, at(100)), (5, 3, at(2_000)), (6, 4, at(500)), (7, 5, at(100)), (8, 9, at(50)), (9, 1, at(100))]
    told = [(1, "indexing", None, at(50)), (1, "ready", None, at(400)), (2, "failed", "bad file", at(90)), (3, "indexing", None, at(10)), (3, "ready", None, at(1_001)), (4, "failed", "", at(600)), (4, "ready", None, at(700)), (5, "ready", None, at(99)), (5, "indexing", None, at(100))]
    return asked, told


def test_requests_wait_for_ready_failed_or_their_time(spark, tmp_path):
    asked, told = _waits()
    wanted = rows_of(indexing.wait(spark.createDataFrame(asked, ASKED), spark.createDataFrame(told, TOLD), memory="1 hour"))
    assert {(r[0], r[3], r[4], r[5]) for r in wanted} == {
        (1, "ready", None, 300.0), (9, "ready", None, 300.0), (2, "ready", None, 0.0), (3, "failed", "bad file", 0.0), (4, "timeout", indexing.NOT_READY, None), (5, "ready", None, 0.0),
        (6, "failed", indexing.FAILED, 100.0), (7, "timeout", indexing.NOT_READY, None), (8, "timeout", indexing.NOT_READY, None),
    }
    a, t = str(tmp_path / "asked"), str(tmp_path / "told")
    batches = [(asked[4:], told[:5]), (asked[:4], told[5:]), ([(100, 77, at(20_000))], [(77, "ready", None, at(20_000))]), ([(101, 77, at(30_000))], [(77, "ready", None, at(30_000))])]
    running = None
    try:
        for some, events in batches:
            fed(spark, a, some, ASKED)
            fed(spark, t, events, TOLD)
            if running is None:
                stream = indexing.stream_wait(spark.readStream.schema(ASKED).parquet(a), spark.readStream.schema(TOLD).parquet(t), memory="1 hour", late="2000 seconds")
                running = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).start()
            running.processAllAvailable()
    finally:
        running.stop()
    got = rows_of(spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).filter("request_id < 100"))
    assert got == wanted


MAPS = "map_id long, content binary, seq long"


def test_a_replayed_batch_leaves_one_row_for_each_map(spark, tmp_path):
    rng = np.random.default_rng(3)
    png = lambda h, w: bytearray(images.encode_png(rng.integers(0, 255, (h, w, 3), dtype=np.uint8)))
    folder, failures = str(tmp_path / "in"), [1]

    def between(batch):
        if batch == 1 and failures:
            failures.pop()
            raise RuntimeError("planted")

    service = indexing.IndexService(str(tmp_path / "index"), scales=(0.5, 0.9), between=between)
    start = lambda: spark.readStream.schema(MAPS).parquet(folder).writeStream.foreachBatch(service).option("checkpointLocation", str(tmp_path / "ck")).start()
    fed(spark, folder, [(1, png(70, 90), 1), (2, bytearray(b"no image"), 2), (3, None, 3)], MAPS)
    running = start()
    running.processAllAvailable()
    fed(spark, folder, [(2, png(80, 80), 4), (4, png(64, 64), 5), (4, png(66, 100), 6), (None, png(64, 64), 7)], MAPS)
    with pytest.raises(Exception, match="planted"):
        running.processAllAvailable()
    assert {r.map_id for r in service.bank(spark).collect()} == {1}  # tiles without a status do not count
    running = start()
    running.processAllAvailable()
    running.stop()
    status = {r.map_id: (r.status, r.error, r.tiles > 0, r.batch) for r in service.status(spark).collect()}
    assert status == {1: ("ready", None, True, 0), 2: ("ready", None, True, 1), 3: ("failed", "not an image that can be read", False, 0), 4: ("ready", None, True, 1)}
    assert spark.read.parquet(str(tmp_path / "index/status")).groupBy("map_id", "batch").count().filter("count > 1").isEmpty()
    bank = service.bank(spark)
    assert bank.groupBy("map_id", "tile_id").count().filter("count > 1").isEmpty() and bank.select(F.size("embedding")).distinct().collect()[0][0] == 208
    assert bank.filter("map_id = 4 AND x + width > 64").count() > 0  # the larger of its two images
