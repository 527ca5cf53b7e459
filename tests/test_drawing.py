"""Drawn pixels against plain loops, and drawings laid over rasters."""

import math

import numpy as np
from pyspark.sql import functions as F

from skyfix.operators import drawing

SIZES = "image_id long, width int, height int"


def shapes_of(spark, rows):
    return spark.createDataFrame([(i, z, kind, None if p is None else [tuple(q) if q else None for q in p], r, t, c, a) for i, z, kind, p, r, t, c, a in rows], drawing.SHAPE)


def plain_pixels(kind, points, radius, thickness, w, h):
    out, t, r = set(), max(thickness or 1, 1), max(radius or 0, 0)
    if kind in ("line", "ring"):
        ends = points + points[:1] if kind == "ring" or len(points) == 1 else points
        for (ax, ay), (bx, by) in zip(ends, ends[1:], strict=False):
            n = max(abs(bx - ax), abs(by - ay))
            for i in range(n + 1):
                x, y = (a if not n else a + (2 * (b - a) * i + n) // (2 * n) for a, b in ((ax, bx), (ay, by)))
                low = -((t - 1) // 2)
                out |= {(x + i, y + j) for i in range(low, low + t) for j in range(low, low + t)}
    for x in range(w):
        for y in range(h):
            d = math.hypot(x - points[0][0], y - points[0][1])
            if kind == "disc" and d <= r or kind == "circle" and max(r - t / 2, 0) <= d <= r + t / 2:
                out.add((x, y))
            if kind == "fill":
                left = sum(min(ay, by) <= y < max(ay, by) and ax + (y - ay) * (bx - ax) / (by - ay) <= x for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1], strict=True))
                if left % 2:
                    out.add((x, y))
    return {(x, y) for x, y in out if 0 <= x < w and 0 <= y < h}


def test_every_kind_of_shape(spark):
    w, h = 40, 30
    figures = [("line", [(2, 3), (35, 20), (5, 25)], None, None), ("line", [(7, 7)], None, 3), ("line", [(3, 3), (3, 3)], None, 1), ("ring", [(-5, 4), (20, -3), (45, 28)], None, 2), ("ring", [(1, 1), (9, 1), (9, 8), (1, 8)], None, 4)]
    figures += [("fill", [(1, 1), (30, 5), (12, 28)], None, None), ("fill", [(0, 0), (30, 25), (30, 0), (0, 25)], None, None), ("fill", [(5, 5), (5, 20)], None, None), ("fill", [(-9, -9), (60, -9), (60, 60), (-9, 60)], None, None)]
    figures += [("disc", [(10, 10)], 0, None), ("disc", [(10, 10)], 6, None), ("disc", [(0, 29)], 9, None), ("disc", [(5, 5)], -3, None), ("circle", [(20, 15)], 9, 2), ("circle", [(20, 15)], 9, 5), ("circle", [(3, 3)], 1, 4)]
    rows = [(1, z, kind, p, r, t, 7, 1.0) for z, (kind, p, r, t) in enumerate(figures)]
    odd = [(1, 90, "disc", [], 3, 1, 7, 1.0), (1, 91, "disc", None, 3, 1, 7, 1.0), (1, 92, "ring", [(1, 1), None], 3, 1, 7, 1.0), (1, 93, "ring", [(1, None)], 3, 1, 7, 1.0), (1, 94, "star", [(1, 1)], 3, 1, 7, 1.0), (2, 95, "disc", [(1, 1)], 3, 1, 7, 1.0)]
    got = {z: set() for z in range(len(figures))}
    for r in drawing.pixels(shapes_of(spark, rows + odd), spark.createDataFrame([(1, w, h)], SIZES)).collect():
        got[r.z].add((r.x, r.y))
    for z, (kind, p, r, t) in enumerate(figures):
        assert got[z] == plain_pixels(kind, p, r, t, w, h), (kind, p, r, t)


def test_layers_in_order_and_painting(spark):
    rows = [(1, 0, "fill", [(0, 0), (8, 0), (8, 6), (0, 6)], None, None, 0x640000, 0.5), (1, 5, "disc", [(4, 3)], 1, None, 0x0000FF, 1.0), (1, 9, "line", [(4, 3), (6, 3)], None, 1, 0x00FF00, 0.25), (1, 9, "line", [(4, 3), (4, 3)], None, 1, 0x00FE00, 0.25)]
    drawn = drawing.composited(drawing.pixels(shapes_of(spark, rows), spark.createDataFrame([(1, 10, 8)], SIZES)))
    got = {(r.x, r.y): (r.r, r.g, r.b, r.keep) for r in drawn.collect()}
    assert got[0, 0] == (50.0, 0.0, 0.0, 0.5) and got[4, 3] == (0.0, 63.75, 191.25, 0.0) and got[6, 3] == (37.5, 63.75, 0.0, 0.375) and (9, 7) not in got
    ground = np.full((8, 10, 1), 80, np.uint8)
    rasters = spark.createDataFrame([(1, 8, 10, 1, bytearray(ground.tobytes())), (2, 8, 10, 1, bytearray(ground.tobytes())), (3, 8, 10, 1, None)], "image_id long, height int, width int, channels int, px binary")
    painted = {r.image_id: np.frombuffer(r.px, np.uint8).reshape(r.height, r.width, r.channels) for r in drawing.paint(rasters, drawn).collect()}
    assert set(painted) == {1, 2} and (painted[2] == 80).all()
    assert painted[1][0, 0].tolist() == [90, 40, 40] and painted[1][3, 4].tolist() == [0, 64, 191] and painted[1][7, 9].tolist() == [80] * 3


def test_keypoints_polygons_markers(spark):
    sizes = spark.createDataFrame([(1, 1200, 800)], SIZES)
    points = spark.createDataFrame([(1, 1, 10.5, 20.5, 0.2), (1, 2, 11.0, 20.0, 0.9)], "image_id long, kp_id long, x double, y double, score double")
    shapes = [tuple(r) for r in drawing.keypoints(points, sizes).orderBy("z").collect()]
    assert [(s[2], s[3][0].x, s[3][0].y, s[4], s[6]) for s in shapes] == [("disc", 11, 20, 3, drawing.WHITE), ("disc", 11, 20, 2, drawing.RED), ("disc", 10, 20, 3, drawing.WHITE), ("disc", 10, 20, 2, drawing.RED)]
    regions = spark.createDataFrame([(1, [(1.4, 2.6), (50.0, 3.0), (40.0, 60.0)]), (1, [(1.0, 1.0)])], "image_id long, corners array<struct<x:double,y:double>>")
    assert [(r.kind, r.thickness, r.alpha, r.points[0].y) for r in drawing.polygons(regions, sizes).collect()] == [("fill", None, 0.22, 3), ("ring", 3, 1.0, 3)]
    marks = drawing.markers(spark.createDataFrame([(1, 100.4, 99.6)], "image_id long, x double, y double"), sizes).collect()
    assert [m.kind for m in marks] == ["circle", "circle", "line", "line", "line", "line", "disc"] and (marks[0].radius, marks[0].thickness, marks[1].thickness) == (9, 4, 2)
    assert [(p.x, p.y) for p in marks[2].points] == [(91, 100), (82, 100)]


def test_matches_on_a_canvas_and_the_result_map(spark):
    canvas = drawing.side_by_side(spark.createDataFrame([(1, 100, 50, 60, 81)], "image_id long, left_w int, left_h int, right_w int, right_h int"))
    assert tuple(canvas.first()) == (1, 184, 81, 15, 124, 0)
    lines = spark.createDataFrame([(1, 1, False, 1.0, 2.0, 3.0, 4.0), (1, 2, True, 5.5, 6.5, 7.0, 8.0)], "image_id long, place int, inlier boolean, qx double, qy double, tx double, ty double")
    got = [(r.z, r.kind, [(p.x, p.y) for p in r.points], r.colour) for r in drawing.matches(lines, canvas).orderBy("z", "points").collect()]
    assert got == [(2, "line", [(1, 17), (127, 4)], drawing.OUTLIER), (4, "line", [(6, 21), (131, 8)], drawing.INLIER), (5, "disc", [(6, 21)], drawing.RED), (5, "disc", [(131, 8)], drawing.RED)]
    sizes = spark.createDataFrame([(1, 3600, 1800), (2, 90, 90)], SIZES)
    places = "image_id long, box struct<x:int,y:int,width:int,height:int>, corners array<struct<x:double,y:double>>, x double, y double"
    rows = [(1, (10, 21, 100, 51), [(0.0, 0.0), (100.0, 0.0), (100.0, 101.0)], 50.0, 30.0), (2, None, None, None, None)]
    shapes, small = drawing.result_map(sizes, spark.createDataFrame(rows, places))
    assert sorted(map(tuple, small.collect())) == [(1, 1800, 900), (2, 90, 90)]
    kinds = shapes.filter("image_id = 1").groupBy("kind").count().collect()
    assert {k: n for k, n in kinds} == {"ring": 2, "fill": 1, "circle": 2, "line": 4, "disc": 1} and shapes.filter("image_id = 2").count() == 0
    box = shapes.filter("z = -1").first()
    assert [(p.x, p.y) for p in box.points] == [(5, 10), (55, 10), (55, 35), (5, 35)]
    ranked = spark.createDataFrame([(1, 10, 10, 20, 20, 1, 0.5), (1, 0, 0, 9, 9, 3, 0.5)], "image_id long, x int, y int, width int, height int, rank int, scale double")
    assert [(r.colour, r.thickness) for r in drawing.boxes(ranked).orderBy(F.desc("z")).collect()] == [(drawing.RED, 3), (drawing.GREY, 1)]
