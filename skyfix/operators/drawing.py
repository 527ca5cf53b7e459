"""Drawing as rows: shapes become pixels, pixels of one place are laid over each other, and what results is painted onto rasters.

Shapes are rows (SHAPE): a kind, its points in whole pixels, a radius or a thickness, a colour, how much it covers, and z, its place in the order of
drawing. Each kind is scan-converted on its own by expressions; composited() then folds the layers of every pixel, lowest first. Edges are not smoothed.

  line     from each point to the next: one pixel for each step of the longer axis, `thickness` pixels wide;
  ring     a closed line;
  fill     pixels whose centre lies inside the polygon by the even-odd rule (edges belong to the side on their right);
  disc     pixels within `radius` of the first point;
  circle   pixels whose distance from it is between radius - thickness / 2 and radius + thickness / 2.

Defined cases: a shape without points, with a null point or of another kind has no pixels; a thickness or radius below its least (1 and 0) counts as that;
pixels outside the image go; of shapes with one z on one pixel the largest colour wins. A shape's pixels are made by one task, an image's are painted by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHAPE = "image_id long, z long, kind string, points array<struct<x:int,y:int>>, radius int, thickness int, colour int, alpha double"

# Colours of the drawings, 0xRRGGBB, and how much a region's fill covers.
RED, LIGHT_RED, DARK, GREY, WHITE, INLIER, OUTLIER, GROUND = 0xE57373, 0xF6CACA, 0x2B2B2B, 0x777777, 0xFFFFFF, 0x5AAA78, 0xC8C8C8, 0xFAFAFA
FILL_ALPHA, GAP = 0.22, 24


# ---------------------------------------------------------------- scan conversion


def _floor(c: Column) -> Column:
    return F.floor(c).cast("int")


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))


def _edges(points: Column, closed: Column) -> Column:
    """a, b of each edge; a closed line comes back to its first point, a single point is an edge of its own."""
    ends = F.when(closed | (F.size(points) == 1), F.concat(points, F.slice(points, 1, 1))).otherwise(points)
    return F.transform(F.slice(ends, F.lit(1), F.size(ends) - 1), lambda p, i: F.struct(p.alias("a"), F.get(ends, i + 1).alias("b")))


def _line(e: Column) -> Column:
    a, b = e["a"], e["b"]
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    n = F.greatest(F.abs(dx), F.abs(dy))
    step = lambda d, i: F.when(n == 0, 0).otherwise(_floor((2 * d * i + n) / (2 * n)))
    return F.transform(F.sequence(F.lit(0), n), lambda i: _point(a["x"] + step(dx, i), a["y"] + step(dy, i)))


def _spans(points: Column) -> Column:
    """y, x0, x1 (inclusive) of the filled runs of a polygon."""
    edges = _edges(points, F.lit(True))
    ys = F.transform(points, lambda p: p["y"])

    def of_line(y: Column) -> Column:
        met = F.filter(edges, lambda e: (F.least(e["a"]["y"], e["b"]["y"]) <= y) & (y < F.greatest(e["a"]["y"], e["b"]["y"])))
        at = F.array_sort(F.transform(met, lambda e: e["a"]["x"] + (y - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]) / (e["b"]["y"] - e["a"]["y"])))
        even = F.filter(F.transform(at, lambda x, i: F.struct(x.alias("from"), F.get(at, i + 1).alias("to"), i.alias("i"))), lambda s: s["i"] % 2 == 0)
        return F.transform(even, lambda s: F.struct(y.alias("y"), F.ceil(s["from"]).cast("int").alias("x0"), (F.ceil(s["to"]) - 1).cast("int").alias("x1")))

    return F.filter(F.flatten(F.transform(F.sequence(F.array_min(ys), F.array_max(ys)), of_line)), lambda s: s["x0"] <= s["x1"])


def _disc(points: Column, radius: Column, hole: Column) -> Column:
    """y, x0, x1 of the runs within the radius, but for those nearer than the hole's (negative: none)."""
    centre, r = F.get(points, 0), F.greatest(radius, F.lit(0.0))

    def of_line(dy: Column) -> Column:
        half = _floor(F.sqrt(r * r - dy * dy))
        inner = F.when((hole > 0) & (F.abs(dy) < hole), F.ceil(F.sqrt(hole * hole - dy * dy)).cast("int"))  # the first column that is not in the hole
        run = lambda a, b: F.struct((centre["y"] + dy).alias("y"), (centre["x"] + a).cast("int").alias("x0"), (centre["x"] + b).cast("int").alias("x1"))
        return F.when(inner.isNull(), F.array(run(-half, half))).otherwise(F.array(run(-half, -inner), run(inner, half)))

    return F.filter(F.flatten(F.transform(F.sequence(-_floor(r), _floor(r)), of_line)), lambda s: s["x0"] <= s["x1"])


def pixels(shapes: DataFrame, sizes: DataFrame) -> DataFrame:
    """image_id, x, y, z, colour, alpha of every pixel of every shape inside its image (sizes: image_id, width, height)."""
    points, thick = F.col("points"), F.greatest(F.coalesce("thickness", F.lit(1)), F.lit(1))
    usable = shapes.filter(F.coalesce(F.size("points") > 0, F.lit(False)) & ~F.coalesce(F.exists("points", lambda p: p.isNull() | p["x"].isNull() | p["y"].isNull()), F.lit(False)))
    # few shapes become many pixels: they are dealt by image first, and an image's pixels stay where they are made
    of = usable.join(sizes.select("image_id", "width", "height"), "image_id").repartition(int(shapes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "image_id")
    keep = ("image_id", "width", "height", "z", "colour", "alpha")
    low = -_floor((thick - 1) / 2)
    stroke = lambda y, p: F.struct(y.alias("y"), (low + p["x"]).alias("x0"), (low + p["x"] + thick - 1).alias("x1"))
    brush = lambda p: F.transform(F.sequence(low + p["y"], low + p["y"] + thick - 1), lambda y: stroke(y, p))
    strokes = F.flatten(F.transform(F.flatten(F.transform(_edges(points, F.col("kind") == "ring"), _line)), brush))
    r, half = F.coalesce("radius", F.lit(0)).cast("double"), thick / 2
    spans = F.when(F.col("kind").isin("line", "ring"), strokes).when(F.col("kind") == "fill", _spans(points)).when(F.col("kind") == "disc", _disc(points, r, F.lit(-1.0))).when(F.col("kind") == "circle", _disc(points, r + half, r - half))
    runs = of.select(*keep, F.inline(spans))
    # cut to the image before columns are made of a run
    runs = runs.withColumns({"x0": F.greatest("x0", F.lit(0)), "x1": F.least("x1", F.col("width") - 1)}).filter("x0 <= x1 AND y >= 0 AND y < height")
    return runs.select("image_id", F.explode(F.sequence("x0", "x1")).alias("x"), "y", "z", "colour", "alpha").distinct()


def composited(laid: DataFrame) -> DataFrame:
    """image_id, x, y, r, g, b, keep: what is drawn on each pixel, and the share of the ground that shows through (paint() adds it)."""
    tops = laid.groupBy("image_id", "x", "y", "z").agg(F.max(F.struct("colour", F.coalesce("alpha", F.lit(1.0)).alias("alpha"))).alias("top"))
    layers = F.array_sort(F.collect_list(F.struct("z", "top.colour", "top.alpha")))
    part = lambda colour, shift: F.shiftright(colour, shift).bitwiseAND(F.lit(255)).cast("double")
    start = F.struct(*[F.lit(0.0).alias(c) for c in "rgb"], F.lit(1.0).alias("keep"))

    def over(under: Column, layer: Column) -> Column:
        mixed = [(layer["alpha"] * part(layer["colour"], shift) + (1 - layer["alpha"]) * under[c]).alias(c) for c, shift in zip("rgb", (16, 8, 0), strict=True)]
        return F.struct(*mixed, ((1 - layer["alpha"]) * under["keep"]).alias("keep"))

    return tops.groupBy("image_id", "x", "y").agg(layers.alias("layers")).select("image_id", "x", "y", F.aggregate("layers", start, over).alias("c")).select("image_id", "x", "y", "c.*")


def _paint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            image = np.frombuffer(row["px"], np.uint8).reshape(row["height"], row["width"], row["channels"])
            image = (np.repeat(image, 3, axis=2) if row["channels"] == 1 else image[..., :3]).astype(float)
            if row["drawn"]:
                x, y, r, g, b, keep = (np.array([p[c] for p in row["drawn"]]) for c in ("x", "y", "r", "g", "b", "keep"))
                image[y, x] = np.stack([r, g, b], axis=1) + keep[:, None] * image[y, x]
            out.append((row["image_id"], *image.shape, np.floor(np.clip(image, 0, 255) + 0.5).astype(np.uint8).tobytes()))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], ["image_id", "height", "width", "channels", "px"])


def paint(rasters: DataFrame, drawn: DataFrame) -> DataFrame:
    """image_id, height, width, channels (3), px of rasters (image_id, height, width, channels, px) with what is drawn on them. Those without pixels go."""
    own = drawn.groupBy("image_id").agg(F.collect_list(F.struct("x", "y", "r", "g", "b", "keep")).alias("drawn"))  # as many as the image has pixels at most
    rows = rasters.filter("px IS NOT NULL").select("image_id", "height", "width", "channels", "px").join(own, "image_id", "left")
    return rows.mapInArrow(_paint, "image_id long, height int, width int, channels int, px binary")


# ---------------------------------------------------------------- drawings: shapes from what the plans have selected


def _half_even(c: Column) -> Column:
    return F.rint(c).cast("int")


def shape(kind: str, z: Column, points: Column, colour: int | Column, radius: Column | None = None, thickness: Column | None = None, alpha: float = 1.0) -> Column:
    none = F.lit(None).cast("int")
    return F.struct(
        z.cast("long").alias("z"), F.lit(kind).alias("kind"), points.alias("points"), (none if radius is None else radius.cast("int")).alias("radius"),
        (none if thickness is None else thickness.cast("int")).alias("thickness"), (F.lit(colour) if isinstance(colour, int) else colour).cast("int").alias("colour"), F.lit(alpha).alias("alpha"),
    )


def _short_edge(share: float, least: int) -> Column:
    return F.greatest(F.lit(least), _half_even(F.least("width", "height") / share))


def keypoints(points: DataFrame, sizes: DataFrame) -> DataFrame:
    """Shapes of keypoints (image_id, kp_id, x, y, score), stronger ones first: a red dot on a white one."""
    place = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("score"), "kp_id")).cast("long")
    rows = points.withColumn("_z", 2 * place).join(sizes, "image_id")
    at, r = F.array(_point(_half_even(F.col("x")), _half_even(F.col("y")))), _short_edge(400, 1)
    return rows.select("image_id", F.inline(F.array(shape("disc", F.col("_z"), at, WHITE, r + 1), shape("disc", F.col("_z") + 1, at, RED, r))))


def polygons(regions: DataFrame, sizes: DataFrame, z: int = 0, alpha: float = FILL_ALPHA) -> DataFrame:
    """Shapes of polygons (image_id, corners: array of x, y in doubles): a thin fill and a solid outline; fewer than three corners are none."""
    rows = regions.filter(F.size("corners") >= 3).join(sizes, "image_id")
    at = F.transform("corners", lambda p: _point(_half_even(p["x"]), _half_even(p["y"])))
    return rows.select("image_id", F.inline(F.array(shape("fill", F.lit(z), at, RED, alpha=alpha), shape("ring", F.lit(z + 1), at, RED, thickness=_short_edge(300, 2)))))


def markers(points: DataFrame, sizes: DataFrame, z: int = 10) -> DataFrame:
    """Shapes of positions (image_id, x, y): a circle with a white rim, four ticks and a dot."""
    rows = points.join(sizes, "image_id")
    x, y, r = _half_even(F.col("x")), _half_even(F.col("y")), _short_edge(90, 8)
    t = F.greatest(F.lit(2), _floor(r / 5))
    centre = F.array(_point(x, y))
    ticks = [F.array(_point(x + a * r, y + b * r), _point(x + 2 * a * r, y + 2 * b * r)) for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1))]
    shapes = [shape("circle", F.lit(z), centre, WHITE, r, t + 2), shape("circle", F.lit(z + 1), centre, RED, r, t)]
    shapes += [shape("line", F.lit(z + 1), tick, RED, thickness=t) for tick in ticks] + [shape("disc", F.lit(z + 1), centre, RED, t)]
    return rows.select("image_id", F.inline(F.array(*shapes)))


def _rectangle(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.array(_point(x, y), _point(x + width, y), _point(x + width, y + height), _point(x, y + height))


def boxes(candidates: DataFrame) -> DataFrame:
    """Shapes of candidate boxes (image_id, x, y, width, height, rank; scale of the drawing): the first one red and thick, over the others."""
    at = [_floor(F.col(c) * F.col("scale")) for c in ("x", "y", "width", "height")]
    first = F.coalesce(F.col("rank") == 1, F.lit(False))
    own = shape("ring", F.when(first, 1_000_000).otherwise(-F.coalesce("rank", F.lit(0))), _rectangle(*at), F.when(first, RED).otherwise(GREY), thickness=F.when(first, 3).otherwise(1))
    return candidates.select("image_id", own.alias("s")).select("image_id", "s.*")


def side_by_side(pairs: DataFrame, gap: int = GAP) -> DataFrame:
    """image_id, width, height of the canvas of two images (image_id, left_w, left_h, right_w, right_h), and where each lies in it: left_dy, right_dx, right_dy."""
    height = F.greatest("left_h", "right_h")
    return pairs.select("image_id", (F.col("left_w") + gap + F.col("right_w")).alias("width"), height.alias("height"), _floor((height - F.col("left_h")) / 2).alias("left_dy"), (F.col("left_w") + gap).alias("right_dx"), _floor((height - F.col("right_h")) / 2).alias("right_dy"))


def matches(lines: DataFrame, canvas: DataFrame) -> DataFrame:
    """Shapes of matches (image_id, place, inlier, qx, qy, tx, ty; results.lines_to_draw) on a canvas: grey lines, and over them green ones with red dots."""
    rows = lines.join(canvas, "image_id")
    a = _point(_half_even(F.col("qx")), _half_even(F.col("qy")) + F.col("left_dy"))
    b = _point(_half_even(F.col("tx")) + F.col("right_dx"), _half_even(F.col("ty")) + F.col("right_dy"))
    z = 2 * F.col("place")
    good = F.array(shape("line", z, F.array(a, b), INLIER), *[shape("disc", z + 1, F.array(p), RED, F.lit(2)) for p in (a, b)])
    return rows.select("image_id", F.inline(F.when(F.col("inlier"), good).otherwise(F.array(shape("line", z, F.array(a, b), OUTLIER)))))


def fit_long_edge(sizes: DataFrame, most: int) -> DataFrame:
    """Adds scale: 1, or what brings the longer edge to `most`."""
    return sizes.withColumn("scale", F.least(F.lit(1.0), most / F.greatest("width", "height")))


def result_map(sizes: DataFrame, places: DataFrame, most: int = 1800) -> tuple[DataFrame, DataFrame]:
    """Shapes of the result on the scaled map, and the scaled maps' sizes. places: image_id, box (struct x, y, width, height), corners, x, y; each may be null."""
    scaled = fit_long_edge(sizes, most)
    small = scaled.select("image_id", _half_even(F.col("width") * F.col("scale")).alias("width"), _half_even(F.col("height") * F.col("scale")).alias("height"))
    rows = places.join(scaled.select("image_id", "scale"), "image_id")
    frame = rows.filter("box IS NOT NULL").select("image_id", shape("ring", F.lit(-1), _rectangle(*[_floor(F.col("box")[c] * F.col("scale")) for c in ("x", "y", "width", "height")]), GREY, thickness=F.lit(1)).alias("s")).select("image_id", "s.*")
    moved = rows.withColumn("corners", F.transform("corners", lambda p: F.struct((p["x"] * F.col("scale")).alias("x"), (p["y"] * F.col("scale")).alias("y"))))
    at = rows.filter("x IS NOT NULL AND y IS NOT NULL").select("image_id", (F.col("x") * F.col("scale")).alias("x"), (F.col("y") * F.col("scale")).alias("y"))
    return frame.unionByName(polygons(moved.select("image_id", "corners"), small)).unionByName(markers(at, small)), small
