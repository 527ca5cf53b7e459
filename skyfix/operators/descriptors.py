"""Tile descriptors from summed-area tables.

Gradients are taken once for each pixel of a map, at the map's own resolution. For every orientation bin (and for hue, saturation, value and its square) a
two-dimensional prefix sum is kept at every pixel corner: sums along the lines, then down the columns, by two windows. A cell of a tile is then four look-ups,
however large it is and however many tiles overlap there; raster.descriptor resizes every tile and counts its pixels anew.

Images are lines of pixels: (image_id, y, r, g, b: arrays of numbers 0 to 255, all lines of an image equally long). Tiles are (image_id, tile_id, x, y, width,
height). A tile's sides are cut into `grid` cells at floor(side * i / grid).

Defined cases: a tile is cut to its image; a cell without pixels has zeros; a flat cell has shares of 0; a null or empty line is none; a one-pixel-wide image has no
gradient across. Lines of one image are ordered by one task, columns by another each; images and columns are spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRID, BINS = 4, 9
_FIGURES = ("hue", "saturation", "value", "square")


def _mirrored(line: Column, i: Column) -> Column:
    """The number at place i of a line that is mirrored at its ends, without doubling them."""
    n = F.size(line)
    j = F.abs(i)
    return F.coalesce(F.get(line, F.when(j >= n, 2 * n - 2 - j).otherwise(j)), F.get(line, F.greatest(F.lit(0), F.least(i, n - 1))))


def gradients(lines: DataFrame, bins: int = BINS) -> DataFrame:
    """image_id, y, x, weight, bin, hue (0 to 180), saturation, value of every pixel: size and unsigned direction of the Sobel gradient of the grey value (0 to 1)."""
    full = lines.filter("image_id IS NOT NULL AND y IS NOT NULL").filter(F.size("r") > 0)
    rgb = F.arrays_zip("r", "g", "b")
    # in thousandths, so that whole pixels have whole gradients and a direction does not hang on a rounding
    grey = F.transform(rgb, lambda p: 299 * p["r"].cast("double") + 587 * p["g"] + 114 * p["b"])
    rows = full.select("image_id", "y", grey.alias("at"), rgb.alias("rgb"))
    by_line = Window.partitionBy("image_id").orderBy("y")
    up, down = F.lag("at").over(by_line), F.lead("at").over(by_line)
    rows = rows.select("*", F.coalesce(up, down, F.col("at")).alias("up"), F.coalesce(down, up, F.col("at")).alias("down"))
    column = lambda i: _mirrored(F.col("up"), i) + 2 * _mirrored(F.col("at"), i) + _mirrored(F.col("down"), i)
    row = lambda line, i: _mirrored(F.col(line), i - 1) + 2 * F.get(F.col(line), i) + _mirrored(F.col(line), i + 1)
    places = F.sequence(F.lit(0), F.size("at") - 1)
    pixel = F.transform(places, lambda i: F.struct(i.alias("x"), (column(i + 1) - column(i - 1)).alias("gx"), (row("down", i) - row("up", i)).alias("gy"), F.get("rgb", i).alias("p")))
    rows = rows.select("image_id", "y", F.inline(pixel)).select("image_id", "y", "x", "gx", "gy", *[F.col(f"p.{c}").cast("double").alias(c) for c in "rgb"])
    turn = F.pmod(F.degrees(F.atan2("gy", "gx")) + 180, F.lit(180.0))
    high, low = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    span = F.nullif(high - low, F.lit(0.0))
    r, g, b = map(F.col, "rgb")
    hue = F.when(high == r, (g - b) / span).when(high == g, 2 + (b - r) / span).otherwise(4 + (r - g) / span) * 60
    return rows.select(
        "image_id", "y", "x", (F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")) / 255_000).alias("weight"), F.least(F.floor(turn / (180.0 / bins)), F.lit(bins - 1)).cast("int").alias("bin"),
        F.coalesce(F.pmod(hue, F.lit(360.0)) / 2, F.lit(0.0)).alias("hue"), F.coalesce(255 * (high - low) / F.nullif(high, F.lit(0.0)), F.lit(0.0)).alias("saturation"), high.alias("value"),
    )


def summed(pixels: DataFrame, bins: int = BINS) -> DataFrame:
    """image_id, x, y (a pixel's lower right corner, from 1) and the sums over all pixels left of and above it: b0, b1, ... and the figures."""
    names = [f"b{k}" for k in range(bins)] + list(_FIGURES)
    values = [F.when(F.col("bin") == k, F.col("weight")).otherwise(0.0) for k in range(bins)] + [F.col("hue"), F.col("saturation"), F.col("value"), F.col("value") * F.col("value")]
    rows = pixels.select("image_id", "y", "x", *(v.alias(n) for v, n in zip(values, names, strict=True)))
    along = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("image_id", "y", "x", *(F.sum(n).over(along).alias(n) for n in names))
    down = Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("image_id", (F.col("x") + 1).alias("x"), (F.col("y") + 1).alias("y"), *(F.sum(n).over(down).alias(n) for n in names))


def cells(tables: DataFrame, tiles: DataFrame, sizes: DataFrame, grid: int = GRID) -> DataFrame:
    """image_id, tile_id, cell (from 0, by rows), pixels, and the cell's sums (sizes: image_id, width, height)."""
    sums = [c for c in tables.columns if c not in ("image_id", "x", "y")]
    own = tiles.select("image_id", "tile_id", "x", "y", F.col("width").alias("w"), F.col("height").alias("h")).join(sizes.select("image_id", "width", "height"), "image_id")
    cut = lambda start, side, i, most: F.greatest(F.lit(0), F.least(start + F.floor(side * i / grid).cast("int"), most))
    box = lambda i, j: F.struct((j * grid + i).alias("cell"), cut(F.col("x"), F.col("w"), i, F.col("width")).alias("x0"), cut(F.col("x"), F.col("w"), i + 1, F.col("width")).alias("x1"), cut(F.col("y"), F.col("h"), j, F.col("height")).alias("y0"), cut(F.col("y"), F.col("h"), j + 1, F.col("height")).alias("y1"))
    all_cells = F.array(*(box(F.lit(i), F.lit(j)) for j in range(grid) for i in range(grid)))
    boxes = own.select("image_id", "tile_id", F.inline(all_cells)).withColumn("pixels", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    corner = lambda x, y, sign: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.lit(sign).alias("sign"))
    corners = boxes.select("image_id", "tile_id", "cell", "pixels", F.inline(F.array(corner("x1", "y1", 1), corner("x0", "y1", -1), corner("x1", "y0", -1), corner("x0", "y0", 1))))
    # corners on the upper and left rim have no row: their sums are zero
    met = corners.join(tables, ["image_id", "x", "y"], "left")
    of = met.groupBy("image_id", "tile_id", "cell").agg(F.first("pixels").alias("pixels"), *(F.sum(F.col("sign") * F.coalesce(c, F.lit(0.0))).alias(c) for c in sums))
    return of.select("image_id", "tile_id", "cell", "pixels", *(F.when(F.col("pixels") > 0, F.col(c)).otherwise(0.0).alias(c) for c in sums))


def figures(cell_sums: DataFrame, bins: int = BINS) -> DataFrame:
    """image_id, tile_id, cell, figures: the shares of the bins, and mean hue, saturation and value and the value's spread, each from 0 to 1."""
    weights = [F.greatest(F.col(f"b{k}"), F.lit(0.0)) for k in range(bins)]  # a difference of sums may fall short of zero by a rounding
    total = F.greatest(sum(weights[1:], weights[0]), F.lit(1e-6))
    mean = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("pixels")), F.lit(0.0))
    spread = F.sqrt(F.greatest(mean("square") - mean("value") * mean("value"), F.lit(0.0)))
    # sums that are nothing but roundings count as flat
    shares = [F.when(total > 1e-6, w / total).otherwise(0.0) for w in weights]
    return cell_sums.select("image_id", "tile_id", "cell", F.array(*shares, mean("hue") / 180, mean("saturation") / 255, mean("value") / 255, spread / 255).alias("figures"))


def describe(lines: DataFrame, tiles: DataFrame, grid: int = GRID, bins: int = BINS) -> DataFrame:
    """image_id, tile_id, embedding: each tile's figures of all its cells in order, brought to unit length."""
    sizes = lines.filter(F.size("r") > 0).groupBy("image_id").agg(F.max(F.size("r")).alias("width"), (F.max("y") + 1).alias("height"))
    of = figures(cells(summed(gradients(lines, bins), bins), tiles, sizes, grid), bins)
    listed = of.groupBy("image_id", "tile_id").agg(F.array_sort(F.collect_list(F.struct("cell", "figures"))).alias("c"))
    v = F.flatten("c.figures")
    norm = F.greatest(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-8))
    return listed.select("image_id", "tile_id", v.alias("v")).select("image_id", "tile_id", F.transform("v", lambda x: x / norm).alias("embedding"))
