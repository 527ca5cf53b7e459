"""Summed-area descriptors against sums over the pixels of each cell."""

import numpy as np

from skyfix.operators import descriptors, raster

LINES, TILES = "image_id long, y int, r array<int>, g array<int>, b array<int>", "image_id long, tile_id int, x int, y int, width int, height int"


def lines_of(spark, images):
    return spark.createDataFrame([(i, y, *(line[:, c].tolist() for c in range(3))) for i, a in images.items() for y, line in enumerate(a)], LINES)


def plain(image, box, grid=4, bins=9):
    h, w = image.shape[:2]
    grey = image @ np.array([299, 587, 114])
    pad = np.pad(grey, 1, mode="reflect") if min(h, w) > 1 else np.pad(grey, 1, mode="edge")
    sy, sx = pad[:-2] + 2 * pad[1:-1] + pad[2:], pad[:, :-2] + 2 * pad[:, 1:-1] + pad[:, 2:]
    gx, gy = sy[:, 2:] - sy[:, :-2], sx[2:] - sx[:-2]
    size, turn = np.hypot(gx, gy) / 255_000, (np.degrees(np.arctan2(gy, gx)) + 180) % 180
    colour = raster.hsv(image)
    x, y, bw, bh = box
    out = []
    for j in range(grid):
        for i in range(grid):
            x0, x1, y0, y1 = (min(most, at + side * k // grid) for at, side, k, most in ((x, bw, i, w), (x, bw, i + 1, w), (y, bh, j, h), (y, bh, j + 1, h)))
            if x1 <= x0 or y1 <= y0:
                out += [0.0] * (bins + 4)
                continue
            at = slice(y0, y1), slice(x0, x1)
            counts, _ = np.histogram(turn[at], bins, (0, 180), weights=size[at])
            out += [*(counts / counts.sum() if counts.sum() > 1e-6 else 0 * counts), colour[at][..., 0].mean() / 180, colour[at][..., 1].mean() / 255, colour[at][..., 2].mean() / 255, colour[at][..., 2].std() / 255]
    v = np.array(out)
    return v / max(np.linalg.norm(v), 1e-8)


def test_tiles_equal_the_sums_over_their_pixels(spark):
    rng = np.random.default_rng(0)
    images = {1: rng.integers(0, 256, (33, 47, 3)), 2: np.full((9, 9, 3), 77), 3: rng.integers(0, 256, (1, 12, 3)), 4: np.indices((20, 20)).sum(0)[..., None].repeat(3, 2) * 6}
    boxes = {1: [(0, 0, 47, 33), (5, 7, 16, 16), (6, 7, 17, 13), (40, 30, 16, 16), (46, 32, 1, 1), (0, 0, 3, 3)], 2: [(0, 0, 9, 9), (2, 2, 4, 4)], 3: [(0, 0, 12, 1)], 4: [(0, 0, 20, 20), (3, 3, 8, 8)]}
    tiles = spark.createDataFrame([(i, n, *box) for i, some in boxes.items() for n, box in enumerate(some)], TILES)
    lines = lines_of(spark, images).unionByName(spark.createDataFrame([(5, 0, [], [], []), (6, 0, None, None, None)], LINES))
    got = {(r.image_id, r.tile_id): r.embedding for r in descriptors.describe(lines, tiles).collect()}
    assert len(got) == sum(map(len, boxes.values()))
    for i, some in boxes.items():
        for n, box in enumerate(some):
            assert len(got[i, n]) == 208
            np.testing.assert_allclose(got[i, n], plain(images[i], box), atol=1e-7, err_msg=f"{i} {box}")


def test_overlapping_tiles_share_the_tables(spark):
    """Four rows of the table for each cell, whatever its size."""
    image = np.random.default_rng(1).integers(0, 256, (40, 40, 3))
    tables = descriptors.summed(descriptors.gradients(lines_of(spark, {1: image})))
    assert tables.count() == 1600
    tiles = spark.createDataFrame([(1, n, n % 7, n % 5, 30, 30) for n in range(35)], TILES)
    sizes = spark.createDataFrame([(1, 40, 40)], "image_id long, width int, height int")
    of = descriptors.cells(tables, tiles, sizes)
    assert of.count() == 35 * 16 and {r.pixels for r in of.select("pixels").distinct().collect()} <= {7 * 7, 7 * 8, 8 * 8}
