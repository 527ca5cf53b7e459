"""Kernels over rasters (height, width, channels, px) with short exact numpy forms, as Arrow UDFs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SIDE, GRID, BINS = 224, 4, 9
#: Pixels of resized images that are looked at together.
_PIXELS = 1 << 20


def grey(rgb: np.ndarray) -> np.ndarray:
    return rgb if rgb.ndim == 2 else rgb[..., :3] @ np.array([0.299, 0.587, 0.114])


@lru_cache(64)
def _weights(n: int, m: int) -> np.ndarray:
    edge = np.linspace(0, n, m + 1)
    low, high = np.arange(n), np.arange(1, n + 1)
    cover = np.clip(np.minimum(edge[1:, None], high) - np.maximum(edge[:-1, None], low), 0, None)
    return cover / cover.sum(axis=1, keepdims=True)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the covered area of each target pixel, fractional borders weighted."""
    flat = image.reshape(*image.shape[:2], -1).astype(float)
    across = np.tensordot(_weights(image.shape[1], width), flat, (1, 1))  # width, y, channels
    return np.tensordot(_weights(image.shape[0], height), across, (1, 1)).reshape(height, width, *image.shape[2:])


@lru_cache(64)
def _lines(n: int) -> tuple[np.ndarray, ...]:
    """The SIDE lines that n lines are resized to, told once where they repeat.

    The weights of the different lines; for every place of three lines that differs from the others of its cell which of these stand before, at and
    after it, its cell, and how often it comes; how often each line stands in each cell.
    """
    w, line = np.unique(_weights(n, SIDE), axis=0, return_inverse=True)
    around = np.pad(line.ravel(), 1, mode="reflect")
    cell = np.arange(SIDE) // (SIDE // GRID)
    places, often = np.unique(np.stack([around[:-2], around[1:-1], around[2:], cell]), axis=1, return_counts=True)
    counts = np.zeros((GRID, len(w)))
    np.add.at(counts, (cell, around[1:-1]), 1.0)
    return w, *places, often, counts


def sobel(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = np.pad(g, 1, mode="reflect")
    smooth_y, smooth_x = p[:-2] + 2 * p[1:-1] + p[2:], p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    return smooth_y[:, 2:] - smooth_y[:, :-2], smooth_x[2:] - smooth_x[:-2]


def hsv(rgb: np.ndarray) -> np.ndarray:
    """Hue 0..180, saturation and value 0..255."""
    rgb = rgb.astype(float)
    high, low = rgb.max(axis=-1), rgb.min(axis=-1)
    span = np.where(high > low, high - low, 1)
    r, g, b = rgb[..., 0], rgb[..., 1], rgb[..., 2]
    hue = np.where(high == r, (g - b) / span, np.where(high == g, 2 + (b - r) / span, 4 + (r - g) / span)) * 60
    return np.stack([np.where(high > low, hue % 360, 0) / 2, np.where(high > 0, 255 * (high - low) / np.where(high > 0, high, 1), 0), high], axis=-1)


def descriptors(images: np.ndarray) -> np.ndarray:
    """descriptor() of images of one shape (images, height, width, channels).

    Where a small image is enlarged, lines and columns repeat: each kind of pixel is looked at once and counts as often as it comes.
    """
    (wy, up, row, down, cy, ny, at_y), (wx, left, col, right, cx, nx, at_x) = map(_lines, images.shape[1:3])
    step = max(1, _PIXELS // (len(row) * len(col)))
    if len(images) > step:
        return np.concatenate([descriptors(images[i : i + step]) for i in range(0, len(images), step)])
    flat = images[..., : 1 if images.shape[3] == 1 else 3].astype(float)
    small = np.einsum("nyxc,vx->nyvc", flat, wx, optimize=True)
    small = np.einsum("nyvc,uy->nuvc", small, wy, optimize=True)
    small = np.repeat(small, 3, axis=3) if small.shape[3] == 1 else small
    g = grey(small) / 255
    smooth_y, smooth_x = g[:, up] + 2 * g[:, row] + g[:, down], g[:, :, left] + 2 * g[:, :, col] + g[:, :, right]
    gx, gy = smooth_y[:, :, right] - smooth_y[:, :, left], smooth_x[:, down] - smooth_x[:, up]
    size, turn = np.hypot(gx, gy) * (ny[:, None] * nx), (np.degrees(np.arctan2(gy, gx)) + 180) % 180
    bins = np.searchsorted(np.linspace(0, 180, BINS + 1)[1:-1], turn, side="right")
    place = (np.arange(len(images))[:, None, None] * GRID**2 + cy[:, None] * GRID + cx) * BINS + bins
    counts = np.bincount(place.ravel(), size.ravel(), len(images) * GRID**2 * BINS).reshape(-1, GRID, GRID, BINS)
    colour, area = hsv(small), (SIDE // GRID) ** 2
    mean = np.einsum("iu,nuvc,jv->nijc", at_y, colour, at_x, optimize=True) / area
    spread = np.stack([np.einsum("u,nuv,v->n", at_y[i], (colour[..., 2] - mean[:, i, j, 2, None, None]) ** 2, at_x[j], optimize=True) for i in range(GRID) for j in range(GRID)], 1)
    spread = np.sqrt(spread.reshape(-1, GRID, GRID, 1) / area)
    shares = counts / np.maximum(counts.sum(axis=3, keepdims=True), 1e-6)
    v = np.concatenate([shares, mean / [180, 255, 255], spread / 255], axis=3).reshape(len(images), -1)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-8)


def descriptor(image: np.ndarray) -> np.ndarray:
    """The classical 208-number descriptor: per cell an orientation histogram and four colour figures, unit length."""
    return descriptors(image[None])[0]


def _pixels(row) -> np.ndarray:
    return np.frombuffer(row.px, np.uint8).reshape(row.height, row.width, row.channels)


def _each(rasters: DataFrame, schema: str, names: list[str], f: Callable) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([f(r) for r in frame.itertuples() if r.px is not None], columns=names)

    return rasters.mapInPandas(run, schema)


def embed(rasters: DataFrame) -> DataFrame:
    """path, embedding of every decoded raster; rasters of one shape are computed together."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame[frame["px"].notna()]
            for shape, rows in frame.groupby(["height", "width", "channels"]):
                many = max(1, _PIXELS * 16 // max(int(np.prod(shape)), 1))
                for i in range(0, len(rows), many):
                    part = rows.iloc[i : i + many]
                    images = np.stack([np.frombuffer(px, np.uint8) for px in part["px"]]).reshape(-1, *map(int, shape))
                    yield pd.DataFrame({"path": part["path"].to_numpy(), "embedding": list(descriptors(images).astype(np.float32))})

    return rasters.mapInPandas(run, "path string, embedding array<float>")


def embed_tiles(rasters: DataFrame, tiles: DataFrame) -> DataFrame:
    """map_id, tile_id, embedding: each map's raster (column map_id) cut into its tiles; an empty cut counts as black."""

    def cut(r):
        crop = _pixels(r)[r.y : r.y + r.tile_h, r.x : r.x + r.tile_w]
        return r.map_id, r.tile_id, descriptor(crop if crop.size else np.zeros((8, 8, 3), np.uint8)).astype(np.float32)

    boxes = tiles.selectExpr("map_id", "tile_id", "x", "y", "width tile_w", "height tile_h")
    return _each(rasters.join(boxes, "map_id"), "map_id int, tile_id int, embedding array<float>", ["map_id", "tile_id", "embedding"], cut)


def statistics(rasters: DataFrame) -> DataFrame:
    """path, mean, deviation (population), ink: mean and spread of the grey values, share of pixels over 0."""

    def measure(r):
        g = grey(_pixels(r)) if r.channels > 1 else _pixels(r)[..., 0]
        return r.path, round(float(g.mean()), 4), round(float(g.std()), 4), round(float((g > 0).mean()), 4)

    return _each(rasters, "path string, mean double, deviation double, ink double", ["path", "mean", "deviation", "ink"], measure)


def rotate(rasters: DataFrame, k: int) -> DataFrame:
    """Rasters after k quarter turns against the clock."""

    def turn(r):
        image = np.ascontiguousarray(np.rot90(_pixels(r), k))
        return r.path, *image.shape, image.tobytes()

    return _each(rasters, "path string, height int, width int, channels int, px binary", ["path", "height", "width", "channels", "px"], turn)


def split_pairs(rasters: DataFrame) -> DataFrame:
    """path, side, height, width, channels, px: both halves of side-by-side images (width within 4 of twice the height)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                if r.px is None or abs(r.width - 2 * r.height) > 4:
                    continue
                image, half = _pixels(r), r.width // 2
                for side, part in (("aerial", image[:, :half]), ("map", image[:, half : 2 * half])):
                    out.append((r.path, side, *part.shape, np.ascontiguousarray(part).tobytes()))
            yield pd.DataFrame(out, columns=["path", "side", "height", "width", "channels", "px"])

    return rasters.mapInPandas(run, "path string, side string, height int, width int, channels int, px binary")
