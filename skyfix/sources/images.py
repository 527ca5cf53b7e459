"""PNG images as rows: headers by expressions, pixels by numpy, and a writer."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def read_files(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """path, modificationTime, length, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def _uint32(content: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")


def header(files: DataFrame) -> DataFrame:
    """Adds width, height, channels and aspect (4 decimals), null where the content is no PNG; pixels are not decoded."""
    good = F.hex(F.substring("content", 1, 8)) == SIGNATURE.hex().upper()
    kind = F.conv(F.hex(F.substring(F.col("content"), 26, 1)), 16, 10).cast("int")
    channels = F.when(kind == 0, 1).when(kind == 2, 3).when(kind == 4, 2).when(kind == 6, 4)
    out = files.withColumns({"width": F.when(good, _uint32(F.col("content"), 17)), "height": F.when(good, _uint32(F.col("content"), 21)), "channels": F.when(good, channels)})
    return out.withColumn("aspect", F.round(F.col("width") / F.nullif(F.col("height"), F.lit(0)), 4))


def encode_png(pixels: np.ndarray) -> bytes:
    """An 8-bit grey, RGB or RGBA array as PNG."""
    h, w = pixels.shape[:2]
    c = 1 if pixels.ndim == 2 else pixels.shape[2]
    kind = {v: k for k, v in _CHANNELS.items()}[c]
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    rows = np.zeros((h, 1 + w * c), np.uint8)
    rows[:, 1:] = pixels.reshape(h, -1)
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray | None:
    """Height by width by channels; None for what is not an 8-bit, not interlaced PNG."""
    if data[:8] != SIGNATURE:
        return None
    at, body, head = 8, b"", None
    while at + 8 <= len(data):
        n, name = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        head = struct.unpack(">IIBBBBB", part) if name == b"IHDR" else head
        body += part if name == b"IDAT" else b""
        at += 12 + n
    if head is None or head[2] != 8 or head[3] not in _CHANNELS or head[6]:
        return None
    w, h, c = head[0], head[1], _CHANNELS[head[3]]
    try:
        raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * c)
    except (zlib.error, ValueError):
        return None
    out, above = np.zeros((h, w, c), np.int64), np.zeros((w, c), np.int64)
    for y in range(h):
        line, kind = raw[y, 1:].reshape(w, c).astype(np.int64), raw[y, 0]
        if kind == 0:
            now = line
        elif kind == 1:
            now = np.cumsum(line, axis=0) & 255
        elif kind == 2:
            now = (line + above) & 255
        else:
            now, left, corner = np.zeros((w, c), np.int64), np.zeros(c, np.int64), np.zeros(c, np.int64)
            for x in range(w):
                up = above[x]
                if kind == 3:
                    guess = (left + up) >> 1
                else:
                    p = left + up - corner
                    da, db, dc = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
                    guess = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, up, corner))
                left = now[x] = (line[x] + guess) & 255
                corner = up
        out[y] = above = now
    return out.astype(np.uint8)


RASTER = "path string, height int, width int, channels int, px binary"


def decode(files: DataFrame) -> DataFrame:
    """path, height, width, channels, px (row-major bytes); sizes are null where decoding fails."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                image = None if content is None else decode_png(bytes(content))
                rows.append((path, None, None, None, None) if image is None else (path, *image.shape, image.tobytes()))
            yield pd.DataFrame(rows, columns=["path", "height", "width", "channels", "px"]).astype({c: "Int32" for c in ("height", "width", "channels")})

    return files.select("path", "content").mapInPandas(run, RASTER)
