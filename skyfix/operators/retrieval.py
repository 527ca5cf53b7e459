"""Exact vector retrieval: normalisation, cosine similarity and top-k."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Frames of a block, and rows of a block of the bank that are compared with it at once.
FRAMES, _ROWS = 1024, 2048


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(v: Column, floor: float = 1e-8) -> Column:
    """v over its norm, which counts as at least `floor`."""
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(floor))
    return F.transform(v, lambda x: x.cast("double") / norm)


def cosine(query: Column, vector: Column) -> Column:
    return F.round(dot(l2_normalise(query), l2_normalise(vector)), 6)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of unit length; a null or a vector of another width is all zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy())
    good = np.flatnonzero((size == width) & ~np.asarray(column.is_null()))
    out = np.zeros((len(column), width))
    flat = column.values.to_numpy(zero_copy_only=False).astype(float)
    out[good] = flat[column.offsets.to_numpy()[good][:, None] + np.arange(width)]
    return out / np.maximum(np.sqrt(np.einsum("ij,ij->i", out, out)), 1e-8)[:, None]


def _nearest(ids: np.ndarray, queries: np.ndarray, bank: Iterator[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """frame, tile, similarity of the k tiles of the bank that are most similar to each query, ties by tile; the bank comes in pieces of tiles and unit
    vectors. Equal tiles are one."""
    frame, tile, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for tiles, vectors in bank:
        # einsum, not a matrix product: equal vectors then have equal similarities, whatever rows they stand in
        here = np.einsum("id,jd->ij", queries, vectors)
        least = np.partition(here, -k, axis=1)[:, -k] if here.shape[1] > k else np.full(len(here), -np.inf)
        i, j = np.nonzero(here >= least[:, None])
        frame, tile, s = np.concatenate([frame, i]), np.concatenate([tile, tiles[j]]), np.concatenate([s, here[i, j]])
        order = np.lexsort((tile, -s, frame))
        frame, tile, s = frame[order], tile[order], s[order]
        first = np.searchsorted(frame, frame)  # where the row's frame begins
        kept = np.arange(len(frame)) - first < k
        frame, tile, s = frame[kept], tile[kept], s[kept]
    return ids[frame], tile, s


def _pieces(table: pa.Table, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for at in range(0, table.num_rows, _ROWS):
        part = table.slice(at, _ROWS)
        yield part.column("tile_id").to_numpy(), _matrix(part.column("embedding"), width)


def _cell(k: int):
    """The best tiles of a cell's bank block for each frame of its frame block."""

    def run(key: tuple, frames: pa.Table, bank: pa.Table) -> pa.Table:
        width = key[1].as_py()
        found = _nearest(frames.column("frame_id").to_numpy(), _matrix(frames.column("query"), width), _pieces(bank, width), k)
        return pa.table(dict(zip(("frame_id", "tile_id", "s"), found, strict=True)))

    return run


def _searched(bank: DataFrame, frames: DataFrame, k: int, block: int) -> DataFrame:
    """frame_id, tile_id, similarity, rk of frames (part, width, frame_id, query) against the rows of the bank (part, width, tile_id, embedding) of their part.

    Each side of a part is dealt to blocks of about `block` rows (frames) and 16 times as many (bank), and each pair of blocks is a task's cell, which k tiles of
    each frame leave. So no part is held whole, and the bank is shuffled once for every `block` frames that ask for a part.
    """
    count = lambda side, name: side.groupBy("part", "width").agg(F.count(F.lit(1)).alias(name))
    sizes = count(bank, "_b").join(count(frames, "_f"), ["part", "width"])
    sizes = sizes.select("part", "width", F.ceil(F.col("_b") / (16 * block)).cast("int").alias("_b"), F.ceil(F.col("_f") / block).cast("int").alias("_f"))

    def cells(side: DataFrame, ident: str, own: str, other: str):
        rows = side.join(sizes, ["part", "width"]).withColumn(f"{own}_at", F.pmod(F.xxhash64(ident), F.col(own)).cast("int"))
        rows = rows.withColumn(f"{other}_at", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        # new names, as both sides may come from one table
        rows = rows.select(*[F.col(c).alias(f"_{c}") for c in ("part", "width", "_b_at", "_f_at")], *[F.col(c).alias(c) for c in side.columns if c not in ("part", "width")])
        return rows.groupBy("_part", "_width", "__b_at", "__f_at")

    hits = cells(frames, "frame_id", "_f", "_b").cogroup(cells(bank, "tile_id", "_b", "_f")).applyInArrow(_cell(k), "frame_id long, tile_id long, s double")
    order = Window.partitionBy("frame_id").orderBy(F.desc("s"), "tile_id")
    return hits.withColumn("rk", F.row_number().over(order)).filter(F.col("rk") <= k).select("frame_id", "tile_id", F.round("s", 6).alias("similarity"), "rk")


def _vectors(rows: DataFrame, ident: str, vector: str) -> DataFrame:
    """Rows with an id and a vector, of which each knows its width."""
    rows = rows.filter(F.col(ident).isNotNull() & F.col(vector).isNotNull())
    return rows.select(F.col(ident).cast("long").alias(ident), F.col(vector).cast("array<double>").alias(vector), F.size(vector).alias("width"))


def top_k_batch(bank: DataFrame, frames: DataFrame, k: int, block: int = FRAMES) -> DataFrame:
    """frame_id, tile_id, similarity, rk: each frame's k most similar tiles, ties by tile_id; exact.

    One scan of the bank, whatever the number of frames, in cells of frame blocks and bank blocks. The work is frames times tiles; index.py looks
    at a part of the tiles only. A null vector is like none; frames without a vector have no tiles; vectors of one width are compared.
    """
    whole = F.lit(0).alias("part")
    return _searched(_vectors(bank, "tile_id", "embedding").select("*", whole), _vectors(frames, "frame_id", "query").select("*", whole), k, block)


def top_k(bank: DataFrame, frame: DataFrame, k: int) -> DataFrame:
    """tile_id, similarity of the k tiles most similar to one frame (a row with column query)."""
    return top_k_batch(bank, frame.withColumn("frame_id", F.lit(0)), k).select("tile_id", "similarity")


def usable_sources(sources: list[tuple[str, DataFrame | Callable[[], DataFrame], int]]) -> tuple[list[tuple[str, DataFrame, int]], dict[str, str]]:
    """The sources whose frame can be had, and the others' errors. The first is the primary one, whose error is raised."""
    good, errors = [], {}
    for i, (name, frame, k) in enumerate(sources):
        try:
            made = frame() if callable(frame) else frame
            if i and made.filter("query is not null").isEmpty():
                raise ValueError("no vector")
            good.append((name, made, k))
        except Exception as error:
            if not i:
                raise
            errors[name] = str(error)
    return good, errors


def multi_domain_union(bank: DataFrame, sources: list[tuple[str, DataFrame, int]], most: int) -> DataFrame:
    """tile_id, similarity, sources, place: the union of every source's top tiles, one row a tile.

    sources: name, frame and k, the primary one first. A tile keeps its largest similarity and its
    sources in order, and stands where its first sighting stood.
    """
    # one pass over the bank for all sources
    frames = reduce(DataFrame.unionByName, [frame.select(F.lit(i).alias("frame_id"), "query") for i, (_, frame, _) in enumerate(sources)])
    listed = F.array(*[F.struct(F.lit(name).alias("source"), F.lit(k).alias("k")) for name, _, k in sources])
    hits = top_k_batch(bank, frames, max(k for *_, k in sources)).withColumn("of", F.get(listed, F.col("frame_id").cast("int")))
    hits = hits.filter(F.col("rk") <= F.col("of.k")).select("tile_id", "similarity", F.col("of.source").alias("source"), F.col("frame_id").alias("src"), "rk")
    merged = hits.groupBy("tile_id").agg(F.max("similarity").alias("similarity"), F.min(F.struct("src", "rk")).alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("src", "source"))), lambda s: s["source"]).alias("sources"))
    # at most the sum of the k's rows reach this one ordering
    order = Window.partitionBy(F.lit(0)).orderBy("first")
    return merged.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select("tile_id", "similarity", "sources", "place")


def summary(hits: DataFrame) -> DataFrame:
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources"))))
    out = hits.agg(F.count(F.lit(1)).alias("candidate_count"), F.coalesce(F.max("similarity"), F.lit(0.0)).alias("max_similarity"), names.alias("sources"))
    return out.withColumn("multi_domain", F.size("sources") > 1)
