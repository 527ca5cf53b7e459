"""Approximate vector search: inverted lists around centroids.

The centroids are fitted by spherical k-means on a bounded sample of the bank (SAMPLE rows, those with the smallest hash of their id). Every row of the bank is
then filed in the list of its nearest centroid. A search looks at the `probes` lists whose centroids are nearest to the frame, exactly (retrieval._searched):
lists with many rows, or many frames that ask for them, are dealt to several tasks.

How many lists must be looked at depends on the data: with structure a few do, without any about half. So fit() measures it: PROBE_FRAMES rows of the sample search
the sample for their nearest rows, and the least number of probes with `recall` of the true ones is kept in the index.

Defined cases: vectors of another width than the sample's most frequent one are filed in list -1 and found by frames of their width; a vector without length
belongs to list 0; fewer rows than lists make as many lists as rows; an empty bank has no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfix.operators import retrieval

SAMPLE, LISTS, ROUNDS, PROBE_FRAMES, RECALL = 20_000, 1024, 10, 256, 0.95


@dataclass
class Index:
    """Centroids (unit length) and the number of lists to look at."""

    centroids: np.ndarray
    probes: int

    @property
    def width(self) -> int:
        return self.centroids.shape[1]


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-8)


def _kmeans(rows: np.ndarray, lists: int, seed: int) -> np.ndarray:
    centroids = rows[np.sort(np.random.default_rng(seed).choice(len(rows), lists, replace=False))]
    for _ in range(ROUNDS):
        of = (rows @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, rows)
        filled = np.bincount(of, minlength=lists) > 0
        centroids[filled] = _unit(sums[filled])
    return centroids


def _least_probes(rows: np.ndarray, centroids: np.ndarray, k: int, recall: float) -> int:
    of = (rows @ centroids.T).argmax(axis=1)
    asked = rows[:: max(1, len(rows) // PROBE_FRAMES)][:PROBE_FRAMES]
    near = asked @ rows.T
    true = np.argpartition(-near, min(k, len(rows)) - 1, axis=1)[:, :k]
    turn = np.argsort(np.argsort(-(asked @ centroids.T), axis=1), axis=1)  # of each list, in each frame's order
    needed = np.sort(np.take_along_axis(turn, of[true], axis=1).ravel()) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])


def fit(bank: DataFrame, lists: int | None = None, k: int = 8, recall: float = RECALL, sample: int = SAMPLE, seed: int = 0) -> Index | None:
    """An index for the bank (tile_id, embedding), or None if it has no vector. lists: by default the root of the sample's size, LISTS at most."""
    rows = retrieval._vectors(bank, "tile_id", "embedding").filter("width > 0")
    taken = rows.orderBy(F.xxhash64("tile_id"), "tile_id").limit(sample).toArrow()
    if not taken.num_rows:
        return None
    widths, counts = np.unique(taken.column("width").to_numpy(), return_counts=True)
    vectors = retrieval._matrix(taken.column("embedding").combine_chunks(), int(widths[counts.argmax()]))
    vectors = vectors[np.linalg.norm(vectors, axis=1) > 0.5]
    if not len(vectors):
        return None
    lists = min(len(vectors), lists or min(LISTS, max(1, int(np.sqrt(len(vectors))))))
    centroids = _kmeans(vectors, lists, seed)
    return Index(centroids, _least_probes(vectors, centroids, k, recall))


def _filed(rows: DataFrame, index: Index, vector: str, ident: str, probes: int) -> DataFrame:
    """Rows with the `probes` lists (part) whose centroids are nearest, nearest first; of another width: list -1."""
    schema = f"part int, width int, {ident} long, {vector} array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = batch.column("width").to_numpy()
            own = retrieval._matrix(batch.column(vector), index.width)
            near = np.argsort(-(own @ index.centroids.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
            near[width != index.width] = -1
            kept = np.ones(near.shape, bool)
            kept[width != index.width, 1:] = False
            row, _ = np.nonzero(kept)
            yield pa.RecordBatch.from_arrays([pa.array(near[kept]), *(batch.column(c).take(pa.array(row)) for c in ("width", ident, vector))], ["part", "width", ident, vector])

    return rows.select("width", ident, vector).mapInArrow(run, schema)


def build(bank: DataFrame, index: Index) -> DataFrame:
    """part (list), width, tile_id, embedding of every row of the bank. Write it partitioned by part; search() reads the lists that are asked for."""
    return _filed(retrieval._vectors(bank, "tile_id", "embedding"), index, "embedding", "tile_id", 1)


def search(built: DataFrame, frames: DataFrame, index: Index, k: int, probes: int | None = None, block: int = retrieval.FRAMES) -> DataFrame:
    """frame_id, tile_id, similarity, rk: each frame's (frame_id, query) k most similar tiles among the lists that it looks at."""
    probes = min(probes or index.probes, len(index.centroids))
    asked = _filed(retrieval._vectors(frames, "frame_id", "query"), index, "query", "frame_id", probes)
    return retrieval._searched(built, asked, k, block)
