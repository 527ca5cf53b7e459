"""Connected regions of pixel masks, from runs of pixels.

A mask is rows (image_id, y, cells): one array of flags for each line, or for `labelled` one long whose bit x is cell x. Lines are dealt by strips of STRIP lines, whose runs of set pixels a helper
labels; only runs that touch across a strip's edge are linked by joins, and these links are contracted to components by joins too. There, a line's runs
are filed by bins of BIN pixels, so a line of many short runs has no more pairs to look at than runs touch a bin. No task holds more than a strip.

Defined cases: a null or empty line has no runs; null flags are not set; lines need not follow each other (a missing line separates); rows of equal image_id and y
are one line, with what any of them sets; images are apart from each other.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyfix.sources.shared import shared_dir

BIN, STRIP = 32, 64
#: Pixels that a helper looks at together (one strip at least).
_SLICE = 1 << 22
#: Rounds after which components that have not settled are an error.
MAX_ROUNDS = 60


def runs(mask: DataFrame) -> DataFrame:
    """image_id, y, x0, x1 (inclusive) of every run of set cells."""
    cell = lambda i: F.coalesce(F.get("cells", i), F.lit(False))
    places = F.when(F.size("cells") > 0, F.sequence(F.lit(0), F.size("cells") - 1)).otherwise(F.array().cast("array<int>"))
    begins = F.filter(places, lambda i: cell(i) & ~cell(i - 1))
    ends = F.filter(places, lambda i: cell(i) & ~cell(i + 1))
    both = F.arrays_zip(begins.alias("x0"), ends.alias("x1"))
    found = mask.filter("image_id IS NOT NULL AND y IS NOT NULL").select("image_id", "y", F.inline(both))
    # runs of one line that meet (it came in several rows) are one run
    line = Window.partitionBy("image_id", "y").orderBy("x0", "x1")
    before = F.max("x1").over(line.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("fresh", F.coalesce(F.col("x0") > before + 1, F.lit(True)).cast("int")).withColumn("n", F.sum("fresh").over(line))
    return found.groupBy("image_id", "y", "n").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("n")


def touching(runs_: DataFrame, corners: bool = True, name: Column | None = None) -> DataFrame:
    """image_id, u, v: pairs of runs (named by struct(y, x0, x1), or as told) of neighbouring lines that have pixels side by side, or corner to corner too."""
    reach = 1 if corners else 0
    name = F.struct("y", "x0", "x1") if name is None else name
    binned = lambda low, high: F.explode(F.sequence(F.floor(low / BIN).cast("int"), F.floor(high / BIN).cast("int")))
    upper = runs_.select("image_id", (F.col("y") + 1).alias("line"), name.alias("u"), (F.col("x0") - reach).alias("low"), (F.col("x1") + reach).alias("high"), binned(F.col("x0") - reach, F.col("x1") + reach).alias("bin"))
    lower = runs_.select("image_id", F.col("y").alias("line"), name.alias("v"), "x0", "x1", binned(F.col("x0"), F.col("x1")).alias("bin"))
    met = upper.join(lower, ["image_id", "line", "bin"]).filter("low <= x1 AND x0 <= high")
    # a pair that shares several bins is told in the first of them
    return met.filter(F.col("bin") == F.floor(F.greatest("low", "x0") / BIN)).select("image_id", "u", "v")


def _written(df: DataFrame, path: str) -> DataFrame:
    """Lineage ends here: what later rounds read lies in the shared folder."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _removed(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _stars(edges: DataFrame) -> bool:
    """Whether every node points to one other, which points nowhere."""
    torn = edges.groupBy("image_id", "u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    chained = edges.join(edges.select("image_id", F.col("u").alias("v")), ["image_id", "v"], "left_semi")
    return torn.isEmpty() and chained.isEmpty()


def components(links: DataFrame) -> DataFrame:
    """image_id, node, root: the smallest node that a linked node reaches within its image (links: image_id, u, v).

    Each round every node points to the smallest of its neighbours and of these to their smallest, until every component is a star: rounds grow with the
    logarithm of the longest path. Nodes without links have no row. The last round's table stays, as the result reads it.
    """
    spark = links.sparkSession
    root, step = f"{shared_dir(spark)}/components-{uuid.uuid4().hex}", 0
    edges = _written(links.filter("u <> v").select("image_id", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{root}/0")
    while not _stars(edges):
        if (step := step + 1) > MAX_ROUNDS:
            raise RuntimeError(f"components have not settled after {MAX_ROUNDS} rounds")
        # large star: a node's larger neighbours get its smallest one (itself included)
        both = edges.unionByName(edges.select("image_id", F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("image_id", "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, ["image_id", "u"]).filter("v > u").select("image_id", F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours get the smallest of these
        least = large.groupBy("image_id", "u").agg(F.min("v").alias("m"))
        small = large.join(least, ["image_id", "u"]).select("image_id", F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))))
        edges = _written(small.filter("u <> v").distinct(), f"{root}/{step}")
        _removed(spark, f"{root}/{step - 1}")
    return edges.select("image_id", F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select("image_id", F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of strips of about _SLICE pixels in all."""
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // _SLICE)) + 1
    edges = [0, *cuts.tolist(), len(sizes)]
    return zip(edges, edges[1:], strict=False)


def _smallest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest of n nodes that each reaches over the links u, v: roots meet their smallest neighbours, so each round halves them at least."""
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        least = np.minimum(a, b)
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        while not np.array_equal(up := root[root], root):
            root = up
        apart = root[u] != root[v]
        u, v = u[apart], v[apart]
    return root


_RUN = pa.struct([(name, pa.int32()) for name in ("y", "x0", "x1", "label_y", "label_x")])
_PIXEL = pa.struct([(name, pa.int32()) for name in ("x", "y", "label_y", "label_x")])


def _lists(parts: list[tuple[np.ndarray, int, list[np.ndarray]]], kind: pa.StructType) -> pa.Array:
    """Lists of structs, from each slice's own strip of every row (ascending), number of strips and fields."""
    counts = np.concatenate([np.bincount(of, minlength=n) for of, n, _ in parts] or [np.empty(0, int)])
    fields = [np.concatenate([part[i] for _, _, part in parts] or [np.empty(0)]).astype(np.int32) for i in range(kind.num_fields)]
    rows = pa.StructArray.from_arrays([pa.array(f) for f in fields], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), rows)


def _bounds(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where the lists of an array begin and end in its flat values; nulls are empty."""
    sizes = np.concatenate([[0], np.cumsum(np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(int))]) if len(lists) else np.zeros(1, int)
    return sizes, lists.flatten()


def _labelled_strips(reach: int):
    def label(lines: pa.Array) -> pa.Array:
        first, flat = _bounds(lines)
        y, cells = flat.field("y").to_numpy(zero_copy_only=False).astype(int), flat.field("cells")
        packed = pa.types.is_int64(cells.type)
        if packed:
            cell, words = np.arange(len(cells) + 1) * 64, cells.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
        else:
            cell, flags = _bounds(cells)
        out = []
        for a, b in _slices(np.diff(cell[first])):
            rows = np.arange(first[a], first[b])
            of_line = np.repeat(np.arange(a, b), np.diff(first[a : b + 1]))
            start, stop = cell[first[a]], cell[first[b]]
            if packed:
                set_ = np.unpackbits(words[first[a] : first[b]].view(np.uint8), bitorder="little")
            else:
                set_ = flags.slice(start, stop - start).fill_null(False).to_numpy(zero_copy_only=False)
            on = np.flatnonzero(set_) + start
            row = np.searchsorted(cell, on, side="right") - 1
            x = on - cell[row]
            pitch = int(x.max(initial=0)) + 3
            # a pixel's place: strips, their lines and columns in one row, lines a gap apart
            place = ((of_line[row - first[a]] - a) * STRIP + y[row] % STRIP) * pitch + x if len(rows) else np.empty(0, int)
            if (np.diff(place) <= 0).any():
                place = np.unique(place)
            fresh = np.diff(place, prepend=-2) != 1
            begin, end = place[fresh], place[np.append(fresh[1:], True)] if len(place) else place
            line = begin // pitch
            below = np.where((line + 1) % STRIP == 0, -(10**9) * pitch, pitch)  # the next strip is not looked at
            low, high = np.searchsorted(end, begin + below - reach), np.searchsorted(begin, end + below + reach, side="right")
            n = np.maximum(high - low, 0)
            u = np.repeat(np.arange(len(begin)), n)
            v = np.arange(len(u)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            root = _smallest(len(begin), u, v)
            strip = line // STRIP
            base = np.zeros(b - a, int)
            base[of_line - a] = y[rows] // STRIP * STRIP
            at_y, at_x = base[strip] + line % STRIP, begin % pitch
            out.append((strip, b - a, [at_y, at_x, end % pitch, at_y[root], at_x[root]]))
        return _lists(out, _RUN)

    return F.arrow_udf(label, "array<struct<y:int,x0:int,x1:int,label_y:int,label_x:int>>")


def reaching(lines: DataFrame) -> bool:
    """Whether a strip reaches the next one: lines may be a mask or anything else with its image_id and y."""
    return not lines.filter((F.pmod(F.col("y").cast("int"), F.lit(STRIP)) == STRIP - 1) & F.col("image_id").isNotNull()).isEmpty()


def labelled(mask: DataFrame, corners: bool = True, reaches: bool | None = None, tasks: int | None = None) -> DataFrame:
    """image_id, y, x0, x1, label_y, label_x: every run with its region, which is named after its first pixel (smallest y, then x).

    What `reaching` says of the mask may be told in `reaches`, where it is found at less cost than from the mask. Strips are dealt to so many tasks, or to as many as
    Spark takes for the MB shuffled: few where lines are longs, so that a task's regions may not fit into memory.
    """
    lines = mask.filter("image_id IS NOT NULL AND y IS NOT NULL").select("image_id", F.col("y").cast("int").alias("y"), "cells")
    dealt = lines.withColumn("strip", _strip(F.col("y")))
    dealt = dealt if tasks is None else dealt.repartition(tasks, "image_id", "strip")
    strips = dealt.groupBy("image_id", "strip").agg(F.array_sort(F.collect_list(F.struct("y", "cells"))).alias("lines"))
    rows = strips.select("image_id", _labelled_strips(1 if corners else 0)("lines").alias("runs")).select("image_id", F.inline("runs"))
    if not (reaching(lines) if reaches is None else reaches):
        return rows
    place = F.pmod("y", F.lit(STRIP))
    rows = _written(rows, f"{shared_dir(mask.sparkSession)}/runs-{uuid.uuid4().hex}")
    own = F.struct("label_y", "label_x")
    seams = touching(rows.filter((place == 0) | (place == STRIP - 1)), corners, own)
    rows = rows.withColumn("node", own).join(components(seams), ["image_id", "node"], "left")
    root = F.coalesce("root", "node")
    return rows.select("image_id", "y", "x0", "x1", root["label_y"].alias("label_y"), root["label_x"].alias("label_x"))


def _strip(y: Column) -> Column:
    return F.floor(y / STRIP).cast("int")


def regions(labelled_: DataFrame) -> DataFrame:
    """image_id, label_y, label_x, area (pixels), left, top, right, bottom (inclusive) of every region."""
    width = (F.col("x1") - F.col("x0") + 1).cast("long")
    return labelled_.groupBy("image_id", "label_y", "label_x").agg(F.sum(width).alias("area"), F.min("x0").alias("left"), F.min("y").alias("top"), F.max("x1").alias("right"), F.max("y").alias("bottom"))


def large_regions(labelled_: DataFrame, sizes: DataFrame | tuple[int, int], least: float = 120.0, share: float = 0.0006) -> DataFrame:
    """The runs of regions whose area is at least `least` pixels and `share` of their image (sizes: image_id, width, height, or one width and height of all)."""
    alike = isinstance(sizes, tuple)
    width, height = map(F.lit, sizes) if alike else (F.col("width"), F.col("height"))
    area = F.sum((F.col("x1") - F.col("x0") + 1).cast("long")).over(Window.partitionBy("image_id", "label_y", "label_x"))
    rows = labelled_.withColumn("area", area)
    rows = rows if alike else rows.join(sizes, "image_id")
    return rows.filter(F.col("area") >= F.greatest(F.lit(least), width.cast("double") * height * share)).select(*labelled_.columns)


def _open(numbers: pa.Array, runs_: pa.Array) -> pa.Array:
    """Of each strip (its number, and its runs with those of the lines before and after it) the pixels with a neighbour that no run has."""
    first, flat = _bounds(runs_)
    y, x0, x1, label_y, label_x = (flat.field(f.name).to_numpy(zero_copy_only=False).astype(int) for f in _RUN)
    total, base, out = np.concatenate([[0], np.cumsum(x1 - x0 + 1)]), numbers.to_numpy(zero_copy_only=False) * STRIP, []
    for a, b in _slices(np.diff(total[first])):
        own = slice(first[a], first[b])
        strip = np.repeat(np.arange(b - a), np.diff(first[a : b + 1]))
        pitch = int(x1[own].max(initial=0)) + 3
        line = strip * (STRIP + 2) + y[own] - base[a:b][strip] + 1
        begin, end = line * pitch + x0[own], line * pitch + x1[own]
        order = np.argsort(begin, kind="stable")
        begin, end, at = begin[order], end[order], order + first[a]
        inner = (begin // pitch % (STRIP + 2) > 0) & (begin // pitch % (STRIP + 2) <= STRIP)
        n = np.where(inner, end - begin + 1, 0)
        run = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n) + begin[run]
        shut = (place > begin[run]) & (place < end[run])
        for beside in (-pitch, pitch):
            near = np.searchsorted(begin, place + beside, side="right") - 1
            shut &= (near >= 0) & (end[near] >= place + beside)
        run, x = at[run[~shut]], place[~shut] % pitch
        out.append((strip[run - first[a]], b - a, [x, y[run], label_y[run], label_x[run]]))
    return _lists(out, _PIXEL)


def outline(labelled_: DataFrame) -> DataFrame:
    """image_id, x, y, label_y, label_x: the pixels of regions that have a neighbour (above, below, left or right) outside the mask."""
    strip, place = _strip(F.col("y")), F.pmod("y", F.lit(STRIP))
    # a strip's helper also sees the lines before and after it
    near = F.when(place == 0, F.array(strip, strip - 1)).when(place == STRIP - 1, F.array(strip, strip + 1)).otherwise(F.array(strip))
    rows = labelled_.select("image_id", F.explode(near).alias("strip"), F.struct("y", "x0", "x1", "label_y", "label_x").alias("run"))
    strips = rows.groupBy("image_id", "strip").agg(F.collect_list("run").alias("runs"))
    open_ = F.arrow_udf(_open, "array<struct<x:int,y:int,label_y:int,label_x:int>>")
    return strips.select("image_id", open_("strip", "runs").alias("pixels")).select("image_id", F.inline("pixels"))
