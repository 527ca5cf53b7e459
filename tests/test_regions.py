"""Regions of masks against a flood fill."""

import numpy as np
import pyarrow as pa
import pytest

from skyfix.operators import regions

MASK = "image_id long, y int, cells array<boolean>"


def flood(cells, corners):
    """Each set pixel's region, named after its first pixel."""
    h, w = cells.shape
    out = {}
    near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0) and (corners or not a or not b)]
    for y in range(h):
        for x in range(w):
            if not cells[y, x] or (y, x) in out:
                continue
            todo, out[y, x] = [(y, x)], (y, x)
            while todo:
                i, j = todo.pop()
                for a, b in near:
                    k = i + a, j + b
                    if 0 <= k[0] < h and 0 <= k[1] < w and cells[k] and k not in out:
                        out[k] = (y, x)
                        todo.append(k)
    return out


def snake(n):
    """One path through every other line, whose ends take a join of all lines to meet."""
    cells = np.zeros((n, n), bool)
    cells[::2] = True
    for i, y in enumerate(range(1, n, 2)):
        cells[y, -1 if i % 2 == 0 else 0] = True
    return cells


def masks():
    rng = np.random.default_rng(0)
    out = {i: rng.random((23, 71)) < p for i, p in enumerate((0.15, 0.35, 0.45, 0.7))}
    out |= {10: np.zeros((4, 4), bool), 11: np.ones((5, 70), bool), 12: snake(41), 13: np.indices((17, 130)).sum(0) % 2 == 0}
    return out


@pytest.mark.parametrize("corners", [True, False])
def test_labels_equal_a_flood_fill(spark, corners):
    rows = [(i, y, line.tolist()) for i, m in masks().items() for y, line in enumerate(m)]
    rows += [(12, 3, [None]), (12, 900, None), (12, 901, []), (None, 1, [True]), (20, 5, [None, True, True]), (20, 5, [None, None, True, True]), (20, 7, [True])]
    found = {i: {} for i in [*masks(), 20]}
    for r in regions.labelled(spark.createDataFrame(rows, MASK), corners).collect():
        for x in range(r.x0, r.x1 + 1):
            assert found[r.image_id].setdefault((r.y, x), (r.label_y, r.label_x)) == (r.label_y, r.label_x)
    for i, m in masks().items():
        assert found[i] == flood(m, corners), i
    assert set(found[20]) == {(5, 1), (5, 2), (5, 3), (7, 0)}


def test_areas_boxes_and_outlines(spark):
    m = np.zeros((30, 40), bool)
    m[2:20, 3:30] = True
    m[8:12, 10:15] = False  # a hole
    m[25, 1:4] = True
    m[27:29, 20:36] = True
    rows = regions.labelled(spark.createDataFrame([(7, y, line.tolist()) for y, line in enumerate(m)], MASK))
    got = sorted(map(tuple, regions.regions(rows).collect()))
    assert got == [(7, 2, 3, 18 * 27 - 20, 3, 2, 29, 19), (7, 25, 1, 3, 1, 25, 3, 25), (7, 27, 20, 32, 20, 27, 35, 28)]
    sizes = spark.createDataFrame([(7, 40, 30)], "image_id long, width int, height int")
    large = regions.large_regions(rows, sizes)  # 120 pixels
    assert {(r.label_y, r.label_x) for r in large.collect()} == {(2, 3)}
    assert regions.large_regions(rows, sizes, least=1.0, share=0.02).select("label_y").distinct().count() == 2  # 24 pixels
    inside = m.copy()
    inside[1:-1, 1:-1] = m[1:-1, 1:-1] & m[:-2, 1:-1] & m[2:, 1:-1] & m[1:-1, :-2] & m[1:-1, 2:]
    inside[[0, -1]] = inside[:, [0, -1]] = False
    wanted = {(int(x), int(y)) for y, x in zip(*np.nonzero(m & ~inside), strict=True)}
    assert {(r.x, r.y) for r in regions.outline(rows).collect()} == wanted


def test_lines_of_many_runs_are_joined_by_bins(spark):
    """A checkered line has a run for every other pixel; candidates stay near the number of touching pairs."""
    m = np.indices((2, 2000)).sum(0) % 2 == 0
    own = regions.runs(spark.createDataFrame([(1, y, line.tolist()) for y, line in enumerate(m)], MASK))
    assert own.count() == 2000 and regions.touching(own).count() == 1999 and regions.touching(own, corners=False).count() == 0


def test_nothing(spark):
    none = spark.createDataFrame([], MASK)
    assert regions.labelled(none).collect() == [] and regions.outline(regions.labelled(none)).collect() == []


def tall():
    """Masks of several strips."""
    rng = np.random.default_rng(1)
    return {1: rng.random((200, 30)) < 0.42, 2: snake(151), 3: np.ones((129, 5), bool), 4: rng.random((64, 9)) < 0.5}


@pytest.mark.parametrize("corners", [True, False])
def test_regions_and_outlines_go_on_across_strips(spark, corners):
    top = -70  # lines below zero too
    rows = regions.labelled(spark.createDataFrame([(i, y + top, line.tolist()) for i, m in tall().items() for y, line in enumerate(m)], MASK), corners)
    found, open_ = {i: {} for i in tall()}, {i: set() for i in tall()}
    for r in rows.collect():
        for x in range(r.x0, r.x1 + 1):
            assert found[r.image_id].setdefault((r.y - top, x), (r.label_y - top, r.label_x)) == (r.label_y - top, r.label_x)
    for r in regions.outline(rows).collect():
        assert found[r.image_id][r.y - top, r.x] == (r.label_y - top, r.label_x) and (r.x, r.y) not in open_[r.image_id]
        open_[r.image_id].add((r.x, r.y))
    for i, m in tall().items():
        assert found[i] == flood(m, corners), i
        inside = np.zeros_like(m)
        inside[1:-1, 1:-1] = m[1:-1, 1:-1] & m[:-2, 1:-1] & m[2:, 1:-1] & m[1:-1, :-2] & m[1:-1, 2:]
        assert open_[i] == {(int(x), int(y) + top) for y, x in zip(*np.nonzero(m & ~inside), strict=True)}, i


def test_strips_are_worked_on_in_slices(monkeypatch):
    line = pa.list_(pa.struct([("y", pa.int32()), ("cells", pa.list_(pa.bool_()))]))
    strips = [[{"y": 64 * i + y, "cells": row.tolist()} for y, row in enumerate(m[:64])] for i, m in enumerate(tall().values())]
    strips = pa.array([*strips, None, [], [{"y": 3, "cells": None}], strips[0]], line)
    numbers = pa.array([0, 1, 2, 3, 0, 0, 0, 0], pa.int32())
    label = regions._labelled_strips(1).func
    runs = label(strips)
    pixels = regions._open(numbers, runs)
    assert [len(r) for r in runs.to_pylist()][4:7] == [0, 0, 0] and runs[7] == runs[0]
    for size in (1, 700, 5000):
        monkeypatch.setattr(regions, "_SLICE", size)
        assert label(strips) == runs and regions._open(numbers, runs) == pixels


@pytest.mark.parametrize("corners", [True, False])
def test_lines_may_come_as_the_bits_of_longs(spark, corners):
    rng = np.random.default_rng(3)
    lines = [(i, y, (rng.random(64) < p).tolist()) for i, p in enumerate((0.0, 0.3, 0.6, 1.0)) for y in range(-3, 70)]
    lines += [(9, 5, [True, True]), (9, 5, [False, True, True]), (9, 7, None), (9, 64, [True] + 62 * [False] + [True]), (None, 1, [True])]
    word = lambda cells: None if cells is None else int(np.packbits(np.pad(cells, (0, 64 - len(cells))), bitorder="little").view("<i8")[0])
    longs = spark.createDataFrame([(i, y, word(cells)) for i, y, cells in lines], "image_id long, y int, cells long")
    wanted, got = (sorted(map(tuple, regions.labelled(df, corners).collect())) for df in (spark.createDataFrame(lines, MASK), longs))
    assert got == wanted and {r[0] for r in got} == {1, 2, 3, 9}


def test_strips_reach_each_other_where_a_line_ends_one(spark):
    at = lambda *rows: regions.reaching(spark.createDataFrame(rows, "image_id long, y int"))
    assert not at((1, 0), (1, 62), (1, None), (None, 63)) and at((1, 63)) and at((2, -1))
