"""Arrays written into blocks and wavefronts over lattices, against plain loops."""

import itertools

import numpy as np
import pytest

from taproot.operators import blocks, scores

LEAF = (4, 3, 5)
KIND = "arbor_id long, ox long, oy long, oz long, sx int, sy int, sz int, values array<double>, seq long"


def test_arrays_are_laid_by_seq(spark):
    r = np.random.default_rng(8)
    rows, want = [], {}
    for seq in range(40):
        o, s = r.integers(-9, 9, 3), r.integers(0, 9, 3)
        v = r.integers(0, 50, s).astype(float)
        rows.append((1, *map(int, o), *map(int, s), v.reshape(-1).tolist(), seq))
        for p in itertools.product(*map(range, s)):
            want[tuple(int(a + b) for a, b in zip(o, p, strict=True))] = v[p]
    old = spark.createDataFrame([(1, 0, 0, 0, 7.0, None), (1, 9, 9, 9, None, [1.0] * 59 + [2.0]), (2, 0, 0, 0, 3.0, None)], "arbor_id long, bx long, by long, bz long, uniform double, data array<double>")
    arrays = spark.createDataFrame(rows * 2, KIND)
    out = blocks.set_arrays(old, LEAF, arrays, fill=5.0)
    got = {(x.arbor_id, x.vx, x.vy, x.vz): x.value for x in blocks.to_voxels(out, LEAF).collect()}
    for at, v in got.items():
        before = 7.0 if at[0] == 1 and all(0 <= a < n for a, n in zip(at[1:], LEAF, strict=True)) else 3.0 if at[0] == 2 else 5.0
        if at[1:] >= (36, 27, 45):
            assert v == (2.0 if at[1:] == (39, 29, 49) else 1.0)
        else:
            assert v == (want.get(at[1:], before) if at[0] == 1 else before)
    assert {(1, *p) for p in want} <= set(got)
    assert blocks.set_arrays(old, LEAF, arrays.limit(0)).count() == 3


def test_array_of_wrong_length_raises(spark):
    none = spark.createDataFrame([], "arbor_id long, bx long, by long, bz long, uniform double, data array<double>")
    bad = spark.createDataFrame([(1, 0, 0, 0, 2, 2, 2, [1.0], 0)], KIND)
    with pytest.raises(Exception, match="other than"):
        blocks.set_arrays(none, LEAF, bad).collect()
    whole = spark.createDataFrame([(1, 0, 0, 0, 4, 3, 5, [None] + [2.0] * 59, 0)], KIND)
    assert blocks.set_arrays(none, LEAF, whole, fill=2.0).collect()[0][4:] == (2.0, None)


def test_layers_are_packed_before_they_are_shuffled(spark, monkeypatch):
    """Nulls and old cells stay where nothing is written; no dense layer, and no row of a voxel, is shuffled."""
    monkeypatch.setattr(blocks.batched, "PLACES", 7)
    data = [None, 5.0, 8.0] + [5.0] * 57
    old = spark.createDataFrame([(1, 0, 0, 0, None, data), (1, 1, 0, 0, 4.0, None)], blocks.BLOCKS)
    arrays = spark.createDataFrame([(1, 0, 0, 1, 8, 3, 1, [float(k) for k in range(24)], 3), (1, 3, 2, 0, 1, 1, 5, [9.0] * 5, 3)], KIND)
    out = blocks.set_arrays(old, LEAF, arrays, fill=5.0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "collect_list" not in plan
    want = {(1, x, y, z): 4.0 if x > 3 else data[(x * 3 + y) * 5 + z] for x in range(8) for y in range(3) for z in range(5)}
    want |= {(1, x, y, 1): float(3 * x + y) for x in range(8) for y in range(3)}
    want |= {(1, 3, 2, z): max(9.0, want[1, 3, 2, z]) if z == 1 else 9.0 for z in range(5)}
    assert {(r.arbor_id, r.vx, r.vy, r.vz): r.value for r in blocks.to_voxels(out, LEAF).collect()} == want


def test_a_region_is_written_in_arrays(spark):
    data = [None, 5.0, 8.0] + [5.0] * 57
    old = spark.createDataFrame([(1, 0, 0, 0, None, data), (1, 1, 0, 0, 4.0, None), (1, 7, 0, 0, None, data), (2, 0, 0, 0, None, data)], blocks.BLOCKS)
    out = blocks.set_region(old, LEAF, ((0, 5), (0, 3), (0, 5)), 6.0, old.where("arbor_id = 1"), fill=5.0)
    assert "transform(" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.arbor_id, r.bx): (r.uniform, r.data) for r in out.collect()}
    assert got == {(1, 0): (6.0, None), (1, 1): (None, [6.0] * 15 + [4.0] * 45), (1, 7): (None, data), (2, 0): (None, data)}


def test_best_path_equals_a_loop(spark):
    r = np.random.default_rng(9)
    rows, want = [], {}
    for nid in range(30):
        grid = r.integers(0, 9, r.integers(1, 5, 3)).astype(float)
        best = {}
        for p in itertools.product(*map(range, grid.shape)):
            before = [best[q] for d in itertools.product((0, 1), repeat=3) if (q := tuple(a - b for a, b in zip(p, d, strict=True))) in best]
            best[p] = min(grid[p], max(before, default=np.inf))
            rows.append((nid % 3, nid, *p, float(grid[p])))
        want[nid % 3, nid] = best[p]
    cells = spark.createDataFrame(rows, "arbor_id long, nid long, i int, j int, k int, viewed double")
    assert {(x.arbor_id, x.nid): x.strength for x in scores.best_path(cells).collect()} == want
    assert scores.best_path(cells.limit(0)).count() == 0
