"""Resampling held to its rules on odd lines."""

import numpy as np
import pytest

from taproot.operators import resample, topology
from taproot.sources import ingest


def test_walks_of_many_lines_equal_single_walks():
    r = np.random.default_rng(5)
    lines = [np.cumsum(r.normal(size=(n, 3)) * s, axis=0) for n, s in ((2, 50), (40, 3), (300, 1), (7, 20), (2, 0), (1, 1))]
    last = np.cumsum([len(x) for x in lines]) - 1
    first = np.r_[0, last[:-1] + 1]
    whose, points = resample.walked(np.concatenate(lines), first, last, 6.0)
    for s, line in enumerate(lines):
        got = points[whose == s]
        alone = resample.walked(line, np.array([0]), np.array([len(line) - 1]), 6.0)[1]
        assert np.array_equal(got, alone)
        gaps = np.linalg.norm(np.diff(np.vstack([line[:1], got]), axis=0), axis=1)
        assert np.allclose(gaps[:-1], 6.0)
        assert all(3.0 - 1e-9 <= g < 9.0 for g in gaps) or len(got) == 1
        if len(got):
            assert np.array_equal(got[-1], line[-1])
        for p in got:  # on the line
            a, d = line[:-1], np.diff(line, axis=0)
            u = np.clip(((p - a) * d).sum(1) / np.maximum((d * d).sum(1), 1e-300), 0, 1)
            assert np.linalg.norm(a + u[:, None] * d - p, axis=1).min() < 1e-8


def test_nearest_equals_brute_force_with_ties(monkeypatch):
    monkeypatch.setattr(resample, "PAIRS", 50)
    r = np.random.default_rng(6)
    xyz = r.integers(0, 6, (300, 3)).astype(float)
    group = np.sort(r.integers(0, 5, 300))
    whose = np.sort(r.integers(0, 5, 200))
    points = r.integers(0, 6, (200, 3)) + 0.5
    guess = np.array([np.flatnonzero(group == g)[-1] for g in whose])
    got = resample.nearest(xyz, group, points, whose, guess)
    for p, g, k in zip(points, whose, got, strict=True):
        d = np.where(group == g, ((xyz - p) ** 2).sum(1), np.inf)
        assert k == d.argmin()


def test_trees_without_lines_and_coinciding_nodes(spark):
    rows = [(1, None, 1.0, 2.0, 3.0)]
    alone = topology.index(ingest.from_rows(spark, rows))
    assert [tuple(r) for r in resample.resampled(alone, 5.0).collect()] == [(0, 0, None, 1.0, 2.0, 3.0, 1)]
    rows += [(2, 1, 1.0, 2.0, 3.0), (3, 2, 1.0, 2.0, 13.0), (4, 2, 1.0, 9.0, 3.0)]
    got = resample.resampled(topology.index(ingest.from_rows(spark, rows)), 5.0).collect()
    # node 2 lies on the root, so both segments beyond it begin at the root's new id
    assert sorted(tuple(r)[1:] for r in got if r.nid) == [(1, 0, 1.0, 2.0, 8.0, 2), (2, 1, 1.0, 2.0, 13.0, 3), (3, 0, 1.0, 9.0, 3.0, 4)]
    assert resample.resampled(alone.limit(0), 5.0).count() == 0
    with pytest.raises(ValueError, match="delta"):
        resample.resampled(alone, 0.0)


def test_smoothing_keeps_ends():
    line = np.cumsum(np.random.default_rng(7).normal(size=(30, 3)), axis=0)
    soft = resample.dense_line(line, 1.0, 0.05, "gaussian")
    assert np.array_equal(soft[[0, -1]], line[[0, -1]])
    assert np.linalg.norm(np.diff(soft[1:-1], axis=0), axis=1).sum() < np.linalg.norm(np.diff(line, axis=0), axis=1).sum()
