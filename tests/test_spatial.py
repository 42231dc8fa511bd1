"""Floods and nearest nodes against brute force."""

import numpy as np

from taproot.operators import spatial
from taproot.sources import ingest


def forest(n, seed, scale=4):
    r = np.random.default_rng(seed)
    at = np.zeros((n, 3))
    parent = [None]
    for k in range(1, n):
        p = int(r.integers(max(0, k - 6), k))
        parent.append(p)
        at[k] = at[p] + r.integers(-scale, scale + 1, 3)
    return parent, at


def brute(parent, at, start, near):
    beside = {k: set() for k in range(len(parent))}
    for k, p in enumerate(parent):
        if p is not None:
            beside[k].add(p), beside[p].add(k)
    seen, front = {start} | beside[start], list(beside[start])
    while front:
        front = [q for p in front for q in beside[p] if q not in seen and near(at[q] - at[start]) and not seen.add(q)]
    return seen


def test_floods_equal_brute_force(spark):
    parent, at = forest(400, 1)
    nodes = ingest.from_rows(spark, [(k, p, *map(float, at[k])) for k, p in enumerate(parent)]).cache()
    starts = [0, 17, 200, 399]
    asked = nodes.where(nodes.nid.isin(starts))
    for got, near in (
        (spatial.radius(nodes, asked, 15.0), lambda d: (d**2).sum() < 225),
        (spatial.radius(nodes, asked, (12.0, 0.0, 20.0)), lambda d: (abs(d) <= (12, 0, 20)).all()),
        (spatial.constrained_radius(nodes, asked, 9, 9, 0), lambda d: (abs(d).astype(int) <= (9, 9, 0)).all()),
    ):
        want = {(s, k) for s in starts for k in brute(parent, at, s, near)}
        rows = [(r.start, r.nid) for r in got.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want


def test_flood_of_a_long_chain(spark):
    n = 20_000
    nodes = spark.range(n).selectExpr("0L arbor_id", "id nid", "if(id = 0, null, id - 1) pid", "double(id) x", "0d y", "0d z")
    assert spatial.radius(nodes, nodes.where("nid = 10000"), 9000.0).count() == 17_999


def test_flood_of_empty_and_missing(spark):
    nodes = ingest.from_rows(spark, [(1, None, None, None, None), (2, 1, 1.0, 1.0, 1.0)])
    got = {(r.start, r.nid) for r in spatial.radius(nodes, nodes, 5.0).collect()}
    assert got == {(1, 1), (1, 2), (2, 1), (2, 2)}
    assert spatial.radius(nodes.limit(0), nodes, 5.0).count() == 0


def test_closest_equals_brute_force(spark):
    r = np.random.default_rng(3)
    at = np.vstack([r.integers(0, 40, (1500, 3)), r.integers(0, 3, (500, 3)), [[10**6] * 3], np.full((300, 3), 7)]).astype(float)
    nodes = ingest.from_rows(spark, [(k, None if k == 0 else 0, *map(float, p)) for k, p in enumerate(at)] + [(9999, 0, None, 1.0, 1.0)])
    spots = np.vstack([r.integers(-20, 60, (200, 3)) + 0.5, [[7.0] * 3], [[1e6, 0, 0]], [[-1e9, 5, 5]]])
    places = spark.createDataFrame([(0, *map(float, p)) for p in spots] + [(0, 7.0, 7.0, 7.0), (5, 0.0, 0.0, 0.0), (0, None, 1.0, 1.0)], "arbor_id long, px double, py double, pz double")
    rows = spatial.closest(nodes, places).collect()
    assert len(rows) == len({tuple(p) for p in spots})
    for row in rows:
        d = ((at - (row.px, row.py, row.pz)) ** 2).sum(1)
        assert row.nid == d.argmin() and np.isclose(row.distance, d.min() ** 0.5)
    assert spatial.closest(nodes.limit(0), places).count() == 0 and spatial.closest(nodes, places.limit(0)).count() == 0
