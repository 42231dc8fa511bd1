import dataclasses
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_topology import TOY

from taproot import cli
from taproot.config import Config, Segmentation
from taproot.operators import blocks, graph, mesh, resample, scores, segment, topology, volume
from taproot.plans import jobs
from taproot.sources import artefacts, ingest, stl
from taproot.streaming import masks as stream_masks

VIEW = volume.View((1, 2, 1), (5, 3, 5), True, 1.0)


def dense(nodes, masks, view):
    """The same accumulation over arrays."""
    lo = np.array([-20, -20, -20])
    seg, views, dist = np.zeros((60, 60, 60), int), np.zeros((60, 60, 60), int), np.full((60, 60, 60), np.inf)
    h, f, r = np.array(view.half), np.array(view.fov), np.array(view.voxel)
    g = np.stack(np.meshgrid(*[np.arange(n) for n in f], indexing="ij"), -1) - h
    d = np.sqrt(((g * r) ** 2).sum(-1)) / np.sqrt(((h * r) ** 2).sum())
    ball = 4 * ((g * r) ** 2).sum(-1) <= (f * r).min() ** 2
    d = np.where(ball, d, np.inf)
    for nid, c in nodes.items():
        s = tuple(slice(a, a + n) for a, n in zip(np.floor(np.array(c) / r).astype(int) - h - lo, f))
        if nid in masks:
            seg[s] += masks[nid]
        views[s] += 1
        dist[s] = np.minimum(dist[s], d)
    return lo, seg, views, dist, ball


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(3)
    rows = [(n, p, 3 * x, 3 * y, z) for n, p, x, y, z in TOY]
    nodes = topology.index(ingest.from_rows(spark, rows)).cache()
    arrays = {n: (r.random(VIEW.fov) < 0.5).astype(int) for n, *_ in rows if n != 9}
    flat = [(0, n, *map(int, ijk), int(v)) for n, a in arrays.items() for ijk, v in np.ndenumerate(a) for ijk in [ijk]]
    masks = spark.createDataFrame(flat, "arbor_id long, nid long, i int, j int, k int, v byte").cache()
    return {n: (x, y, z) for n, _, x, y, z in rows}, {n: p for n, p, *_ in rows}, arrays, nodes, masks, volume.accumulate(nodes, masks, VIEW).cache()


def test_accumulate_and_masks(data):
    centres, _, arrays, nodes, _, voxels = data
    lo, seg, views, dist, ball = dense(centres, arrays, VIEW)
    rows = voxels.collect()
    assert len(rows) == (views > 0).sum()
    for v in rows:
        at = tuple(np.array([v.vx, v.vy, v.vz]) - lo)
        assert (v.seg_count, v.view_count) == (seg[at], views[at])
        assert v.distance is None and np.isinf(dist[at]) or abs(v.distance - dist[at]) < 1e-12
    for w in volume.weighted(nodes, voxels, VIEW).where("nid in (2, 9)").collect():
        c = np.floor(np.array(centres[w.nid]) / VIEW.voxel).astype(int) - VIEW.half - lo + (w.i, w.j, w.k)
        inside, at = ball[w.i, w.j, w.k], tuple(c)
        share, far = seg[at] / (views[at] + 1), 0 if np.isinf(dist[at]) else dist[at]
        want = (bool(seg[at] > 0 and inside), far * (seg[at] > 0 and inside), share * inside, share * far * inside)
        assert w.boolean == want[0] and np.allclose((w.dist, w.viewed, w.dist_view), want[1:])


def test_scores_connectivity_ranking(data):
    centres, parents, arrays, nodes, masks, voxels = data
    lo, seg, views, dist, ball = dense(centres, arrays, VIEW)
    far = np.where(np.isinf(dist), 0, dist)
    want = {}
    for nid, c in centres.items():
        s = tuple(slice(a, a + n) for a, n in zip(np.floor(np.array(c) / VIEW.voxel).astype(int) - VIEW.half - lo, VIEW.fov))
        m = seg[s] / (views[s] + 1) * far[s] * ball
        at = np.unravel_index(np.argmax(m), m.shape)
        want[nid] = (tuple(np.array(at) - VIEW.half), m[at]) if m[at] > 1e-8 else ((0, 0, 0), 0)
    got = {r.nid: ((r.di, r.dj, r.dk), r.score) for r in scores.branch_scores(nodes, voxels, VIEW).collect()}
    assert got.keys() == want.keys()
    assert all(got[n][0] == want[n][0] and abs(got[n][1] - want[n][1]) < 1e-12 for n in want)
    soft = {r.nid: r.score for r in scores.branch_scores(nodes, voxels, VIEW, True).collect()}
    kids = {n: [k for k, p in parents.items() if p == n and k != n] for n in parents}
    for n in want:
        near = [n, *kids[n], *([parents[n]] if parents[n] != n else [])]
        v = np.array(want[n][0], float)
        mean = np.mean([want[k][0] for k in near], axis=0)
        f = 0 if not v.any() else max(1 - np.linalg.norm(v - mean) / np.linalg.norm(v), 0)
        assert abs(soft[n] - want[n][1] * f) < 1e-9
    edges = {r.nid: r.connectivity for r in scores.connectivity(nodes, masks, VIEW).collect()}
    for n, p in parents.items():
        if n == p:
            assert n not in edges
            continue
        a, b = (np.floor(np.array(centres[x]) / VIEW.voxel).astype(int) for x in (n, p))
        if n not in arrays or p not in arrays:
            assert edges[n] == -1
        elif (np.abs(a - b) >= VIEW.fov).any():
            assert edges[n] == -2
        else:
            lo2, hi = np.maximum(a, b), np.minimum(a, b) + VIEW.fov
            cut = lambda x: arrays[x[0]][tuple(slice(u - w, v - w) for u, v, w in zip(lo2, hi, x[1]))]
            assert abs(edges[n] - ((cut((n, a)) + cut((p, b))) == 2).mean()) < 1e-12
    rank = scores.ranking(nodes, masks, voxels, VIEW).collect()
    assert len(rank) == len(centres) and {r.nid for r in rank if r.connectivity is None} == {0}
    assert all(r.dy == 2 * got[r.nid][0][1] for r in rank)


def test_what_if_and_mass(spark, data):
    centres, _, arrays, nodes, masks, voxels = data
    old = scores.branch_scores(nodes, voxels, VIEW).cache()
    close = spark.createDataFrame([(0, 2)], "arbor_id long, nid long")
    again = scores.scores_after_cut(nodes.where("nid <> 9"), close, voxels, old, VIEW)
    assert sorted(map(tuple, again.collect())) == sorted(tuple(r) for r in old.collect() if r.nid != 9)
    assert scores.branch_scores_by_place(nodes, voxels, VIEW).count() == len(centres)
    mass = scores.center_of_mass(masks, VIEW)
    for r in mass.collect():
        a = arrays[r.nid]
        s = np.array([(a * np.linspace(-1, 1, n).reshape([-1 if d == k else 1 for d in range(3)])).sum() for k, n in enumerate(VIEW.fov)])
        assert np.allclose((r.ux, r.uy, r.uz), s / np.linalg.norm(s)) and abs(r.magnitude - np.linalg.norm(s) / (75 / 4)) < 1e-9
    assert abs(max(r.magnitude for r in scores.relative_mass(mass).collect()) - 1) < 1e-12
    series = scores.center_of_mass_series(topology.root_leaf_paths(nodes), nodes, mass)
    assert series.count() == 24 and series.where("special").count() == 4 * 1 + 2 + 2 + 4
    grid = np.random.default_rng(0).random((3, 2, 3))
    cells = spark.createDataFrame([(0, 1, *map(int, ijk), float(v)) for ijk, v in np.ndenumerate(grid)], "arbor_id long, nid long, i int, j int, k int, viewed double")
    assert grid.min() <= scores.best_path(cells).first().strength <= min(grid[0, 0, 0], grid[-1, -1, -1])


def test_what_if_rebuilds_the_volume_of_the_kept_nodes(spark, data):
    centres, _, _, nodes, masks, _ = data
    nodes = nodes.withColumns({"x": F.floor(F.col("x") / 3).cast("double"), "y": F.floor(F.col("y") / 3).cast("double")})
    voxels = volume.accumulate(nodes, masks, VIEW).cache()
    kept = topology.pruned(nodes, nodes.where("nid = 3"))
    left = {r.nid for r in kept.select("nid").collect()}
    old = scores.branch_scores(nodes, voxels, VIEW).cache()
    before = {r.nid: tuple(r) for r in old.collect()}
    cut = volume.accumulate(kept, masks, VIEW)
    want = {r.nid: tuple(r) for r in scores.branch_scores(kept, cut, VIEW).collect()}
    moved = {n for n in left if want[n] != before[n]}
    assert moved and moved != left != centres.keys()
    for n in moved:
        close = spark.createDataFrame([(0, n)], "arbor_id long, nid long")
        got = {r.nid: tuple(r) for r in scores.what_if_scores(kept, close, masks, old, VIEW, smooth=False).collect()}
        assert got == {m: want[m] if m == n else before[m] for m in left}
    changed = {r.nid for r in scores.changed_nodes(kept, voxels, cut, VIEW).collect()}
    assert moved <= changed <= left
    wide = topology.pruned(data[3], data[3].where("nid = 3"))
    some = {r.nid for r in scores.changed_nodes(wide, data[5], volume.accumulate(wide, masks, VIEW), VIEW).collect()}
    assert some and some < left
    soft = sorted(tuple(r) for r in scores.scores_where_changed(kept, voxels, masks, old, VIEW).collect())
    assert soft == sorted(tuple(r) for r in scores.branch_scores(kept, cut, VIEW, consensus=True).collect())


def test_fill_and_boxes(spark, data):
    full = spark.createDataFrame([(0, 1, i, j, 0, 1) for i in range(4) for j in range(4) if i < 2 or (i == 2 and j < 2)], "arbor_id long, nid long, i int, j int, k int, v int")
    got = {(r.i, r.j): r.v for r in volume.downsampled(full, (2, 2, 1)).collect()}
    assert got == {(0, 0): 1, (0, 1): 1, (1, 0): 1}
    nodes = data[3]
    box = volume.to_voxels(volume.region_of(nodes.where("nid = 7"), VIEW), VIEW.voxel).first()
    assert (box.lo_x, box.hi_x, box.lo_y, box.hi_y) == (4, 9, 2, 5)
    with pytest.raises(Exception, match="off the grid"):
        volume.to_voxels(spark.createDataFrame([(0.5, 2.0, 0.0, 2.0, 0.0, 2.0)], "lo_x double, hi_x double, lo_y double, hi_y double, lo_z double, hi_z double"), (1, 1, 1)).collect()
    assert volume.between(nodes.where("nid in (0, 1)"), 3).count() == 3
    assert volume.accumulate(nodes, data[4], dataclasses.replace(VIEW, interpolate=2)).count() >= data[5].count()
    assert volume.is_filled(nodes, data[4]).count() == 10


def test_blocks(spark):
    leaf, r = (4, 3, 2), np.random.default_rng(1)
    cube = (r.random((9, 9, 9)) < 0.3).astype(float)
    vox = spark.createDataFrame([(0, *map(int, ijk), float(v)) for ijk, v in np.ndenumerate(cube) if v], "arbor_id long, vx long, vy long, vz long, value double")
    b = blocks.from_voxels(vox, leaf).cache()
    back = {(v.vx, v.vy, v.vz): v.value for v in blocks.to_voxels(b, leaf).collect() if v.value}
    assert back == {ijk: 1.0 for ijk, v in np.ndenumerate(cube) if v}
    region = blocks.checked((slice(1, 6), 2, slice(None)), ((0, 9),) * 3)
    assert region == ((1, 6), (2, 3), (0, 9))
    assert sum(v.value for v in blocks.get_region(b, leaf, region).collect()) == cube[1:6, 2, :].sum()
    one = spark.createDataFrame([(0,)], "arbor_id long")
    new = blocks.set_region(b, leaf, ((0, 6), (0, 6), (0, 4)), 7.0, one)
    cube[0:6, 0:6, 0:4] = 7
    assert {(v.vx, v.vy, v.vz): v.value for v in blocks.to_voxels(new, leaf).collect() if v.value} == {ijk: float(v) for ijk, v in np.ndenumerate(cube) if v}
    assert new.where("uniform = 7").count() == 4
    assert blocks.leaf_bounds(b, leaf, ((0, 9),) * 3).first().hi_x == 9
    assert abs(blocks.fullness(b, leaf, ((0, 9),) * 3).first().fullness - b.count() / 45) < 1e-12
    assert blocks.mapped(b, lambda x: x * 2).selectExpr("sum(aggregate(data, 0D, (a, x) -> a + x))").first()[0] == 2 * len(back)
    z = [(v.bx, v.by, v.bz) for v in blocks.leaves(b).orderBy("z").collect()]
    assert z == sorted(z, key=lambda p: sum((p[d] >> s & 1) << (3 * s + 2 - d) for s in range(5) for d in range(3)))
    for bad in ((1, 2), (slice(0, 4, 2), 1, 1), (9, 1, 1), (slice(3, 3), 1, 1)):
        with pytest.raises(IndexError):
            blocks.checked(bad, ((0, 9),) * 3)
    keys = spark.createDataFrame([(0, 9, 9, 9)], "arbor_id long, bx long, by long, bz long")
    assert blocks.populated(b, keys, lambda x, y, z: x + y + z).where("uniform = 27").count() == 1
    assert blocks.edge_length((10, 10, 10), (43, 43, 43)) == 80 and blocks.intersection(((0, 4),), ((5, 6),)) is None


def test_mesh(spark, tmp_path):
    solid = np.zeros((43, 43, 43))
    for i in range(20):
        solid[2 * i + 1 : 2 * i + 4, 2 * i + 1 : 2 * i + 4, 2 * i + 1 : 2 * i + 4] = 1
    vox = spark.createDataFrame([(0, *map(int, ijk), 1) for ijk, v in np.ndenumerate(solid) if v], "arbor_id long, vx long, vy long, vz long, value int")
    cells = mesh.edge_cells(vox).cache()
    w = np.stack([solid[i : 42 + i, j : 42 + j, k : 42 + k] for i in (0, 1) for j in (0, 1) for k in (0, 1)])
    assert cells.count() == ((w.min(0) < 0.5) & (w.max(0) > 0.5)).sum()
    corners, cubes = mesh.corners(cells), mesh.hexahedra(cells)
    assert corners.select("vid").distinct().count() == corners.count() and cubes.where("size(vids) = 8").count() == cells.count()
    tri = mesh.triangles(cells).cache()
    p = np.array([r[1:] for r in tri.collect()]).reshape(-1, 3, 3)
    edges = {}
    for t in np.round(p, 6):
        for a, b in ((0, 1), (1, 2), (2, 0)):
            edges[tuple(t[a]), tuple(t[b])] = edges.get((tuple(t[a]), tuple(t[b])), 0) + 1
    assert all(edges.get((b, a), 0) == n for (a, b), n in edges.items())  # closed, wound alike
    inner = np.einsum("ij,ij->i", p[:, 0], np.cross(p[:, 1], p[:, 2])).sum() / 6
    assert 0.6 * solid.sum() < inner < 1.1 * solid.sum()
    few = mesh.decimated(tri, 2.0)
    assert 0 < few.count() < tri.count() and mesh.decimated(tri, 0) is tri
    n = stl.write_file(few, f"{tmp_path}/m.stl")
    assert stl.read_file(spark, f"{tmp_path}/m.stl").count() == n == few.count()
    stl.write_text(few, f"{tmp_path}/text")
    assert spark.read.text(f"{tmp_path}/text").where("value = 'endfacet'").count() == n


def cells_by_hand(rows, cutoff):
    """Edge cells of rows ``arbor, x, y, z, w``, cell by cell."""
    value, near = {}, set()
    for a, x, y, z, w in rows:
        if w is not None:
            value[a, x, y, z] = max(w, value.get((a, x, y, z), w))
            near |= {(a, x - i, y - j, z - k) for i, j, k in mesh.CORNERS}
    out = {}
    for a, x, y, z in near:
        w = [value.get((a, x + i, y + j, z + k), 0.0) for i, j, k in mesh.CORNERS]
        if min(w) < cutoff < max(w):
            out[a, x, y, z] = w
    return out


def test_edge_cells_across_blocks(spark):
    r = np.random.default_rng(12)
    rows = [(int(a), *(int(c) for c in p), float(w)) for a, p, w in zip(r.integers(0, 2, 3000), r.integers(-10, 12, (3000, 3)), r.random(3000) - 0.2, strict=True)]
    rows += rows[:50] + [(a, x, y, z, w + 0.5) for a, x, y, z, w in rows[:50]]
    rows += [(3, 7, 7, 7, 1.0), (3, -8, 0, 8, 1.0), (4, 0, 0, 0, None), (5, 1 << 19, -(1 << 19), 0, 0.9), (6, 1, 1, 1, -3.0)]
    voxels = spark.createDataFrame([(*x, "own") for x in rows], "arbor_id long, vx long, vy long, vz long, value double, p string")
    for cutoff in (0.5, 0.1, -0.1):
        got = mesh.edge_cells(voxels, cutoff).collect()
        assert len(got) == len({(c.arbor_id, c.vx, c.vy, c.vz) for c in got})
        assert {(c.arbor_id, c.vx, c.vy, c.vz): list(c.w) for c in got} == cells_by_hand(rows, cutoff)
    assert mesh.edge_cells(voxels.limit(0)).count() == 0


def test_components_and_regions(spark):
    r = np.random.default_rng(2)
    rows = [(int(a), int(b), float(s)) for a, b, s in zip(r.integers(0, 200, 170), r.integers(0, 200, 170), r.random(170), strict=True)]
    rows += [(k, k + 1, 0.0) for k in range(1000, 1060)]
    got = {x.node: x.component for x in graph.connected_components(spark.createDataFrame(rows, "u long, v long, score double"), 0.8).collect()}
    top = {n: n for a, b, _ in rows for n in (a, b)}

    def root(n):
        while top[n] != n:
            n = top[n]
        return n

    for a, b, s in rows:
        if s <= 0.8:
            x, y = sorted((root(a), root(b)))
            top[y] = x
    assert got == {n: root(n) for n in top}
    frag = spark.createDataFrame([(x, 0, 0, x // 2) for x in range(20)], "x long, y long, z long, frag_id long")
    edges = spark.createDataFrame([(0, 1, 0.1), (1, 2, 0.9), (2, 3, 0.1), (3, 4, 0.2)], "u long, v long, score double")
    nodes = ingest.from_rows(spark, [(1, None, 5, 0, 0), (2, 1, 15, 0, 0), (3, 1, 90, 0, 0)])
    source = segment.FragmentSegmenter(frag, edges, volume.View((1, 1, 1), (5, 1, 1)))
    m = sorted((x.nid, x.i, x.v) for x in source.segment(nodes).collect())
    assert m == [(1, 0, 0), (1, 1, 1), (1, 2, 1), (1, 3, 1), (1, 4, 1), (2, 0, 0), (2, 1, 1), (2, 2, 1), (2, 3, 0), (2, 4, 0)] or m[5:] == [(2, 0, 0), (2, 1, 1), (2, 2, 1), (2, 3, 0), (2, 4, 0)]


def test_resampling(spark):
    r = np.random.default_rng(4)
    rows, at = [], {0: np.zeros(3)}
    for n in range(1, 240):
        p = int(r.integers(0, n)) if n % 40 == 0 else n - 1
        at[n] = at[p] + r.normal(size=3) * 3 + 4
        rows.append((n, p, *map(float, at[n])))
    nodes = topology.index(ingest.from_rows(spark, [(0, None, 0, 0, 0), *rows])).cache()
    for how in ("none", "gaussian"):
        new = topology.index(resample.resampled(nodes, 20, 0.05, how)).cache()
        old_kind = sorted((tuple(np.round((x.x, x.y, x.z), 6)), x.order_no) for x in nodes.where("n_children <> 1 or pid is null").collect())
        kind = sorted((tuple(np.round((x.x, x.y, x.z), 6)), x.order_no) for x in new.where("n_children <> 1 or pid is null").collect())
        assert kind == old_kind
        where = {x.nid: x for x in new.collect()}
        for x in where.values():
            if x.pid is not None and (x.n_children == 1 or where[x.pid].n_children == 1 and where[x.pid].pid is not None):
                assert 10 < math.dist((x.x, x.y, x.z), [where[x.pid][c] for c in "xyz"]) < 30
    with pytest.raises(Exception, match="too few steps|neither"):
        resample.dense_line(np.zeros((2, 3)), 1, 1, "other")


def test_config_round_trip(tmp_path):
    (tmp_path / "a.toml").write_text('[segmentations]\nresolution_phys = [4, 4, 35]\n[skeleton]\nsmoothing = "gaussian"\n')
    (tmp_path / "b.toml").write_text("[segmentations]\nfov_shape = [3088, 3088, 1715]\ndownsample_factor = [4, 4, 1]\nresample_steps = 3\n")
    c = Config.from_toml(str(tmp_path / "a.toml"), str(tmp_path / "b.toml"))
    assert c.segmentations.fov_shape_voxels == (193, 193, 49) and c.skeleton.smoothing == "gaussian"
    c.to_toml(str(tmp_path / "c.toml"))
    assert Config.from_toml(str(tmp_path / "c.toml")) == c
    c.segmentations.validate_fov_shape()
    with pytest.raises(ValueError):
        Segmentation(fov_shape=(1200, 1240, 1240)).validate_fov_shape()
    assert Segmentation().fov_shape_voxels == (31, 31, 31)


def test_jobs_save_load_cli_stream(spark, tmp_path):
    (tmp_path / "n.csv").write_text("".join(f"{n},{'null' if n == p else p},{4 * x},{4 * y},{4 * z}\n" for n, p, x, y, z in TOY))
    text = "[segmentations]\nresolution_phys=[1,1,1]\ndownsample_factor=[1,1,1]\nfov_shape=[5,5,5]\nleaf_shape_voxels=[8,8,8]\n[skeleton]\nresample_delta=4\n[fragments]\nshift=[0,0,0]\n"
    (tmp_path / "c.toml").write_text(text)
    frag = spark.createDataFrame([(x, y, z, 1 + (x > 8)) for x in range(-4, 26) for y in range(-4, 18) for z in range(-3, 4)], "x long, y long, z long, frag_id long")
    frag.write.parquet(f"{tmp_path}/frag")
    spark.createDataFrame([(1, 2, 0.2)], "u long, v long, score double").write.parquet(f"{tmp_path}/edges")
    base = ["--skeleton-csv", f"{tmp_path}/n.csv", "--config", f"{tmp_path}/c.toml", "--output-file", f"{tmp_path}/out"]
    assert cli.main([*base, "fragments", "--fragments", f"{tmp_path}/frag", "--edges", f"{tmp_path}/edges"]) == 0
    got = artefacts.load(spark, f"{tmp_path}/out")
    n = got["nodes"].count()
    assert n >= 11 and got["rankings"].count() == n and got["config"].segmentations.fov_shape == (5, 5, 5)
    assert got["voxels"].count() > 100 and got["triangles"].count() > 10
    assert artefacts.voxels_in(spark, f"{tmp_path}/out", (0, 0, 0), (4, 4, 4), (8, 8, 8)).count() == got["voxels"].where("vx between 0 and 3 and vy between 0 and 3 and vz between 0 and 3").count() == 36
    assert artefacts.load(spark, f"{tmp_path}/none")["nodes"] is None
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        artefacts.save(f"{tmp_path}/out", got["config"], nodes=got["nodes"])
    assert set(artefacts.load_volumes(spark, {"a": {"path": f"{tmp_path}/frag"}, "b": {"path": f"{tmp_path}/edges"}}, "^a")) == {"a"}

    class Cube:
        def segment(self, nodes):
            def load():
                import pandas as pd

                return lambda f: pd.concat([pd.DataFrame({"arbor_id": [a], "nid": [b], "i": [2], "j": [2], "k": [k], "v": [1]}) for a, b in zip(f.arbor_id, f.nid) for k in (1, 2)])

            return segment.ModelSegmenter(load, volume.View()).segment(nodes)

    plain = dataclasses.replace(got["config"], skeleton=dataclasses.replace(got["config"].skeleton, output_file_base=None))
    tables = jobs.from_model(spark, plain, Cube(), csv=f"{tmp_path}/n.csv")
    assert tables["masks"].count() == 2 * tables["nodes"].count()
    masks, nodes = got["masks"], got["nodes"]
    masks.repartition("nid").write.parquet(f"{tmp_path}/stream")
    q = stream_masks.accumulating(spark.readStream.schema(masks.schema).parquet(f"{tmp_path}/stream"), nodes, volume.View(), f"{tmp_path}/partial", f"{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    one = stream_masks.merged(spark.read.parquet(f"{tmp_path}/partial").drop("batch"))
    filled = volume.is_filled(nodes, masks)
    assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, volume.accumulate(filled, masks, volume.View()).collect()), key=str)


def test_regions_of_one_box_are_segmented_once(spark):
    """Rows equal a brute force; no row for each voxel of each region is shuffled or written."""
    r = np.random.default_rng(9)
    voxels = {(int(x), int(y), int(z)): int(f) for x, y, z, f in zip(*r.integers(-6, 7, (3, 900)), r.integers(-9, 30, 900), strict=True)}
    links = [(int(a), int(b), float(s)) for a, b, s in zip(r.integers(-9, 30, 40), r.integers(-9, 30, 40), r.random(40), strict=True)]
    low = r.integers(-7, 5, (30, 3))
    boxes = [(k, *map(int, low[k % 10]), *[int(v + 3 + k % 2) for v in low[k % 10]]) for k in range(30)] + [(99, 50, 50, 50, 55, 55, 55)]
    want, objects = set(), set()
    for k, *box in boxes:
        lo, hi = box[:3], box[3:]
        mine = {p: f for p, f in voxels.items() if all(a <= c < b for a, c, b in zip(lo, p, hi, strict=True))}
        label = {f: f for f in mine.values()}
        for _ in label:
            for a, b, s in links:
                if s <= 0.5 and a in label and b in label:
                    label[a] = label[b] = min(label[a], label[b])
        want |= {(k, *p, label[f]) for p, f in mine.items()}
        core = tuple((a + b) // 2 for a, b in zip(lo, hi, strict=True))
        if core in mine:
            objects |= {(k, *[c - a for c, a in zip(p, lo, strict=True)], int(label[f] == label[mine[core]])) for p, f in mine.items()}
    regions = spark.createDataFrame(boxes, "roi_id long, lo_x long, lo_y long, lo_z long, hi_x long, hi_y long, hi_z long").repartition(3)
    frags = spark.createDataFrame([(*p, f) for p, f in voxels.items()] + [(0, 0, 0, None)], "x long, y long, z long, frag_id long")
    edges = spark.createDataFrame(links, "u long, v long, score double")
    for cell in (2, 16):
        got = [tuple(x) for x in graph.local_segmentation(regions, frags, edges, 0.5, cell).collect()]
        assert len(got) == len(want) and set(got) == want
    found = graph.center_object(regions, frags, edges, 0.5)
    got = [tuple(x) for x in found.collect()]
    assert found.columns == ["roi_id", "i", "j", "k", "v"] and len(got) == len(objects) and set(got) == objects
    each = graph.segmented(regions, frags, edges, 0.5)
    files = [f for f in each.inputFiles() if "/tables/" in f]
    assert sum(spark.read.parquet(f).count() for f in files) == len({b[1:] for b in boxes if b[0] in {w[0] for w in want}})


def test_the_segmenter_shuffles_no_voxel(spark):
    frag = spark.createDataFrame([(x, 0, 0, x // 2) for x in range(20)], "x long, y long, z long, frag_id long")
    edges = spark.createDataFrame([(0, 1, 0.1)], "u long, v long, score double")
    nodes = ingest.from_rows(spark, [(n, None, 5, 0, 0) for n in range(4)])
    found = segment.FragmentSegmenter(frag, edges, volume.View((1, 1, 1), (5, 1, 1))).segment(nodes)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 20 and 0 <= plan.find("arrays_zip(at") < plan.find("Exchange")
