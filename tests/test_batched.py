"""Voxels go to blocks before they are shuffled; crowded blocks are shared."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from taproot.operators import batched, blocks, mesh, scores, volume

VIEW = volume.View((1, 1, 2), (5, 3, 5))


@pytest.fixture(scope="module")
def forest(spark):
    nodes = spark.range(12).select(
        (F.col("id") % 2).alias("arbor_id"), F.col("id").alias("nid"), F.lit(None).cast("bigint").alias("pid"),
        (F.col("id") * 3 - 15.0).alias("x"), (F.col("id") % 3 + 6.0).alias("y"), (F.col("id") % 4 * 5.0).alias("z"),
    )
    masks = volume.offsets(nodes.where("nid <> 7"), VIEW).selectExpr("arbor_id", "nid", "i", "j", "k", "cast((nid + i * 2 + j + k * 3) % 3 > 0 as tinyint) as v")
    return nodes.cache(), masks.cache()


def brute(nodes, masks):
    """Sums a row for each voxel of each field of view."""
    rows = volume.fields(nodes, VIEW).join(masks, ["arbor_id", "nid", "i", "j", "k"], "left")
    d = [F.col("d" + c) for c in "ijk"]
    far = F.when(VIEW.in_sphere(*d), VIEW.distance(*d))
    return rows.groupBy("arbor_id", "vx", "vy", "vz").agg(F.coalesce(F.sum(F.col("v").cast("bigint")), F.lit(0)), F.count(F.lit(1)), F.round(F.min(far), 9))


def test_sums_equal_brute_force_and_crowded_blocks_are_shared(forest):
    nodes, masks = forest
    want = sorted(map(tuple, brute(nodes, masks).collect()), key=str)
    for most in (2, 2048):
        got = volume.accumulate(nodes, masks, VIEW, most=most).withColumn("distance", F.round("distance", 9))
        assert sorted(map(tuple, got.collect()), key=str) == want


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line], plan


def test_no_row_per_voxel_is_shuffled(forest):
    nodes, masks = forest
    voxels = volume.accumulate(nodes, masks, VIEW)
    masked = volume.weighted(nodes, voxels, VIEW)
    value = voxels.withColumn("value", F.col("seg_count"))
    cells = mesh.edge_cells(value, 0.5)
    for df in (voxels, masked, scores.branch_scores(nodes, voxels, VIEW), blocks.from_voxels(value, (8, 8, 8)), cells, mesh.corners(cells), scores.best_path(masked)):
        lines, plan = exchanges(df)
        assert lines and not any("vx#" in x or "x#" in x.split("bx#")[0] or "spot#" in x for x in lines)
        assert "collect_list" not in plan


def test_no_mask_or_score_is_broadcast(forest):
    nodes, masks = forest
    voxels = volume.accumulate(nodes, masks, VIEW)
    for df in (scores.connectivity(nodes, masks, VIEW), scores.ranking(nodes, masks, voxels, VIEW, True)):
        lines, plan = exchanges(df)
        # crowded blocks alone, at most one row in MOST, are sent to all
        assert "BroadcastHashJoin [arbor_id" not in "".join(x for x in plan.splitlines() if "bx#" not in x)
        assert not any(f" {c}#" in x.split("ENSURE")[0] for x in lines for c in "ijk")


def test_connectivity_in_parts(spark, monkeypatch):
    """Edges that overlap fully, by one voxel and not at all, and masks that are missing or hold nothing."""
    at = [(1, None, 0), (2, 1, 4), (3, 1, 5), (4, 1, 0), (5, 4, 0), (6, 1, 0)]
    nodes = spark.createDataFrame([(0, n, p, float(x), 0.0, 0.0) for n, p, x in at], "arbor_id long, nid long, pid long, x double, y double, z double")
    masks = volume.offsets(nodes.where("nid <> 5").select("arbor_id", "nid"), VIEW).selectExpr("arbor_id", "nid", "i", "j", "k", "cast(if(nid = 6, 0, 1) as tinyint) as v")
    want = {2: 1.0, 3: -2.0, 4: 1.0, 5: -1.0, 6: 0.0}
    for most in (batched.PLACES, 1):
        monkeypatch.setattr(batched, "PLACES", most)
        assert {r.nid: r.connectivity for r in scores.connectivity(nodes, masks, VIEW).collect()} == want


def test_masks_become_bits(spark):
    for view in (VIEW, volume.View((1, 1, 1), (11, 11, 11))):
        total = int(np.prod(view.fov))
        masks = volume.offsets(spark.range(3).selectExpr("id as arbor_id", "id + 5 as nid"), view).selectExpr("arbor_id", "nid", "i", "j", "k", "cast((i + j * 2 + k * 5) % 4 = arbor_id as tinyint) as v")
        got = {r.arbor_id: np.unpackbits(np.frombuffer(r.bits, np.uint8), count=total).reshape(view.fov) for r in batched.packed(masks, view).collect()}
        i, j, k = np.indices(view.fov)
        for arbor in range(3):
            assert (got[arbor] == ((i + j * 2 + k * 5) % 4 == arbor)).all()
    with pytest.raises(Exception, match="off its field of view"):
        batched.packed(masks.withColumn("i", F.col("i") + 1), view).collect()


def test_corners_with_several_values_stay(spark):
    rows = [(0, x, 0, 0, [float(x + n) for n in range(8)]) for x in (6, 7, 8)]
    got = mesh.corners(spark.createDataFrame(rows, "arbor_id long, vx long, vy long, vz long, w array<double>")).select("x", "y", "z", "scalar")
    want = {(x + (n >> 2), n >> 1 & 1, n & 1, float(x + n)) for x in (6, 7, 8) for n in range(8)}
    assert len(want) == 24 and sorted(map(tuple, got.collect())) == sorted(want)


def test_downsampling_groups_words_not_cells(spark):
    view, factor = volume.View((1, 1, 1), (11, 9, 7)), (2, 3, 1)
    masks = volume.offsets(spark.range(2).selectExpr("id as arbor_id", "id + 5 as nid"), view).selectExpr("arbor_id", "nid", "i", "j", "k", "cast((i * j + k + nid) % 3 > 0 as tinyint) as v").where("i + j + k <> 9")
    out = volume.downsampled(masks, factor)
    by = [F.floor(F.col(c) / f).alias(c) for c, f in zip("ijk", factor, strict=True)]
    want = masks.groupBy("arbor_id", "nid", *by).agg(F.sum("v").alias("n")).selectExpr("arbor_id", "nid", "i", "j", "k", "cast(255 * n > 127 * 6 as tinyint)")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "bit_or" in plan and "i_#" in plan
    with pytest.raises(Exception, match="more in a block"):
        volume.downsampled(masks.withColumn("v", F.lit(300)), factor).collect()


def noise(spark):
    r = np.random.default_rng(4)
    at = {(int(a), *map(int, p)): float(w) for a, p, w in zip(r.integers(0, 2, 300), r.integers(-10, 10, (300, 3)), r.integers(1, 5, 300), strict=True)}
    return spark.createDataFrame([(*k, w) for k, w in at.items()], "arbor_id long, vx long, vy long, vz long, value double")


def plain(df):
    return sorted(tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r) for r in df.collect())


def test_packed_counts_are_those_of_voxels(forest):
    nodes, masks = forest
    want = sorted((r.arbor_id, r.vx, r.vy, r.vz, float(r.seg_count)) for r in volume.accumulate(nodes, masks, VIEW).where("seg_count > 0").collect())
    for most in (2, 2048):
        got = []
        for r in volume.live(nodes, masks, VIEW, (8, 4, 16), most).collect():
            p = np.stack(np.unravel_index(np.frombuffer(r.p, "i4"), (8, 4, 16)), axis=1) + np.array([r.bx, r.by, r.bz]) * (8, 4, 16)
            got += [(r.arbor_id, *map(int, x), w) for x, w in zip(p, np.frombuffer(r.w, "f8").tolist(), strict=True)]
        assert sorted(got) == want


@pytest.mark.parametrize("resolution, cell", [((1, 1, 1), 2.0), ((1, 2, 3), 0.7)])
def test_decimation_tells_clusters_not_triangles(spark, monkeypatch, resolution, cell):
    monkeypatch.setattr(mesh, "AT_ONCE", 3)  # clusters and triangles come from many tables
    voxels = noise(spark)
    want = mesh.decimated(mesh.triangles(mesh.edge_cells(voxels), 0.5, resolution), cell)
    got = mesh.surface(voxels, 0.5, resolution, cell)
    lines, plan = exchanges(got)
    assert plain(got) == plain(want)
    assert len(lines) == 2 and "Broadcast" not in plan and not any("ax#" in x for x in lines)


def test_triangles_are_measured_where_they_are_made(spark):
    packed = mesh.of_voxels(noise(spark))
    want = {}
    for r in mesh.surface_of(packed, 0.5, (4, 4, 10)).collect():
        p = np.array(r[1:]).reshape(3, 3)
        n = np.cross(p[1] - p[0], p[2] - p[0])
        w = want.setdefault(r.arbor_id, np.zeros(3))
        w += [1, np.linalg.norm(n) / 2, p[0] @ n / 6]
    got = {r.arbor_id: [r.triangles, r.area, r.volume] for r in mesh.measures(packed, 0.5, (4, 4, 10)).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[a], want[a]) for a in want)


def test_vertices_come_without_cells(spark):
    voxels = noise(spark)
    got = mesh.vertices(mesh.of_voxels(voxels), 0.5, (4, 4, 10))
    assert len(exchanges(got)[0]) == 1
    assert plain(got) == plain(mesh.corners(mesh.edge_cells(voxels), (4, 4, 10)))


def test_cells_name_their_corners_unsorted(spark):
    cells = mesh.cells_of(mesh.of_voxels(noise(spark)), values=False)
    assert cells.columns == ["arbor_id", "vx", "vy", "vz"]
    cubes = mesh.hexahedra(cells)
    assert "array_sort" not in cubes._jdf.queryExecution().optimizedPlan().toString()
    corner = lambda d: mesh.vertex_id(*[F.col("v" + a) + F.lit(c) for a, c in zip("xyz", d, strict=True)])
    want = cells.select("arbor_id", corner((0, 0, 0)).alias("cid"), F.array_sort(F.array(*[corner(d) for d in mesh.CORNERS])).alias("vids"))
    assert sorted(map(str, cubes.collect())) == sorted(map(str, want.collect()))
    with pytest.raises(Exception, match="too far out"):
        mesh.hexahedra(spark.createDataFrame([(0, 0, mesh.SHIFT - 1, 0)], "arbor_id long, vx long, vy long, vz long")).collect()


@pytest.mark.parametrize("most", [2, 2048])
def test_an_edit_is_scored_in_one_pass(forest, most):
    """As the old volume, the new one and their difference give it, in crowded blocks too; voxels are not joined."""
    nodes, masks = forest
    kept = nodes.where("nid not in (2, 5)")
    voxels = volume.accumulate(nodes, masks, VIEW)
    want = scores.scores_where_changed(kept, voxels, masks, scores.branch_scores(nodes, voxels, VIEW), VIEW)
    got = scores.scores_of_edit(nodes, kept, masks, VIEW, most=most)
    lines, plan = exchanges(got)
    assert not any("vx#" in x for x in lines)
    assert plain(got) == plain(want)
    changed = {r.nid for r in volume.edited(nodes, kept, masks, VIEW, most=most).where("kept and changed").collect()}
    assert changed == {r.nid for r in scores.changed_nodes(kept, voxels, volume.accumulate(kept, masks, VIEW), VIEW).collect()}
