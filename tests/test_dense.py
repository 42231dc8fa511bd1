import numpy as np
import pytest
from test_topology import TOY

from taproot.operators import dense, lineage, scores, volume
from taproot.sources import ingest


def test_equals_the_sparse_form(spark):
    nodes = ingest.from_rows(spark, [(n, p, 7 * x - 9, 5 * y - 3, z) for n, p, x, y, z in TOY])
    view = volume.View((1, 2, 1), (9, 7, 5))
    box = volume.offsets(nodes.where("nid <> 4").select("arbor_id", "nid"), view)
    masks = box.selectExpr("arbor_id", "nid", "i", "j", "k", "cast(if((nid * 31 + i * 7 + j * 13 + k * 17) % 5 < 3, 1, 0) as tinyint) as v")
    got = dense.to_voxels(dense.accumulate(nodes, dense.packed(masks, view), view, (4, 8, 3)), (4, 8, 3))
    want = volume.accumulate(nodes, masks, view)
    plain = lambda df: sorted((r.vx, r.vy, r.vz, r.seg_count, r.view_count, None if r.distance is None else round(r.distance, 9)) for r in df.collect())
    assert str(plain(got)) == str(plain(want))


def test_a_large_field_of_view(spark):
    nodes = ingest.from_rows(spark, [(1, None, 50, 60, 70), (2, 1, 90, 60, 70)])
    view = volume.View((1, 1, 1), (101, 101, 51))
    sums = dense.accumulate(nodes, spark.createDataFrame([], "arbor_id long, nid long, bits binary"), view)
    total = sums.selectExpr("sum(aggregate(view, 0, (a, x) -> a + x)) as n").first().n
    assert total == 2 * 101 * 101 * 51


def test_masks_and_centres_are_set_once(spark):
    one = spark.createDataFrame([(0, 1, 0, 0, 0, 1)], "arbor_id long, nid long, i int, j int, k int, v int")
    two = spark.createDataFrame([(0, 2, 0, 0, 0, 1)], one.schema)
    assert volume.filled(one, two).count() == 2
    with pytest.raises(Exception, match="has a mask"):
        volume.filled(one, one).collect()
    bare = ingest.from_id_pairs(spark, [(1, None), (2, 1)]).union(ingest.from_rows(spark, [(3, 1, 5, 5, 5)]))
    got = ingest.with_centers(bare, ingest.from_rows(spark, [(2, 1, 7, 8, 9), (3, 1, 0, 0, 0)]))
    assert {r.nid: r.x for r in got.collect()} == {1: None, 2: 7.0, 3: 5.0}


def forest(spark, view, most=3):
    nodes = ingest.from_rows(spark, [(n, p, 3 * x - 9, 2 * y - 3, z) for n, p, x, y, z in TOY])
    box = volume.offsets(nodes.where("nid <> 4").select("arbor_id", "nid"), view)
    masks = box.selectExpr("arbor_id", "nid", "i", "j", "k", "cast(if(nid <> 5 and (nid * 31 + i * 7 + j * 13 + k * 17) % 5 < 3, 1, 0) as tinyint) as v")
    return nodes, masks


LEAF = (4, 8, 3)


@pytest.mark.parametrize("sphere", [True, False])
def test_ranking_equals_the_sparse_form_with_crowded_blocks(spark, sphere):
    view = volume.View((1, 2, 1), (9, 7, 5), sphere)
    nodes, masks = forest(spark, view)
    bits = dense.packed(masks, view)
    sums = dense.accumulate(nodes, bits, view, LEAF, most=2)
    voxels = volume.accumulate(nodes, masks, view)
    plain = lambda df: sorted(str(tuple(round(v, 9) + 0.0 if isinstance(v, float) else v for v in r)) for r in df.collect())
    for consensus in (False, True):
        assert plain(dense.ranking(nodes, bits, sums, view, LEAF, consensus, most=2)) == plain(scores.ranking(nodes, masks, voxels, view, consensus))
    assert not dense.crowded(dense.met(nodes, view, LEAF), 2).isEmpty()
    assert sums.count() == sums.select(*dense.KEY).distinct().count()


def test_masks_equal_the_sparse_form(spark):
    view = volume.View((1, 2, 1), (9, 7, 5))
    nodes, masks = forest(spark, view)
    sums = dense.accumulate(nodes, dense.packed(masks, view), view, LEAF)
    want = {}
    for r in volume.weighted(nodes, volume.accumulate(nodes, masks, view), view).collect():
        want.setdefault(r.nid, {})[(r.i * 7 + r.j) * 5 + r.k] = r
    for value in ("boolean", "dist", "viewed", "dist_view"):
        for r in dense.weighted(nodes, sums, view, LEAF, value).collect():
            assert r.mask == pytest.approx([float(getattr(want[r.nid][p], value)) for p in range(9 * 7 * 5)])


def test_nodes_outside_all_blocks_score_nothing(spark):
    view = volume.View((1, 1, 1), (5, 5, 5))
    nodes, masks = forest(spark, view)
    sums = dense.accumulate(nodes, dense.packed(masks, view), view, LEAF).where("false")
    assert {(r.di, r.score) for r in dense.max_vectors(nodes, sums, view, LEAF).collect()} == {(0, 0.0)}


def test_the_fixture_sized_field_of_view(spark):
    """193 x 193 x 49 voxels a node: views and scores without a row per voxel."""
    view = volume.View((16, 16, 35), (193, 193, 49))
    nodes = ingest.from_rows(spark, [(n, n - 1 or None, 400 * n, 300 * n, 70 * n) for n in range(1, 9)])
    full = np.packbits(np.ones(view.fov, bool)).tobytes()
    bits = nodes.select("arbor_id", "nid").crossJoin(spark.createDataFrame([(bytearray(full),)], "bits binary"))
    sums = lineage.cut(dense.accumulate(nodes, bits, view))
    assert sums.selectExpr("sum(aggregate(view, 0L, (a, x) -> a + x)) as n").first().n == 8 * 193 * 193 * 49
    rows = {r.nid: r for r in dense.ranking(nodes, bits, sums, view).collect()}
    assert len(rows) == 8 and rows[1].connectivity is None
    assert all(rows[n].connectivity == 1.0 and rows[n].branch_score > 0 for n in range(2, 9))
