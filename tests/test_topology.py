import numpy as np
import pytest

from taproot.operators import spatial, topology
from taproot.sources import ingest

TOY = [(0, 0, 0, 0, 0), (1, 0, 1, 0, 0), (2, 1, 2, 0, 0), (3, 2, 3, 0, 0), (4, 3, 4, 0, 0), (5, 4, 5, 0, 0), (6, 2, 2, 1, 0), (7, 6, 2, 2, 0), (8, 7, 2, 3, 0), (9, 7, 3, 2, 0), (10, 4, 4, 1, 0)]


@pytest.fixture(scope="module")
def toy(spark):
    return topology.index(ingest.from_rows(spark, TOY)).cache()


def ordered(df, by, what="nid"):
    return [r[what] for r in df.orderBy(by).collect()]


def test_orders(toy):
    assert ordered(topology.depth_first(toy), "rank") == [0, 1, 2, 3, 4, 5, 10, 6, 7, 8, 9]
    assert ordered(topology.breadth_first(toy), "rank") == [0, 1, 2, 6, 3, 7, 4, 9, 8, 10, 5]
    assert ordered(topology.traverse(toy, False), "rank") == ordered(topology.breadth_first(toy), "rank")
    assert [r.nid for r in toy.where(topology.is_root()).collect()] == [0]


def test_strahler(toy):
    by = {r.nid: r.order_no for r in toy.collect()}
    assert by == {0: 3, 1: 3, 2: 3, 3: 2, 4: 2, 6: 2, 7: 2, 5: 1, 8: 1, 9: 1, 10: 1}


def test_segments(toy):
    got = {}
    for r in topology.segments(toy).orderBy("seg_id", "pos").collect():
        got.setdefault(r.seg_id, []).append(r.nid)
    assert [got[k] for k in sorted(got)] == [[0, 1, 2], [2, 3, 4], [2, 6, 7], [4, 5], [4, 10], [7, 8], [7, 9]]


def test_delete_branch(spark, toy):
    cuts = spark.createDataFrame([(0, 2, 6)], "arbor_id long, a long, b long")
    left = topology.index(topology.delete_branch(toy, cuts))
    assert ordered(topology.depth_first(left), "rank") == [0, 1, 2, 3, 4, 5, 10]
    assert {r.nid: r.order_no for r in left.collect()} == {0: 2, 1: 2, 2: 2, 3: 2, 4: 2, 5: 1, 10: 1}
    up = topology.delete_branch(toy, spark.createDataFrame([(0, 6, 2)], cuts.schema))
    assert sorted(r.nid for r in up.collect()) == [6, 7, 8, 9]


def test_split_and_subtrees(spark, toy):
    got = topology.split(toy, spark.createDataFrame([(0, 2, 3, 4)], "arbor_id long, first long, second long, last long")).collect()
    assert sorted(r.nid for r in got if r.part == "upper") == [0, 1, 2, 6, 7, 8, 9]
    assert sorted(r.nid for r in got if r.part == "lower") == [4, 5, 10]
    ids = spark.createDataFrame([(0, 5), (0, 9)], "arbor_id long, nid long")
    assert sorted(r.nid for r in topology.minimal_subtree(toy, ids).collect()) == [2, 3, 4, 5, 6, 7, 9]
    assert ordered(topology.subtree(toy, ids.where("nid = 9").union(spark.createDataFrame([(0, 6)], ids.schema))).where("start = 6"), "rank") == [6, 7, 8, 9]
    assert ordered(topology.depth_first(toy, spark.createDataFrame([(0, 3)], ids.schema)), "rank") == [0, 1, 2, 6, 7, 8, 9]


def test_paths_and_kinds(toy):
    got = {}
    for r in topology.root_leaf_paths(toy).orderBy("leaf_no", "pos").collect():
        got.setdefault(r.leaf_no, []).append(r.nid)
    assert list(got.values()) == [[0, 1, 2, 3, 4, 5], [0, 1, 2, 3, 4, 10], [0, 1, 2, 6, 7, 8], [0, 1, 2, 6, 7, 9]]
    kinds = {r.nid: r.kind for r in topology.interesting(toy, True, True, True).collect()}
    assert kinds == {0: "root", 2: "branch", 4: "branch", 7: "branch", 5: "leaf", 8: "leaf", 9: "leaf", 10: "leaf"}
    copy = {r.nid: (r.pid, r.length) for r in topology.topological_copy(toy).collect()}
    assert copy == {0: (None, 0), 2: (0, 2), 4: (2, 2), 7: (2, 2), 5: (4, 1), 10: (4, 1), 8: (7, 1), 9: (7, 1)}


def test_root_merge_renumber(spark, toy):
    again = topology.index(topology.rerooted(toy, spark.createDataFrame([(0, 7)], "arbor_id long, nid long")))
    assert {r.nid: r.pid for r in again.collect()} == {7: None, 6: 7, 8: 7, 9: 7, 2: 6, 1: 2, 3: 2, 0: 1, 4: 3, 5: 4, 10: 4}
    assert {r.nid: r.pid for r in topology.reindexed(toy).collect()} == {0: None, 1: 0, 2: 1, 3: 2, 4: 3, 5: 4, 6: 4, 7: 2, 8: 7, 9: 8, 10: 8}
    other = ingest.from_rows(spark, [(20, None, 0, 0, 0), (21, 20, 1, 1, 1)])
    both = topology.index(topology.merged(toy, other, spark.createDataFrame([(0, 5, 20)], "arbor_id long, a_nid long, b_root long")))
    assert both.count() == 13 and {r.nid: r.pid for r in both.collect()}[20] == 5


def test_components_cycles_duplicates(spark):
    rows = [(1, None, 0, 0, 0), (2, 1, 0, 0, 0), (5, 99, 0, 0, 0), (6, 5, 0, 0, 0), (7, 6, 0, 0, 0), (8, 9, 0, 0, 0), (9, 8, 0, 0, 0)]
    nodes = ingest.from_rows(spark, rows)
    got = topology.index(nodes)
    assert sorted(r.nid for r in got.collect()) == [5, 6, 7]
    assert [r.excluded for r in ingest.excluded(nodes, got).collect()] == [4]
    tie = ingest.from_rows(spark, [(4, None, 0, 0, 0), (3, None, 0, 0, 0)])
    assert [r.nid for r in topology.index(tie).collect()] == [3]
    ring = ingest.from_rows(spark, [(1, 2, 0, 0, 0), (2, 1, 0, 0, 0)])
    with pytest.raises(ValueError):
        ingest.require_trees(ring, topology.index(ring))
    dup = ingest.from_rows(spark, [(1, None, 1, 0, 0, 1), (1, None, 2, 0, 0, 2)]).withColumnRenamed("strahler", "at")
    assert [r.x for r in ingest.last_wins(dup, "at").collect()] == [2.0]


def test_many_arbors_and_deep_chain(spark):
    rows = [(a, n, n - 1 if n else None, float(n), 0.0, 0.0) for a in range(300) for n in range(a % 7 + 1)]
    rows += [(1000, n, n - 1 if n else None, 0.0, 0.0, 0.0) for n in range(3000)]
    df = spark.createDataFrame(rows, "arbor_id long, nid long, pid long, x double, y double, z double")
    got = topology.index(df).groupBy("arbor_id").agg({"depth": "max", "nid": "count"}).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == {**{a: (a % 7, a % 7 + 1) for a in range(300)}, 1000: (2999, 3000)}
    assert topology.index(df.limit(0)).count() == 0


def test_csv(spark, tmp_path):
    (tmp_path / "n.csv").write_text("1,null,1.9,-2.9,3\n2,1, 4 ,5,6\n3, none ,0,0,0\n4,4,0,0,0\n|5|,1.0,7,8,9\n")
    got = {r.nid: r for r in ingest.read_csv(spark, str(tmp_path / "n.csv")).collect()}
    assert (got[1].pid, got[1].x, got[1].y) == (None, 1.0, -2.0)
    assert [got[k].pid for k in (2, 3, 4, 5)] == [1, None, None, 1] and got[2].x == 4.0


def test_radius(spark, toy):
    start = spark.createDataFrame([(0, 2)], "arbor_id long, nid long")
    assert sorted(r.nid for r in spatial.radius(toy, start, 1.5).collect()) == [1, 2, 3, 6]
    assert sorted(r.nid for r in spatial.radius(toy, start, 0.1).collect()) == [1, 2, 3, 6]
    assert sorted(r.nid for r in spatial.radius(toy, start, (2, 1, 0)).collect()) == [0, 1, 2, 3, 4, 6, 10]
    assert sorted(r.nid for r in spatial.constrained_radius(toy, start, 1, 2, 0).collect()) == [1, 2, 3, 6, 7, 9]
    assert sorted(r.nid for r in spatial.around(toy, start, 1.5).collect()) == [1, 2, 3, 6]
    spot = spark.createDataFrame([(0, 4.4, 0.4, 0.0)], "arbor_id long, px double, py double, pz double")
    assert [r.nid for r in spatial.closest(toy, spot).collect()] == [4]


def test_filters_and_orders_from(spark, toy):
    left, out = topology.filter_by_bounds(toy, (0, 0, 0), (3, 9, 9))
    assert sorted(r.nid for r in left.collect()) == [0, 1, 2, 6, 7, 8] and [r.dropped for r in out.collect()] == [5]
    assert sorted(r.nid for r in topology.filter_by_order(toy, 2).collect()) == [0, 1, 2, 3, 4, 6, 7]
    same = {r.nid: r.order_no for r in topology.order_from(toy, toy).collect()}
    assert same == {r.nid: r.order_no for r in toy.collect()}
    assert topology.regularness(toy).first().edges == 10


def test_within_meets_every_pair_once(spark):
    """Places and spans of several arbors against all pairs; empty spans hold nothing, equal ones count each."""
    rng = np.random.default_rng(7)
    points = [(int(a), int(p)) for a in range(3) for p in rng.integers(0, 300, 60)]
    spans = [(int(a), int(lo), int(lo + w), n) for n, (a, lo, w) in enumerate(zip(rng.integers(0, 4, 80), rng.integers(0, 250, 80), rng.integers(0, 60, 80)))]
    spans.append((0, 5, 5, 100))
    spans.append((*spans[0][:3], 101))
    got = topology.within(spark.createDataFrame(points, "arbor_id bigint, dfs bigint"), spark.createDataFrame(spans, "arbor_id bigint, lo bigint, hi bigint, n int"))
    want = sorted((a, p, n) for a, p in points for b, lo, hi, n in spans if a == b and lo <= p < hi)
    assert sorted((r.arbor_id, r.dfs, r.n) for r in got.collect()) == want


def test_paths_of_one_large_tree(spark):
    """A tree of 2**17 - 1 nodes in one arbor: as many steps as the leaves are deep, without all pairs."""
    n = 2**17 - 1
    nodes = spark.range(1, n + 1).selectExpr("0L arbor_id", "id nid", "nullif(id div 2, 0) pid", "0D x", "0D y", "0D z")
    paths = topology.root_leaf_paths(topology.index(nodes))
    assert tuple(paths.selectExpr("count(*)", "count(distinct leaf)", "max(pos)").first()) == (17 * 2**16, 2**16, 16)


def test_kernels_get_bounded_tables(spark):
    """Tables of small arbors stay small, however many rows a task has."""
    import pyarrow as pa

    from taproot.operators.arrow import by_arbor

    nodes = spark.range(150_000).selectExpr("id div 5 as arbor_id", "id as nid").coalesce(1)
    got = by_arbor(nodes, lambda t: pa.table({"n": pa.array([t.num_rows], pa.int64())}), "n bigint").collect()
    assert sum(r.n for r in got) == 150_000 and max(r.n for r in got) <= 60_000
