import numpy as np
from pyspark.sql import functions as F
from test_topology import TOY

from taproot.operators import lineage, topology, tour


def same(spark, nodes):
    plain = lambda df: sorted(str(tuple(r)) for r in df.collect())
    want = topology.index(nodes)
    got = tour.index(nodes)
    assert got.columns == want.columns and dict(got.dtypes) == dict(want.dtypes)
    assert plain(got) == plain(want)


def random_tree(n, seed, near):
    """Parents among the ``near`` nodes before, ids shuffled."""
    rng = np.random.default_rng(seed)
    ids = rng.permutation(n) * 3 + 1
    up = [None] + [int(ids[int(rng.integers(max(0, k - near), k))]) for k in range(1, n)]
    return [(int(i), p, float(i % 7), 1.0, 2.0) for i, p in zip(ids, up, strict=True)]


def test_equals_the_kernel_on_odd_forests(spark, monkeypatch):
    """Cycles, several roots, missing parents, self-parents, lone nodes; short stretches."""
    monkeypatch.setattr(tour, "STRETCH", 4)
    rows = [(1, *r) for r in TOY]
    rows += [(2, 1, None, 0, 0, 0)] + [(2, n, n - 1, n, 0, 0) for n in range(2, 30)]
    rows += [(3, 1, 2, 0, 0, 0), (3, 2, 1, 0, 0, 0), (3, 5, 99, 0, 0, 0), (3, 6, 5, 0, 0, 0), (3, 8, 8, 0, 0, 0), (3, 9, 8, 0, 0, 0)]
    rows += [(4, 7, 8, 0, 0, 0), (4, 8, 7, 0, 0, 0), (5, 3, None, 0, 0, 0)]
    rows += [(6, *r) for r in random_tree(60, 1, 60)] + [(7, *r) for r in random_tree(60, 2, 3)]
    df = spark.createDataFrame([(a, n, p, float(x), float(y), float(z)) for a, n, p, x, y, z in rows], "arbor_id bigint, nid bigint, pid bigint, x double, y double, z double")
    same(spark, df.repartition(3))


def test_no_tree_at_all(spark):
    rows = [(4, 7, 8, 0.0, 0.0, 0.0), (4, 8, 7, 0.0, 0.0, 0.0)]
    assert tour.index(spark.createDataFrame(rows, "arbor_id bigint, nid bigint, pid bigint, x double, y double, z double")).count() == 0


def test_a_large_tree_over_several_tasks(spark):
    near = F.pmod(F.xxhash64("id"), F.least("id", F.lit(40)))
    nodes = spark.range(30_000, numPartitions=4).select(
        F.lit(1).cast("bigint").alias("arbor_id"), F.col("id").alias("nid"), F.when(F.col("id") > 0, F.col("id") - 1 - near).alias("pid"),
        *[F.lit(0.0).alias(c) for c in "xyz"],
    )
    got = lineage.cut(tour.index(nodes))
    first = got.selectExpr("count(*) n", "count(distinct dfs) d", "max(dfs) m", "max(bfs) b", "sum(size) s", "sum(depth + 1) e", "max(order_no) o").first()
    assert first.n == first.d == 30_000 and first.m == first.b == 29_999
    assert first.s == first.e and first.o > 3


def test_ways_inside_a_part_take_no_round(spark, monkeypatch):
    """Doubling is left the ways between parts of ids; in short parts the rows are the same."""
    df = spark.createDataFrame([(1, *r) for r in random_tree(40, 5, 3)] + [(2, 4, 5, 0.0, 0.0, 0.0), (2, 5, 4, 0.0, 0.0, 0.0)], "arbor_id bigint, nid bigint, pid bigint, x double, y double, z double")
    rounds = []
    real = tour.stored
    monkeypatch.setattr(tour, "stored", lambda d: rounds.append(d) or real(d))
    links = real(tour.linked(df.where("arbor_id = 1")))
    want = sorted(map(tuple, tour.ranked(links).collect()))
    assert len(rounds) == 2  # arcs, and both arcs of each node
    for near in (1, 7):
        monkeypatch.setattr(tour, "NEAR", near)
        assert sorted(map(tuple, tour.ranked(links).collect())) == want
        same(spark, df)
    assert len(rounds) > 6


def test_no_table_of_nodes_is_broadcast(spark, monkeypatch):
    """Written tables of arcs and nodes are small as files and pass through the driver all the same."""
    plans = []
    real = tour.stored

    def stored(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(tour, "stored", stored)
    monkeypatch.setattr(tour, "NEAR", 4)
    rows = [(1, *r) for r in random_tree(40, 5, 3)]
    out = tour.index(spark.createDataFrame(rows, "arbor_id bigint, nid bigint, pid bigint, x double, y double, z double"))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 8 and any("SortMergeJoin" in p for p in plans)
    assert not any("Broadcast" in p for p in plans)
