"""Tree topology: one indexing pass per forest, then plain filters and joins.

``index`` numbers every tree in pre-order and stores the size of each subtree.  The descendants of
``a`` are then the rows whose ``dfs`` lies in [a.dfs, a.dfs + a.size), and its ancestors those whose
interval holds ``a.dfs``, so subtree, path and cut operators need neither recursion nor a closure.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taproot import schemas
from taproot.operators.arrow import by_arbor


def _index(t: pa.Table) -> pa.Table:
    arbor, nid = t.column("arbor_id").to_numpy(), t.column("nid").to_numpy()
    has = ~np.asarray(t.column("pid").is_null())
    pid = t.column("pid").combine_chunks().fill_null(0).to_numpy()
    n = len(nid)
    ids = np.unique(nid)
    tree = np.cumsum(np.r_[0, arbor[1:] != arbor[:-1]]).astype(np.int64)
    own = tree * len(ids) + np.searchsorted(ids, nid)
    code = np.minimum(np.searchsorted(ids, pid), len(ids) - 1)
    at = np.minimum(np.searchsorted(own, tree * len(ids) + code), n - 1)
    has &= (ids[code] == pid) & (own[at] == tree * len(ids) + code) & (pid != nid)
    parent = np.where(has, at, -1)
    kids = np.argsort(parent, kind="stable")
    kids = kids[np.searchsorted(parent[kids], 0) :]  # without roots; siblings by ascending nid
    n_kids = np.bincount(parent[kids], minlength=n)
    first = np.searchsorted(parent[kids], np.arange(n))
    depth, root = np.full(n, -1), np.full(n, -1)
    level, levels = np.flatnonzero(parent < 0), []
    depth[level], root[level] = 0, level
    while len(level):
        levels.append(level)
        many = n_kids[level]
        spots = np.repeat(first[level] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
        level = kids[spots]
        depth[level], root[level] = len(levels), root[parent[level]]
    size, top, ties, order_no = np.ones(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, np.int64)
    for level in reversed(levels):
        order_no[level] = np.where(n_kids[level] == 0, 1, top[level] + (ties[level] >= 2))
        up = parent[level]
        low, up = level[up >= 0], up[up >= 0]
        np.add.at(size, up, size[low])
        np.maximum.at(top, up, order_no[low])
        np.add.at(ties, up[order_no[low] == top[up]], 1)
    # only the largest component of a tree stays, the one of least root on ties; cycles have no depth
    roots = levels[0] if levels else np.array([], int)
    best = np.full(tree[-1] + 1 if n else 0, -1)
    for r in roots[np.lexsort((roots, -size[roots]))][::-1]:
        best[tree[r]] = r
    keep = (depth >= 0) & (root == best[tree])
    before = np.cumsum(size[kids]) - size[kids]
    elder = np.zeros(n, np.int64)
    elder[kids] = before - before[first[parent[kids]]] if len(kids) else 0
    dfs, head, seg_depth = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n, np.int64)
    for level in levels[1:]:
        up = parent[level]
        dfs[level] = dfs[up] + 1 + elder[level]
        new = (parent[up] < 0) | (n_kids[up] > 1)
        head[level] = np.where(new, level, head[up])
        seg_depth[level] = np.where(new, np.where(parent[up] < 0, 0, seg_depth[up] + 1), seg_depth[up])
    rows = np.flatnonzero(keep)
    rank = lambda *keys: _rank(tree[rows], *keys)
    bfs = rank(depth[rows], -dfs[rows])
    heads = np.flatnonzero(keep & (head == np.arange(n)))
    seg_id = np.full(n, -1)
    seg_id[heads] = _rank(tree[heads], seg_depth[heads], dfs[heads])
    inside = head[rows] >= 0
    h = np.where(inside, head[rows], 0)
    null = lambda v, kind: pa.array(v, kind, mask=~inside)
    out = t.select(["arbor_id", "nid", "pid", "x", "y", "z"]).take(pa.array(rows))
    out = out.set_column(2, "pid", pa.array(nid[np.maximum(parent[rows], 0)], pa.int64(), mask=parent[rows] < 0))
    made = {
        "depth": pa.array(depth[rows], pa.int64()), "dfs": pa.array(dfs[rows], pa.int64()), "size": pa.array(size[rows], pa.int64()),
        "bfs": pa.array(bfs, pa.int64()), "n_children": pa.array(n_kids[rows], pa.int64()), "order_no": pa.array(order_no[rows], pa.int32()),
        "seg_head": null(nid[h], pa.int64()), "seg_depth": null(seg_depth[rows], pa.int64()), "seg_id": null(seg_id[h], pa.int64()),
        "seg_pos": null(depth[rows] - depth[h] + 1, pa.int32()), "root_nid": pa.array(nid[root[rows]], pa.int64()),
    }
    for name, column in made.items():
        out = out.append_column(name, column)
    return out


def _rank(group: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Place of each row in its group, from 0, by ``keys``."""
    order = np.lexsort((*keys[::-1], group))
    g = group[order]
    start = np.r_[0, np.flatnonzero(g[1:] != g[:-1]) + 1] if len(g) else np.array([], int)
    place = np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)]))
    out = np.empty(len(g), np.int64)
    out[order] = place
    return out


def index(nodes: DataFrame) -> DataFrame:
    """``nodes`` of every arbor's largest tree with ``depth, dfs, size, bfs, n_children, order_no`` and
    the place in its segment.

    A node whose parent is itself, null or not in the arbor is a root.  Of several components the one
    of most nodes stays, of equal ones that of the least root; nodes on cycles go.  ``dfs`` is
    pre-order with siblings ascending, ``bfs`` level order with siblings descending, ``order_no`` the
    Strahler number.  Duplicate node ids are to be resolved before (``ingest.last_wins``).
    """
    return by_arbor(nodes.select("arbor_id", "nid", "pid", "x", "y", "z"), _index, schemas.INDEXED)


# ------------------------------------------------------------------ predicates


def neighbours_count() -> Column:
    return F.col("n_children") + F.when(F.col("pid").isNull(), 0).otherwise(1)


def is_root() -> Column:
    return F.col("pid").isNull()


def is_leaf() -> Column:
    """No children; a lone root is a leaf."""
    return F.col("n_children") == 0


def is_branch() -> Column:
    """More than two neighbours, so that a root needs three children."""
    return neighbours_count() > 2


def is_regular() -> Column:
    """Exactly two neighbours; a root of two children is regular."""
    return neighbours_count() == 2


# ------------------------------------------------------------------ traversal


def within(points: DataFrame, spans: DataFrame) -> DataFrame:
    """``points(arbor_id, dfs, ..)`` with the columns of every one of ``spans(arbor_id, lo, hi, ..)`` that
    holds ``dfs``: lo <= dfs < hi.

    Spans are cut into aligned runs of 2**k places, at most two for each k, and a place looks up one run
    for each k that the spans of its arbor need.  So the join is on equal runs, not places x spans of an
    arbor, and each pair meets in one run alone.
    """
    k = lambda width: F.floor(F.log2(width.cast("double"))).cast("int")
    width = F.col("hi") - F.col("lo")
    full = spans.where("hi > lo")
    deep = full.groupBy("arbor_id").agg(k(F.max(width)).alias("deep_"))
    first, end = F.expr("(lo + shiftleft(1L, k_) - 1) div shiftleft(1L, k_)"), F.expr("hi div shiftleft(1L, k_)")
    runs = full.withColumn("k_", F.explode(F.sequence(F.lit(0), k(width)))).withColumns({"first_": first, "end_": end}).where("first_ < end_")
    ends = F.filter(F.array(F.when(F.col("first_") % 2 == 1, F.col("first_")), F.when(F.col("end_") % 2 == 1, F.col("end_") - 1)), lambda r: r.isNotNull())
    runs = runs.withColumn("run_", F.explode(ends)).drop("first_", "end_")
    places = points.join(deep, "arbor_id").withColumn("k_", F.explode(F.sequence(F.lit(0), F.col("deep_"))))
    places = places.withColumn("run_", F.expr("dfs div shiftleft(1L, k_)")).drop("deep_")
    return places.join(runs, ["arbor_id", "k_", "run_"]).drop("k_", "run_")


def pruned(indexed: DataFrame, ignore: DataFrame) -> DataFrame:
    """Without the subtrees of ``ignore(arbor_id, nid)``."""
    cut = indexed.join(ignore.select("arbor_id", "nid"), ["arbor_id", "nid"], "left_semi")
    spans = cut.select("arbor_id", F.col("dfs").alias("lo"), (F.col("dfs") + F.col("size")).alias("hi"))
    gone = within(indexed.select("arbor_id", "nid", "dfs"), spans).select("arbor_id", "nid")
    return indexed.join(gone, ["arbor_id", "nid"], "left_anti")


def depth_first(indexed: DataFrame, ignore: DataFrame | None = None) -> DataFrame:
    """``arbor_id, nid, rank`` in pre-order; an ignored node takes its whole subtree along."""
    if ignore is None:  # the index has it already
        return indexed.select("arbor_id", "nid", F.col("dfs").cast("bigint").alias("rank"))
    left = pruned(indexed, ignore)
    rank = F.row_number().over(Window.partitionBy("arbor_id").orderBy("dfs")) - 1
    return left.select("arbor_id", "nid", rank.cast("bigint").alias("rank"))


def breadth_first(indexed: DataFrame, ignore: DataFrame | None = None) -> DataFrame:
    """``arbor_id, nid, rank`` by levels, siblings descending."""
    if ignore is None:
        return indexed.select("arbor_id", "nid", F.col("bfs").cast("bigint").alias("rank"))
    left = pruned(indexed, ignore)
    rank = F.row_number().over(Window.partitionBy("arbor_id").orderBy("depth", F.desc("dfs"))) - 1
    return left.select("arbor_id", "nid", rank.cast("bigint").alias("rank"))


def traverse(indexed: DataFrame, fifo: bool = True) -> DataFrame:
    return depth_first(indexed) if fifo else breadth_first(indexed)


def subtree(indexed: DataFrame, starts: DataFrame) -> DataFrame:
    """``arbor_id, start, nid, rank`` of the subtree of each of ``starts(arbor_id, nid)``, in pre-order."""
    s = starts.select("arbor_id", "nid").join(indexed.select("arbor_id", "nid", "dfs", "size"), ["arbor_id", "nid"])
    s = s.select("arbor_id", F.col("nid").alias("start"), F.col("dfs").alias("lo"), (F.col("dfs") + F.col("size")).alias("hi"))
    both = within(indexed.select("arbor_id", "nid", "dfs"), s)
    return both.select("arbor_id", "start", "nid", (F.col("dfs") - F.col("lo")).alias("rank"))


def ancestors(indexed: DataFrame, nodes: DataFrame) -> DataFrame:
    """``arbor_id, nid, anc, dist`` for each of ``nodes(arbor_id, nid)``; a node is its own at 0."""
    low = nodes.select("arbor_id", "nid").join(indexed.select("arbor_id", "nid", "dfs", "depth"), ["arbor_id", "nid"])
    up = indexed.select("arbor_id", F.col("nid").alias("anc"), F.col("dfs").alias("lo"), (F.col("dfs") + F.col("size")).alias("hi"), F.col("depth").alias("up"))
    both = within(low, up)
    return both.select("arbor_id", "nid", "anc", (F.col("depth") - F.col("up")).cast("int").alias("dist"))


def root_leaf_paths(indexed: DataFrame) -> DataFrame:
    """``arbor_id, leaf_no, leaf, pos, nid``: the path from root to each leaf, leaves in pre-order."""
    leaves = indexed.where(is_leaf())
    number = F.row_number().over(Window.partitionBy("arbor_id").orderBy("dfs")) - 1
    numbered = leaves.select("arbor_id", F.col("nid").alias("leaf"), number.cast("bigint").alias("leaf_no"), F.col("depth").alias("low"))
    path = ancestors(indexed, leaves).withColumnRenamed("nid", "leaf")
    return path.join(numbered, ["arbor_id", "leaf"]).select(
        "arbor_id", "leaf_no", "leaf", (F.col("low") - F.col("dist")).cast("int").alias("pos"), F.col("anc").alias("nid")
    )


def neighbours(nodes: DataFrame) -> DataFrame:
    """``arbor_id, nid, other``: parent and children of every node."""
    edges = nodes.where("pid is not null").select("arbor_id", "nid", F.col("pid").alias("other"))
    return edges.union(edges.select("arbor_id", F.col("other").alias("nid"), F.col("nid").alias("other")))


def following(nodes: DataFrame, previous: DataFrame) -> DataFrame:
    """Neighbours of each node of ``previous(arbor_id, nid, prev)`` but the one come from.

    A ``prev`` that is no neighbour takes none away; nothing is changed in the tree.
    """
    return neighbours(nodes).join(previous.select("arbor_id", "nid", "prev"), ["arbor_id", "nid"]).where("other <> prev or prev is null").select("arbor_id", "nid", "other")


def children(nodes: DataFrame) -> DataFrame:
    """``arbor_id, nid, children`` with ascending keys; leaves have an empty array."""
    kids = nodes.where("pid is not null").groupBy("arbor_id", F.col("pid").alias("nid")).agg(F.sort_array(F.collect_list(F.col("nid"))).alias("children"))
    none = F.array().cast("array<bigint>")
    return nodes.select("arbor_id", "nid").join(kids, ["arbor_id", "nid"], "left").select("arbor_id", "nid", F.coalesce("children", none).alias("children"))


def interesting(indexed: DataFrame, root: bool = False, leaves: bool = False, branches: bool = False) -> DataFrame:
    """``arbor_id, nid, kind`` of the kinds asked for; a node that is several is named root first, then branch."""
    kind = F.lit(None).cast("string")
    if leaves:
        kind = F.when(is_leaf(), "leaf").otherwise(kind)
    if branches:
        kind = F.when(is_branch(), "branch").otherwise(kind)
    if root:
        kind = F.when(is_root(), "root").otherwise(kind)
    return indexed.select("arbor_id", "nid", "dfs", kind.alias("kind")).where("kind is not null")


# ------------------------------------------------------------------ segments


def segments(indexed: DataFrame) -> DataFrame:
    """``arbor_id, seg_id, pos, nid``: runs from a root or fork to the next fork or leaf, both included.

    Segments are numbered first in, first out, those of one fork by ascending key; a tree of one
    node has none.
    """
    body = indexed.where("seg_id is not null").select("arbor_id", "seg_id", F.col("seg_pos").alias("pos"), "nid")
    first = indexed.where("seg_pos = 1").select("arbor_id", "seg_id", F.lit(0).alias("pos"), F.col("pid").alias("nid"))
    return body.union(first)


def topological_copy(indexed: DataFrame) -> DataFrame:
    """The tree with chains contracted: ``arbor_id, nid, pid, length``, one row per kept node.

    Kept are the root and each segment's last node; ``length`` counts the edges contracted.
    """
    last = indexed.where("seg_id is not null").groupBy("arbor_id", "seg_id").agg(F.max_by("nid", "seg_pos").alias("nid"), F.max("seg_pos").alias("length"))
    first = indexed.where("seg_pos = 1").select("arbor_id", "seg_id", "pid")
    ends = last.join(first, ["arbor_id", "seg_id"]).select("arbor_id", "nid", "pid", "length")
    roots = indexed.where(is_root()).select("arbor_id", "nid", "pid", F.lit(0).alias("length"))
    return ends.union(roots)


def regularness(indexed: DataFrame, far: float = 2.0) -> DataFrame:
    """Per arbor: edges, mean and deviation of their lengths, and edges over ``far`` deviations above."""
    up = indexed.select("arbor_id", F.col("nid").alias("pid"), *[F.col(c).alias("p" + c) for c in "xyz"])
    d = F.sqrt(sum((F.col(c) - F.col("p" + c)) * (F.col(c) - F.col("p" + c)) for c in "xyz"))
    edges = indexed.where("pid is not null").join(up, ["arbor_id", "pid"]).select("arbor_id", d.alias("d"))
    stats = edges.groupBy("arbor_id").agg(F.count(F.lit(1)).alias("edges"), F.avg("d").alias("mean"), F.stddev_pop("d").alias("deviation"))
    out = edges.join(stats, "arbor_id").groupBy("arbor_id").agg(
        F.first("edges").alias("edges"), F.first("mean").alias("mean"), F.first("deviation").alias("deviation"),
        F.count_if(F.col("d") > F.col("mean") + far * F.col("deviation")).alias("outliers"),
    )
    return out


# ------------------------------------------------------------------ editing


def minimal_subtree(indexed: DataFrame, ids: DataFrame) -> DataFrame:
    """``arbor_id, nid`` of the smallest connected subtree that holds ``ids(arbor_id, nid)``.

    All of them must be in the tree.  Kept are the ancestors of the ids from their lowest common one.
    """
    wanted = ids.select("arbor_id", "nid").distinct()
    up = ancestors(indexed, wanted)
    hits = up.groupBy("arbor_id", "anc").agg(F.count(F.lit(1)).alias("n"))
    deep = hits.join(indexed.select("arbor_id", F.col("nid").alias("anc"), "depth"), ["arbor_id", "anc"])
    all_ = wanted.groupBy("arbor_id").agg(F.count(F.lit(1)).alias("all_"))
    deep = deep.join(all_, "arbor_id")
    meet = deep.where("n = all_").groupBy("arbor_id").agg(F.max("depth").alias("least"))
    return deep.join(meet, "arbor_id").where("depth >= least").select("arbor_id", F.col("anc").alias("nid"))


def delete_branch(indexed: DataFrame, cuts: DataFrame) -> DataFrame:
    """What stays of the tree on the side of ``a`` when the edge to ``b`` is cut; ``cuts(arbor_id, a, b)``.

    With ``b`` below ``a`` the subtree of ``b`` goes; with ``b`` the parent of ``a`` only the subtree of
    ``a`` stays, and ``a`` becomes a root.  Arbors that are not in ``cuts`` are left out.
    """
    spot = lambda c: indexed.select("arbor_id", F.col("nid").alias(c), F.col("dfs").alias(c + "_lo"), (F.col("dfs") + F.col("size")).alias(c + "_hi"))
    c = cuts.select("arbor_id", "a", "b").join(spot("a"), ["arbor_id", "a"]).join(spot("b"), ["arbor_id", "b"])
    both = indexed.select("arbor_id", "nid", "pid", "x", "y", "z", "dfs").join(c, "arbor_id")
    upward = "a_lo > b_lo and a_lo < b_hi"
    side = F.when(F.expr(upward), F.expr("dfs >= a_lo and dfs < a_hi")).otherwise(~F.expr("dfs >= b_lo and dfs < b_hi"))
    pid = F.when(F.expr(upward) & (F.col("nid") == F.col("a")), None).otherwise(F.col("pid"))
    return both.where(side).select("arbor_id", "nid", pid.alias("pid"), "x", "y", "z")


def split(indexed: DataFrame, parts: DataFrame) -> DataFrame:
    """Cuts a segment out: ``parts(arbor_id, first, second, last)`` name its two first nodes and its last.

    ``arbor_id, part, nid``: ``upper`` is the tree without the subtree of ``second``, ``lower`` the
    subtree of ``last``; what lies between is in neither.
    """
    spot = lambda c: indexed.select("arbor_id", F.col("nid").alias(c), F.col("dfs").alias(c + "_lo"), (F.col("dfs") + F.col("size")).alias(c + "_hi"))
    c = parts.select("arbor_id", "second", "last").join(spot("second"), ["arbor_id", "second"]).join(spot("last"), ["arbor_id", "last"])
    both = indexed.select("arbor_id", "nid", "dfs").join(c, "arbor_id")
    part = F.when(F.expr("dfs >= last_lo and dfs < last_hi"), "lower").when(F.expr("not (dfs >= second_lo and dfs < second_hi)"), "upper")
    return both.select("arbor_id", part.alias("part"), "nid").where("part is not null")


def filter_by_order(indexed: DataFrame, least: int = 0, most: int = 10_000) -> DataFrame:
    """Nodes whose Strahler number is in [least, most], rebuilt: the largest connected piece stays."""
    return index(indexed.where(F.col("order_no").between(least, most)))


def filter_by_bounds(nodes: DataFrame, lo: tuple, hi: tuple) -> tuple[DataFrame, DataFrame]:
    """Nodes with lo <= centre < hi on each axis, rebuilt; and per arbor how many were outside."""
    inside = F.lit(True)
    for c, a, b in zip("xyz", lo, hi, strict=True):
        inside &= (F.col(c) >= a) & (F.col(c) < b)
    outside = nodes.groupBy("arbor_id").agg(F.count_if(~inside).alias("dropped"))
    return index(nodes.where(inside)), outside


def rerooted(indexed: DataFrame, roots: DataFrame) -> DataFrame:
    """The trees hung up at ``roots(arbor_id, nid)``: edges on the way to the old root turn round."""
    up = ancestors(indexed, roots).select("arbor_id", F.col("nid").alias("new_root"), F.col("anc").alias("nid"), "dist")
    below = up.select("arbor_id", F.col("nid").alias("below"), (F.col("dist") + 1).alias("dist"))
    turned = up.join(below, ["arbor_id", "dist"], "left").select("arbor_id", "nid", "below", F.lit(True).alias("turn"))
    pid = F.when(F.col("turn"), F.col("below")).otherwise(F.col("pid"))
    keys = roots.select("arbor_id").distinct()
    return indexed.join(keys, "arbor_id", "left_semi").join(turned, ["arbor_id", "nid"], "left").select("arbor_id", "nid", pid.alias("pid"), "x", "y", "z")


def reindexed(indexed: DataFrame) -> DataFrame:
    """Node ids replaced by pre-order places."""
    up = indexed.select("arbor_id", F.col("nid").alias("pid"), F.col("dfs").alias("p"))
    return indexed.join(up, ["arbor_id", "pid"], "left").select("arbor_id", F.col("dfs").alias("nid"), F.col("p").alias("pid"), "x", "y", "z")


def merged(a: DataFrame, b: DataFrame, edges: DataFrame) -> DataFrame:
    """Trees of ``b`` joined to those of ``a`` of equal ``arbor_id`` by ``edges(arbor_id, a_nid, b_root)``.

    Ids of the two must be distinct; the root of ``b`` gets ``a_nid`` as its parent.
    """
    cols = ["arbor_id", "nid", "pid", "x", "y", "z"]
    hung = b.join(edges.select("arbor_id", F.col("b_root").alias("nid"), "a_nid"), ["arbor_id", "nid"], "left")
    return a.select(*cols).union(hung.select("arbor_id", "nid", F.coalesce("a_nid", "pid").alias("pid"), "x", "y", "z"))


def order_from(target: DataFrame, other: DataFrame, near: float = 1e-5) -> DataFrame:
    """Strahler numbers taken over from ``other`` where segments match: ``arbor_id, nid, order_no``.

    Both are indexed.  A segment matches when its heads or its tails are within ``near`` on each
    axis; segments are matched one to one, each in its order with the first of the other that is free.
    The tail's number goes to all nodes but the head, which gets the head's.
    """

    def ends(t: DataFrame, mark: str) -> DataFrame:
        s = segments(t).join(t.select("arbor_id", "nid", "x", "y", "z", "order_no"), ["arbor_id", "nid"])
        place = F.struct("nid", "x", "y", "z", "order_no")
        return s.groupBy("arbor_id", F.col("seg_id").alias(f"{mark}_id")).agg(F.min_by(place, "pos").alias(f"{mark}_head"), F.max_by(place, "pos").alias(f"{mark}_tail"))

    a, b = ends(target, "a"), ends(other, "b")
    close = lambda e: (F.abs(F.col(f"a_{e}.x") - F.col(f"b_{e}.x")) < near) & (F.abs(F.col(f"a_{e}.y") - F.col(f"b_{e}.y")) < near) & (F.abs(F.col(f"a_{e}.z") - F.col(f"b_{e}.z")) < near)
    cell = lambda m, e: F.struct(*[F.floor(F.col(f"{m}_{e}.{c}") / (4 * near)).alias(c) for c in "xyz"])
    found = None
    for e in ("head", "tail"):
        shifts = F.explode(F.transform(F.sequence(F.lit(0), F.lit(26)), lambda i: F.struct((i % 3 - 1).alias("x"), (F.floor(i / 3) % 3 - 1).alias("y"), (F.floor(i / 9) - 1).alias("z"))))
        wide = a.withColumn("s", shifts).withColumn("cell", F.struct(*[(cell("a", e)[c] + F.col("s")[c]).cast("bigint").alias(c) for c in "xyz"])).drop("s")
        pairs = wide.join(b.withColumn("cell", cell("b", e)), ["arbor_id", "cell"]).where(close(e))
        pairs = pairs.select("arbor_id", "a_id", "b_id", F.col("b_head.order_no").alias("h"), F.col("b_tail.order_no").alias("t"))
        found = pairs if found is None else found.union(pairs)
    found = found.distinct()

    def greedy(t: pa.Table) -> pa.Table:
        keep, used = [], set()
        arbor, aid, bid = (t.column(c).to_pylist() for c in ("arbor_id", "a_id", "b_id"))
        for i, (g, x, y) in enumerate(zip(arbor, aid, bid, strict=True)):
            if (g, "a", x) not in used and (g, "b", y) not in used:
                used |= {(g, "a", x), (g, "b", y)}
                keep.append(i)
        return t.take(pa.array(keep, pa.int64()))

    match = by_arbor(found, greedy, "arbor_id bigint, a_id bigint, b_id bigint, h int, t int", order=("a_id", "b_id"))
    body = segments(target).join(match.withColumnRenamed("a_id", "seg_id"), ["arbor_id", "seg_id"])
    named = body.select("arbor_id", "nid", F.when(F.col("pos") == 0, F.col("h")).otherwise(F.col("t")).alias("order_no"), "seg_id", "pos")
    # a fork is the tail of one segment and the head of others; the last to be matched has the say
    return named.groupBy("arbor_id", "nid").agg(F.max_by("order_no", F.struct("seg_id", -F.col("pos"))).alias("order_no"))
