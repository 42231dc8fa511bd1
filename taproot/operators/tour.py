"""The tree index for trees that are larger than a task: an Euler tour, ranked by pointer doubling.

``index`` gives what ``topology.index`` gives, without ever holding a tree in one place.  Each node is entered and
left once; these arcs are a linked list, and doubling its pointers gives every arc's rank in about
log2(2 n) joins.  Arcs of ``NEAR`` successive ids are followed as far as they go in one task before, so that only ways
out of them are left to joins.  Places, sizes and depths are differences of ranks.  With places, all else are running sums
over them: they are taken in stretches of ``STRETCH`` places and then over the stretches' totals.  Arcs and nodes pack well,
so that their written tables look small; joins shuffle both sides, and none passes whole through the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taproot.operators.arrow import by_arbor
from taproot.operators.joins import shuffled
from taproot.operators.lineage import stored

STRETCH = 1 << 16
#: Ids of an arbor whose arcs are followed in one task before pointers are doubled.
NEAR = 1 << 14
NODE = ["arbor_id", "nid"]


def linked(nodes: DataFrame) -> DataFrame:
    """``arbor_id, nid, pid, first_child, sibling``: ``pid`` null for roots, ``sibling`` the next greater one."""
    known = nodes.select("arbor_id", F.col("nid").alias("pid"), F.lit(True).alias("there"))
    up = nodes.select("arbor_id", "nid", F.when(F.col("pid") != F.col("nid"), F.col("pid")).alias("pid")).join(shuffled(known), ["arbor_id", "pid"], "left")
    up = up.select("arbor_id", "nid", F.when(F.col("there"), F.col("pid")).alias("pid"))
    first = up.where("pid is not null").groupBy("arbor_id", F.col("pid").alias("nid")).agg(F.min("nid").alias("first_child"), F.count(F.lit(1)).alias("n_children"))
    later = F.when(F.col("pid").isNotNull(), F.lead("nid").over(Window.partitionBy("arbor_id", "pid").orderBy("nid")))
    # roots have no siblings and may be very many, so they pass by the window
    sib = up.where("pid is not null").withColumn("sibling", later).union(up.where("pid is null").withColumn("sibling", F.lit(None).cast("bigint")))
    return sib.join(shuffled(first), NODE, "left").select("arbor_id", "nid", "pid", "first_child", "sibling", F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"))


def _followed(t: pa.Table) -> pa.Table:
    """Both arcs of each node, followed to the first that is of another arbor or part, or to the end."""
    arbor, part, nid = (t.column(c).to_numpy() for c in ("arbor_id", "part", "nid"))
    n = len(nid)
    new = np.r_[True, (arbor[1:] != arbor[:-1]) | (part[1:] != part[:-1])]
    group = np.cumsum(new) - 1
    ids = np.unique(nid)
    codes = group * len(ids) + np.searchsorted(ids, nid)  # ascending, as rows are

    def ref(c: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, whether there is one, and its row in the group or -1."""
        there = ~np.asarray(t.column(c).is_null())
        v = t.column(c).combine_chunks().fill_null(0).to_numpy()
        rank = np.minimum(np.searchsorted(ids, v), len(ids) - 1)
        at = np.minimum(np.searchsorted(codes, group * len(ids) + rank), n - 1)
        return v, there, np.where(there & (nid[at] == v) & (group[at] == group), at, -1)

    (child, has_child, child_at), (sib, has_sib, sib_at), (pid, has_pid, pid_at) = map(ref, ("first_child", "sibling", "pid"))
    # arcs 0 .. n enter, n .. 2 n leave; ``to`` is the next arc's place, -1 where it is not here
    own = np.arange(n)
    name = np.r_[np.where(has_child, child, nid), np.where(has_sib, sib, pid)]
    leaves = np.r_[~has_child, ~has_sib]
    on = np.r_[np.ones(n, bool), has_sib | has_pid]
    to = np.r_[np.where(has_child, child_at, own + n), np.where(has_sib, sib_at, np.where(has_pid & (pid_at >= 0), pid_at + n, -1))]
    steps, deep, last = np.r_[np.ones(n, np.int64), np.zeros(n, np.int64)], np.repeat([1, -1], n).astype(np.int64), np.r_[nid, nid]
    for _ in range(int(2 * n).bit_length()):
        go = np.flatnonzero(to >= 0)
        if not len(go):
            break
        then = to[go]
        steps[go], deep[go] = steps[go] + steps[then], deep[go] + deep[then]
        name[go], leaves[go], on[go], last[go], to[go] = name[then], leaves[then], on[then], last[then], to[then]
    whole = pa.StructArray.from_arrays([pa.array(name, pa.int64()), pa.array(leaves)], names=["nid", "out"], mask=pa.array(~on))
    cols = [np.r_[arbor, arbor], np.r_[nid, nid], np.repeat([False, True], n), whole, steps, deep, last]
    return pa.Table.from_arrays([pa.array(c) for c in cols], names=["arbor_id", "nid", "out", "next", "n", "d", "last"])


def ranked(links: DataFrame) -> DataFrame:
    """``arbor_id, nid, root_nid, dfs, size, depth`` of every node that a root reaches.

    An arc is a node and whether it is left; entering counts 1 and goes one deeper.  A round joins the arcs that
    have a successor with all arcs, adds up and takes the successor's successor; arcs on cycles never come to an
    end and go when the others have.
    """
    near = links.withColumn("part", F.floor(F.col("nid") / NEAR)).select("arbor_id", "part", "nid", "pid", "first_child", "sibling")
    arcs = by_arbor(near.withColumn("group", F.xxhash64("arbor_id", "part")), _followed, "arbor_id bigint, nid bigint, out boolean, next struct<nid: bigint, out: boolean>, n bigint, d bigint, last bigint", "group", ("arbor_id", "part", "nid"))
    state, left = stored(arcs), None
    while (open_ := state.where("next is not null").count()) not in (0, left):
        active, left = state.where("next is not null"), open_
        there = state.select("arbor_id", F.struct("nid", "out").alias("next"), F.col("next").alias("then"), F.col("n").alias("n2"), F.col("d").alias("d2"), F.col("last").alias("last2"))
        on = active.join(shuffled(there), ["arbor_id", "next"])
        moved = on.select("arbor_id", "nid", "out", F.col("then").alias("next"), (F.col("n") + F.col("n2")).alias("n"), (F.col("d") + F.col("d2")).alias("d"), F.col("last2").alias("last"))
        state = stored(moved.union(state.where("next is null")))
    ranks = state.where("next is null")
    enters = ranks.where("not out").select("arbor_id", "nid", F.col("last").alias("root_nid"), F.col("n").alias("n_in"), (-F.col("d")).alias("depth"))
    leaves = ranks.where("out").select("arbor_id", "nid", F.col("n").alias("n_out"))
    both = stored(enters.join(shuffled(leaves), NODE))
    whole = both.where("nid = root_nid").select("arbor_id", "root_nid", F.col("n_in").alias("total"))
    # of an arbor's trees the one of most nodes stays, of equal ones that of the least root
    best = whole.groupBy("arbor_id").agg(F.max(F.struct("total", (-F.col("root_nid")).alias("r"))).alias("b"))
    kept = best.select("arbor_id", (-F.col("b.r")).alias("root_nid"), F.col("b.total").alias("total"))
    return both.join(shuffled(kept), ["arbor_id", "root_nid"]).select("arbor_id", "nid", "root_nid", (F.col("total") - F.col("n_in")).alias("dfs"), (F.col("n_in") - F.col("n_out")).alias("size"), "depth")


def running(events: DataFrame, value: Column, latest: bool = False) -> DataFrame:
    """``events(arbor_id, place, ..)`` with ``sum``: ``value`` added up over all places to this one, or with ``latest`` the greatest.

    Every place has one row.
    """
    gather = F.max if latest else F.sum
    e = events.withColumn("value", value).withColumn("stretch", F.floor(F.col("place") / STRETCH))
    inside = gather("value").over(Window.partitionBy("arbor_id", "stretch").orderBy("place"))
    totals = e.groupBy("arbor_id", "stretch").agg(gather("value").alias("part"))
    before = gather("part").over(Window.partitionBy("arbor_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("arbor_id", "stretch", before.alias("before"))
    both = e.withColumn("here", inside).join(shuffled(totals), ["arbor_id", "stretch"])
    joined = F.greatest("here", "before") if latest else F.col("here") + F.coalesce("before", F.lit(0))
    return both.select(*events.columns, joined.alias("sum"))


def numbered(df: DataFrame, group: str, *keys: Column) -> DataFrame:
    """``df`` with ``number``: each row's place in its group by ``keys``, from 0, however large the group.

    Rows are sorted by ranges; what comes back to the driver is one count a partition.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = df.select("*", *[k.alias(f"key{i}") for i, k in enumerate(keys)])
    order = [group, *[f"key{i}" for i in range(len(keys))]]
    dealt = named.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = stored(dealt.withColumn("spot", F.monotonically_increasing_id()))
    part, within = F.shiftright("spot", 33), F.col("spot").bitwiseAND((1 << 33) - 1)
    counts = dealt.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()
    total, pairs = 0, []
    for r in counts:
        pairs += [F.lit(r["p"]).cast("bigint"), F.lit(total).cast("bigint")]
        total += r["n"]
    if not pairs:
        return df.withColumn("number", F.lit(0).cast("bigint"))
    spot = dealt.withColumn("spot", F.create_map(*pairs)[part] + within)
    first = spot.groupBy(group).agg(F.min("spot").alias("first"))
    return spot.join(shuffled(first), group).select(*df.columns, (F.col("spot") - F.col("first")).alias("number"))


def strahler(tree: DataFrame) -> DataFrame:
    """``arbor_id, nid, order_no`` from ``arbor_id, nid, pid, dfs, size``.

    A node is of order k + 1 or more where some node of its subtree has two children of order k or more.  A round
    finds these nodes, counts them over places and keeps whoever has one in its span; there are as many rounds as
    the greatest order, which is at most the logarithm of the leaves.
    """
    at = stored(tree.select("arbor_id", "nid", "pid", F.col("dfs").alias("place"), "size"))
    alive, found, k = at.select(*NODE, "pid"), at.select(*NODE, F.lit(1).alias("order_no")), 1
    while True:
        forks = alive.where("pid is not null").groupBy("arbor_id", F.col("pid").alias("nid")).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(*NODE, F.lit(1).alias("fork"))
        sums = stored(running(at.join(shuffled(forks), NODE, "left"), F.coalesce("fork", F.lit(0))))
        last = sums.select("arbor_id", (F.col("place") + 1).alias("end"), F.col("sum").alias("upto"))
        spans = sums.withColumn("end", F.col("place") + F.col("size")).join(shuffled(last), ["arbor_id", "end"])
        # forks up to the end of the span, less those before it
        alive = stored(spans.where(F.col("upto") - F.col("sum") + F.coalesce("fork", F.lit(0)) > 0).select(*NODE, "pid"))
        if alive.isEmpty():
            break
        k += 1
        found = found.union(alive.select(*NODE, F.lit(k)))
    return found.groupBy(*NODE).agg(F.max("order_no").alias("order_no"))


def index(nodes: DataFrame) -> DataFrame:
    """What ``topology.index`` gives, row for row, for trees of any size.

    Ids of nodes are unique in an arbor.  Rounds are written to the shared folder, so a lost executor costs the round at hand.
    """
    links = stored(linked(nodes))
    tree = links.join(shuffled(ranked(links)), NODE)
    up = tree.select("arbor_id", F.col("nid").alias("pid"), F.col("depth").alias("up_depth"), F.col("n_children").alias("up_children"))
    tree = tree.join(shuffled(up), ["arbor_id", "pid"], "left")
    new = F.col("pid").isNotNull() & ((F.col("up_depth") == 0) | (F.col("up_children") > 1))
    tree = stored(tree.select("arbor_id", "nid", "pid", "root_nid", "dfs", "size", "depth", "n_children", new.alias("new")))

    begins = tree.where("new").select("arbor_id", F.col("dfs").alias("place"), F.lit(1).alias("w"))
    ends = tree.where("new").select("arbor_id", (F.col("dfs") + F.col("size")).alias("place"), F.lit(-1).alias("w"))
    steps = begins.union(ends).groupBy("arbor_id", "place").agg(F.sum("w").alias("w"))
    placed = tree.withColumn("place", F.col("dfs")).join(shuffled(steps), ["arbor_id", "place"], "left")
    nested = running(placed, F.coalesce("w", F.lit(0))).withColumnRenamed("sum", "open").drop("w")
    headed = stored(running(nested, F.when(F.col("new"), F.col("place")), latest=True).withColumnRenamed("sum", "head_at"))
    heads = headed.where("new").select("arbor_id", "place", F.col("nid").alias("seg_head"), F.col("depth").alias("head_depth"), (F.col("open") - 1).alias("seg_depth"))
    named = numbered(heads, "arbor_id", F.col("seg_depth"), F.col("place")).withColumnRenamed("number", "seg_id").withColumnRenamed("place", "head_at")
    whole = headed.withColumn("head_at", F.when(F.col("pid").isNotNull(), F.col("head_at"))).join(shuffled(named), ["arbor_id", "head_at"], "left")
    whole = whole.join(shuffled(strahler(tree)), NODE).join(shuffled(nodes.select(*NODE, "x", "y", "z")), NODE)
    out = numbered(whole, "arbor_id", F.col("depth"), -F.col("dfs"))
    return out.select(
        "arbor_id", "nid", "pid", "x", "y", "z", "depth", "dfs", "size", F.col("number").alias("bfs"), "n_children", F.col("order_no").cast("int").alias("order_no"),
        "seg_head", F.col("seg_depth").cast("bigint").alias("seg_depth"), "seg_id", (F.col("depth") - F.col("head_depth") + 1).cast("int").alias("seg_pos"), "root_nid",
    )
