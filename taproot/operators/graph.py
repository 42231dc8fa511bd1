"""Connected components of scored graphs, and segmentation by fragments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taproot.operators import batched
from taproot.operators.lineage import cut, stored

BOX = tuple(f"{m}_{a}" for m in ("lo", "hi") for a in "xyz")
#: Pairs of a region and a voxel of its cell that are tried at once, and rows of regions that are labelled at once.
PAIRS, REGIONS = 1 << 20, 2000


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by a hash of another kind than a join on ``key`` uses, so that the join shuffles both
    sides and Spark may split the partitions of a frequent key."""
    return df.repartition(F.xxhash64(key, F.lit(1)))


def connected_components(edges: DataFrame, threshold: float | None = None, rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``edges(u, v, score)`` whose score is at most ``threshold``.

    A component is named by its least node.  Each round lets all neighbours of a node point at the
    least of them, first the greater ones and then the rest (large-star and small-star), which ends
    after about the logarithm of the longest path; lineage is cut every round.  Nodes whose edges are
    all above the threshold are components of their own.
    """
    nodes = edges.select(F.col("u").alias("node")).union(edges.select(F.col("v").alias("node"))).distinct()
    near = edges if threshold is None else edges.where(F.col("score") <= threshold)
    e = cut(near.where("u <> v").select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).distinct())
    state = None
    for _ in range(rounds):
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
        ways = e.union(e.select("lo", "hi"))
        least = ways.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
        large = ways.where("lo > hi").join(spread(least, "hi"), "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(spread(lowest, "hi"), "hi").select(F.explode(F.array("hi", "lo")).alias("hi"), F.col("m").alias("lo"))
        e = cut(small.where("hi <> lo").distinct())
    else:
        raise RuntimeError("components did not settle")
    named = e.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component"))
    return nodes.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def local_segmentation(regions: DataFrame, fragments: DataFrame, edges: DataFrame, threshold: float, cell: int = 16) -> DataFrame:
    """Fragments of every region relabelled by components: ``roi_id, x, y, z, label``, a row for each voxel of each region.

    See ``segmented``; nothing but its result is made into rows.
    """
    each = segmented(regions, fragments, edges, threshold, cell).select("roi_id", *BOX, F.explode(F.arrays_zip("at", "labels")).alias("v"))
    return each.select("roi_id", *[p.alias(a) for a, p in zip("xyz", spots("v.at"), strict=True)], F.col("v.labels").alias("label"))


def spots(at: str) -> list[Column]:
    """``x, y, z`` of the place ``at`` of a box's voxel."""
    y, z = (f"(hi_{a} - lo_{a})" for a in "yz")
    return [F.expr(f"lo_x + {at} div ({y} * {z})"), F.expr(f"lo_y + {at} div {z} % {y}"), F.expr(f"lo_z + {at} % {z}")]


def segmented(regions: DataFrame, fragments: DataFrame, edges: DataFrame, threshold: float, cell: int = 16) -> DataFrame:
    """``regions`` with ``at`` and ``labels``, arrays over their voxels that have a fragment; regions without any have no row.

    ``regions`` has ``roi_id``, half-open voxel boxes ``lo_x .. hi_z`` and any other columns; ``fragments`` ``x, y, z, frag_id``;
    ``edges`` ``u, v, score``.  ``at`` is a voxel's place in its box in C order.  Only edges both of whose fragments lie in
    the region count there.  Labels are the least fragment id of the component, so fragments outside the graph keep
    their own and cannot clash with another's.

    Labels follow from the box, so each box is worked on once, however many regions share it, and its voxels are
    shuffled and written as arrays.  A region's voxels and edges are held at once, never a table's.
    """
    inside = stored(boxed(regions.select(*BOX).distinct(), fragments, cell).withColumn("box", F.monotonically_increasing_id()))
    near = edges.where(F.col("score") <= threshold).select(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v"))
    ends = inside.select("box", F.explode("frags").alias("u")).join(near, "u").select("box", "u", "v")
    none = lambda kind: F.lit(None).cast(kind)
    rows = inside.select("box", F.lit(0).alias("kind"), none("bigint").alias("u"), none("bigint").alias("v"), "frags", "which")
    rows = rows.union(ends.select("box", F.lit(1), "u", "v", none("array<bigint>"), none("binary")))
    labels = batched.together(rows, "box", within=("kind",)).mapInArrow(_labelled, "box bigint, labels array<bigint>")
    return regions.join(inside.drop("frags", "which").join(labels, "box").drop("box"), list(BOX))


def boxed(boxes: DataFrame, points: DataFrame, cell: int) -> DataFrame:
    """``lo_x .. hi_z, at, frags, which`` of every box that holds some of ``points(x, y, z, frag_id)``: the places of its
    voxels, its fragments ascending, and for each voxel which of them it has, as packed 32-bit numbers.

    Boxes meet points in the cells of side ``cell`` that they touch; cells about as large as the boxes serve best.  Points
    without a fragment are left out.
    """
    r = boxes
    for a in "xyz":
        lo, hi = F.floor(F.col(f"lo_{a}") / cell), F.floor((F.col(f"hi_{a}") - 1) / cell)
        r = r.withColumn("c" + a, F.explode(F.sequence(lo, hi)))
    cells, none = ["cx", "cy", "cz"], F.lit(None).cast("bigint")
    p = points.select(*[F.col(a).cast("bigint").alias(a) for a in "xyz"], F.col("frag_id").cast("bigint").alias("frag_id")).dropna()
    p = p.select(*[F.floor(F.col(a) / cell).alias("c" + a) for a in "xyz"], F.lit(0).alias("kind"), "x", "y", "z", "frag_id", *[none.alias(b) for b in BOX])
    both = p.union(r.select(*cells, F.lit(1), *[none] * 4, *BOX))
    parts = batched.together(both, *cells, within=("kind",)).mapInArrow(_met, ", ".join([*[f"{b} bigint" for b in BOX], "at array<bigint>", "frags array<bigint>"]))
    return batched.together(parts, *BOX).mapInArrow(_packed, ", ".join([*[f"{b} bigint" for b in BOX], "at array<bigint>", "frags array<bigint>", "which binary"]))


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(values, pa.int64()))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of cells' points (``kind`` 0) and boxes (1), the points of each box in its cell."""
    for t, begin, group in batched.groups(batches, ("cx", "cy", "cz"), 64):
        kind = t.column("kind").to_numpy()
        points, boxes = t.filter(pa.array(kind == 0)), t.filter(pa.array(kind == 1))
        many = np.bincount(group[kind == 0], minlength=len(begin))
        first, own = np.cumsum(many) - many, group[kind == 1]
        place = [points.column(a).to_numpy() for a in "xyz"]
        frag = points.column("frag_id").to_numpy()
        ends = np.cumsum(many[own])
        low = 0
        while low < len(own):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PAIRS, "right")))
            some = boxes.slice(low, high - low)
            n = many[own[low:high]]
            box = np.repeat(np.arange(high - low), n)
            spot = np.repeat(first[own[low:high]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            lo, hi = ([some.column(f"{m}_{a}").to_numpy() for a in "xyz"] for m in ("lo", "hi"))
            fit = np.ones(len(box), bool)
            for c, a, b in zip(place, lo, hi, strict=True):
                fit &= (c[spot] >= a[box]) & (c[spot] < b[box])
            box, spot = box[fit], spot[fit]
            at = np.zeros(len(box), np.int64)
            for c, a, b in zip(place, lo, hi, strict=True):
                at = at * (b - a)[box] + c[spot] - a[box]
            counts = np.bincount(box, minlength=high - low)
            there = pa.array(np.flatnonzero(counts))
            counts = counts[counts > 0]
            out = some.select(BOX).take(there).append_column("at", _lists(at, counts)).append_column("frags", _lists(frag[spot], counts))
            yield from out.to_batches(max_chunksize=REGIONS)
            low = high


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of each box as one row, its fragments named once."""
    for t, begin, group in batched.groups(batches, BOX, REGIONS):
        at, frag = (t.column(c).combine_chunks() for c in ("at", "frags"))
        box = np.repeat(group, at.value_lengths().to_numpy())
        at, frag = at.flatten().to_numpy(), frag.flatten().to_numpy()
        order = np.lexsort((frag, box))
        new = np.ones(len(order), bool)
        new[1:] = (box[order][1:] != box[order][:-1]) | (frag[order][1:] != frag[order][:-1])
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        kinds = np.bincount(box[order][new], minlength=len(begin))
        which -= (np.cumsum(kinds) - kinds)[box]
        names = [t.column(b).combine_chunks().take(pa.array(begin)) for b in BOX]
        voxels = np.bincount(box, minlength=len(begin))
        cols = [*names, _lists(at, voxels), _lists(frag[order][new], kinds), batched.binaries(which.astype(np.int32), voxels)]
        yield from pa.Table.from_arrays(cols, names=[*BOX, "at", "frags", "which"]).to_batches(max_chunksize=REGIONS)


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of boxes (``kind`` 0) and the edges of their fragments (1), the label of each voxel of each box."""
    for t, begin, group in batched.groups(batches, ("box",), REGIONS):
        kind = t.column("kind").to_numpy()
        boxes, edges, own = t.filter(pa.array(kind == 0)), t.filter(pa.array(kind == 1)), group[kind == 1]
        frags = boxes.column("frags").combine_chunks()
        kinds, frags = frags.value_lengths().to_numpy(), frags.flatten().to_numpy()
        first = np.cumsum(kinds) - kinds
        # a box's fragment by one number: the box, then the rank of the id among all
        ids = np.unique(frags)
        codes = np.repeat(np.arange(len(kinds)), kinds) * len(ids) + np.searchsorted(ids, frags)

        def found(c: str) -> tuple[np.ndarray, np.ndarray]:
            v = edges.column(c).to_numpy()  # noqa: B023
            rank = np.minimum(np.searchsorted(ids, v), len(ids) - 1)  # noqa: B023
            code = own * len(ids) + rank  # noqa: B023
            at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)  # noqa: B023
            return at, (ids[rank] == v) & (codes[at] == code)  # noqa: B023

        (u, has_u), (v, has_v) = found("u"), found("v")
        label = _least(len(frags), u[has_u & has_v], v[has_u & has_v])
        which, counts = batched.values_of(boxes.column("which"), "i4")
        out = frags[label][np.repeat(first, counts) + which]
        cols = [boxes.column("box").combine_chunks(), _lists(out, counts)]
        yield from pa.Table.from_arrays(cols, names=["box", "labels"]).to_batches(max_chunksize=REGIONS)


def _least(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node of each node's component."""
    label = np.arange(n)
    while True:
        old = label.copy()
        low = np.minimum(label[u], label[v])
        for end in (u, v):
            np.minimum.at(label, old[end], low)
            np.minimum.at(label, end, low)
        label = label[label]
        if (label == old).all():
            return label


def center_object(regions: DataFrame, fragments: DataFrame, edges: DataFrame, threshold: float, cell: int = 16) -> DataFrame:
    """``regions`` without their boxes, with ``i, j, k, v``: 1 where a voxel of the region is of the component of the region's middle.

    Regions whose middle has no fragment yield nothing.
    """
    half = [f"((hi_{a} - lo_{a}) div 2)" for a in "xyz"]
    middle = f"({half[0]} * (hi_y - lo_y) + {half[1]}) * (hi_z - lo_z) + {half[2]}"
    found = segmented(regions, fragments, edges, threshold, cell).withColumn("core", F.expr(f"get(labels, cast(array_position(at, {middle}) as int) - 1)"))
    each = found.where("core is not null").withColumn("voxel", F.explode(F.arrays_zip("at", "labels")))
    places = [(p - F.col(f"lo_{a}")).cast("int").alias(c) for a, c, p in zip("xyz", "ijk", spots("voxel.at"), strict=True)]
    return each.select(*[c for c in regions.columns if c not in BOX], *places, (F.col("voxel.labels") == F.col("core")).cast("tinyint").alias("v"))
