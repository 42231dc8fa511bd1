"""Voxel accumulation about nodes, and the masks weighed by it.

A node's field of view is a box of voxels about the voxel that holds its centre.  Nodes are sent to the
blocks that their fields of view meet, masks as bits; sums, counts and minima are taken in arrays of a block
(``batched``).  Voxels that no node sees have no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taproot.operators import batched
from taproot.operators.joins import shuffled

AXES = ("x", "y", "z")
Triple = tuple[int, int, int]


@dataclass(frozen=True)
class View:
    """Voxel size and field of view in voxels (odd on each axis)."""

    voxel: Triple = (1, 1, 1)
    fov: Triple = (5, 5, 5)
    use_sphere: bool = True
    incr_denom: float = 1.0
    interpolate: int = 0

    def __post_init__(self):
        if any(n % 2 == 0 or n < 1 for n in self.fov) or any(v <= 0 for v in self.voxel):
            raise ValueError("a field of view is an odd number of voxels of positive size")

    @staticmethod
    def of(config) -> View:
        """From a ``Segmentation`` section."""
        config.validate_fov_shape()
        return View(config.voxel_resolution, config.fov_shape_voxels, config.use_sphere, config.incr_denom, config.interpolate_distance_nodes)

    @property
    def half(self) -> Triple:
        return tuple(n // 2 for n in self.fov)

    def squared(self, i: Column, j: Column, k: Column) -> Column:
        """Squared physical distance of a voxel offset, a whole number."""
        return sum((d * v) * (d * v) for d, v in zip((i, j, k), self.voxel, strict=True))

    def in_sphere(self, i: Column, j: Column, k: Column) -> Column:
        """Within the ball whose diameter is the shortest physical side; squares are compared."""
        side = min(n * v for n, v in zip(self.fov, self.voxel, strict=True))
        return 4 * self.squared(i, j, k) <= side * side

    def distance(self, i: Column, j: Column, k: Column) -> Column:
        """Distance from the middle, 1 at the corners."""
        corner = sum((h * v) ** 2 for h, v in zip(self.half, self.voxel, strict=True)) ** 0.5
        return F.sqrt(self.squared(i, j, k).cast("double")) / F.lit(corner or 1.0)

    def ball(self) -> tuple[np.ndarray, np.ndarray]:
        """``distance`` of each voxel of a field of view, and whether it is used, as arrays."""
        grid = np.stack(np.meshgrid(*[np.arange(n) - h for n, h in zip(self.fov, self.half, strict=True)], indexing="ij"), axis=-1)
        squares = ((grid * np.array(self.voxel)) ** 2).sum(axis=-1)
        corner = float(sum((h * v) ** 2 for h, v in zip(self.half, self.voxel, strict=True))) ** 0.5 or 1.0
        side = min(n * v for n, v in zip(self.fov, self.voxel, strict=True))
        inside = 4 * squares <= side * side if self.use_sphere else np.ones(self.fov, bool)
        return np.sqrt(squares.astype(float)) / corner, inside


def offsets(rows: DataFrame, view: View) -> DataFrame:
    """Every row once for each voxel of the field of view: ``i, j, k`` from 0 and ``di, dj, dk`` from the middle."""
    out = rows
    for name, n in zip("ijk", view.fov, strict=True):
        out = out.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return out.withColumns({f"d{name}": F.col(name) - h for name, h in zip("ijk", view.half, strict=True)})


def voxel_of(axis: str, size: int) -> Column:
    return F.floor(F.col(axis) / size).cast("bigint")


def fields(nodes: DataFrame, view: View) -> DataFrame:
    """``arbor_id, nid, i, j, k, di, dj, dk, vx, vy, vz`` of every node's field of view."""
    at = nodes.select("arbor_id", "nid", *[voxel_of(a, v).alias("c" + a) for a, v in zip(AXES, view.voxel, strict=True)])
    seen = offsets(at, view)
    return seen.select("arbor_id", "nid", "i", "j", "k", "di", "dj", "dk", *[(F.col("c" + a) + F.col("d" + d)).alias("v" + a) for a, d in zip(AXES, "ijk", strict=True)])


def region_of(nodes: DataFrame, view: View) -> DataFrame:
    """The physical box of each field of view, half-open: ``lo_x .. hi_z``."""
    sides = []
    for a, v, h in zip(AXES, view.voxel, view.half, strict=True):
        block = F.col(a) - F.pmod(F.col(a), F.lit(float(v)))
        sides += [(block - h * v).alias(f"lo_{a}"), (block + (h + 1) * v).alias(f"hi_{a}")]
    return nodes.select("arbor_id", "nid", *sides)


def to_voxels(boxes: DataFrame, voxel: Triple) -> DataFrame:
    """Physical boxes ``lo_x .. hi_z`` as voxel ranges; a box that is empty or off the grid raises."""
    out = {}
    for a, v in zip(AXES, voxel, strict=True):
        lo, hi = F.col(f"lo_{a}"), F.col(f"hi_{a}")
        fine = (lo < hi) & (F.pmod(lo, F.lit(v)) == 0) & (F.pmod(hi - lo, F.lit(v)) == 0)
        check = F.when(fine, True).otherwise(F.raise_error(F.lit(f"box is empty or off the grid on {a}")).cast("boolean"))
        out |= {f"lo_{a}": F.when(check, F.floor(lo / v).cast("bigint")), f"hi_{a}": F.when(check, F.floor(hi / v).cast("bigint"))}
    return boxes.withColumns(out)


def downsampled(masks: DataFrame, factor: Triple) -> DataFrame:
    """Full-resolution masks as field-of-view masks: a voxel is in when the mean of 255 * v is over 127.

    Absent voxels count as 0, so half a block counts as in.  A factor is of at most 2**55 voxels.
    """
    block = factor[0] * factor[1] * factor[2]
    # counts of 4 x 4 x 4 cells share the words of one group; a field holds a block of the greatest tinyint
    bits = block.bit_length() + 7
    per = 63 // bits
    cell = [F.floor(F.col(c) / f).cast("bigint") for c, f in zip("ijk", factor, strict=True)]
    spot = [F.pmod(c, F.lit(4)) for c in cell]
    rows = masks.select("arbor_id", "nid", *[F.floor(c / 4).cast("int").alias(x + "_") for c, x in zip(cell, "ijk", strict=True)], ((spot[0] * 4 + spot[1]) * 4 + spot[2]).cast("int").alias("c_"), F.coalesce(F.col("v").cast("bigint"), F.lit(0)).alias("v_"))
    words = [F.sum(F.expr(f"if(c_ div {per} = {w}, shiftleft(v_, c_ % {per} * {bits}), 0L)")).alias(f"w{w}") for w in range(-(-64 // per))]
    grouped = rows.groupBy("arbor_id", "nid", "i_", "j_", "k_").agg(F.bit_or(F.expr("shiftleft(1L, c_)")).alias("there"), F.sum("v_").alias("all_"), *words)
    whole = grouped.withColumn("words", F.array(*[f"w{w}" for w in range(len(words))]))
    whole = whole.withColumn("n_", F.expr(f"transform(sequence(0, 63), c -> shiftright(element_at(words, cast(c div {per} as int) + 1), c % {per} * {bits}) & {(1 << bits) - 1}L)"))
    held = F.aggregate("n_", F.lit(0).cast("bigint"), lambda s, n: s + n) == F.col("all_")
    whole = whole.withColumn("n_", F.when(held, F.col("n_")).otherwise(F.raise_error(F.lit("a mask has more in a block than its voxels hold")).cast("array<bigint>")))
    each = whole.select("arbor_id", "nid", "i_", "j_", "k_", "there", F.posexplode("n_").alias("c", "n")).where(F.expr("shiftright(there, c) & 1L = 1"))
    at = [(F.col(x + "_") * 4 + F.expr(e)).cast("int").alias(x) for x, e in zip("ijk", ("c div 16", "c div 4 % 4", "c % 4"), strict=True)]
    return each.select("arbor_id", "nid", *at, (255 * F.col("n") > 127 * block).cast("tinyint").alias("v"))


def filled(masks: DataFrame, new: DataFrame) -> DataFrame:
    """``masks`` with those of ``new`` nodes; a node that has a mask already raises."""
    twice = new.join(masks.select("arbor_id", "nid").distinct().withColumn("old_", F.lit(True)), ["arbor_id", "nid"], "left")
    kept = F.when(F.col("old_").isNull(), F.col("v")).otherwise(F.raise_error(F.format_string("node %d has a mask", F.col("nid"))).cast("tinyint"))
    cols = ["arbor_id", "nid", "i", "j", "k"]
    return masks.select(*cols, "v").union(twice.select(*cols, kept.cast("tinyint").alias("v")))


def is_filled(nodes: DataFrame, masks: DataFrame) -> DataFrame:
    return nodes.join(masks.select("arbor_id", "nid"), ["arbor_id", "nid"], "left_semi")


def between(nodes: DataFrame, n: int) -> DataFrame:
    """``n`` evenly spaced points on each edge: ``arbor_id, nid, x, y, z``, nid the child's."""
    up = nodes.select("arbor_id", F.col("nid").alias("pid"), *[F.col(a).alias("p" + a) for a in AXES])
    pairs = nodes.where("pid is not null").join(up, ["arbor_id", "pid"]).withColumn("s", F.explode(F.sequence(F.lit(1), F.lit(n))))
    points = [((F.col(a) * F.col("s") + F.col("p" + a) * (n + 1 - F.col("s"))) / (n + 1)).alias(a) for a in AXES]
    return pairs.select("arbor_id", "nid", *points)


def centers(nodes: DataFrame, view: View) -> DataFrame:
    """``arbor_id, nid, cx, cy, cz``: the voxel of each node."""
    return nodes.select("arbor_id", "nid", *[voxel_of(a, v).alias("c" + a) for a, v in zip(AXES, view.voxel, strict=True)])


def met(at: DataFrame, view: View, leaf: Triple) -> DataFrame:
    """Rows of ``centers`` with ``bx, by, bz``: once for every block that the field of view meets."""
    for a, n, h in zip(AXES, leaf, view.half, strict=True):
        at = at.withColumn("b" + a, F.explode(F.sequence(F.floor((F.col("c" + a) - h) / n).cast("bigint"), F.floor((F.col("c" + a) + h) / n).cast("bigint"))))
    return at


def crowded(seen: DataFrame, most: int) -> DataFrame:
    """Blocks that more than ``most`` nodes see, and among how many tasks each is shared: ``KEY, shares``."""
    sizes = seen.groupBy(*batched.KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    return sizes.select(*batched.KEY, F.ceil(F.col("n") / most).alias("shares"))


def dealt(rows: DataFrame, shares: DataFrame) -> DataFrame:
    """``rows`` of nodes with ``share``, 0 unless their block is crowded, and whether it is (``shared``)."""
    out = rows.join(F.broadcast(shares), list(batched.KEY), "left")
    return out.withColumns({"share": F.pmod(F.xxhash64("nid"), F.coalesce("shares", F.lit(1))), "shared": F.col("shares").isNotNull()}).drop("shares")


def accumulate(nodes: DataFrame, masks: DataFrame, view: View, most: int = batched.MOST) -> DataFrame:
    """``arbor_id, vx, vy, vz, seg_count, view_count, distance`` of every voxel in some field of view.

    ``seg_count`` sums masks, ``view_count`` counts all fields of view, mask or not, and ``distance`` is
    the least distance from a centre, null where only corners outside the ball saw the voxel.  Counts
    don't wrap.  With ``view.interpolate`` points between a node and its parent shorten distances too.
    """
    key = ["arbor_id", "vx", "vy", "vz"]

    def run(batches: Iterator[pa.RecordBatch], *more) -> Iterator[pa.RecordBatch]:
        yield from batched.voxel_sums(batches, *more)

    whole, split = _summed(nodes, masks, view, most, run, "arbor_id bigint, vx bigint, vy bigint, vz bigint, seg_count int, view_count int, distance double")
    if split is None:
        return whole
    # tasks that share a crowded block each give a part of its sums
    return whole.union(split.groupBy(*key).agg(F.sum("seg_count").cast("int").alias("seg_count"), F.sum("view_count").cast("int").alias("view_count"), F.min("distance").alias("distance")))


def live(nodes: DataFrame, masks: DataFrame, view: View, small: Triple, most: int = batched.MOST) -> DataFrame:
    """The voxels of ``accumulate`` that some mask holds, by blocks of ``small``: ``KEY, p, w``, places in C order and seg counts, packed.

    ``small`` parts the blocks in which sums are taken, that is ``batched.side(view.fov)``.  No voxel is a row, but those
    of crowded blocks; a block may occur again, none of its voxels does.
    """
    if any(n % m for n, m in zip(batched.side(view.fov), small, strict=True)):
        raise ValueError("blocks must part those in which sums are taken")

    def run(batches: Iterator[pa.RecordBatch], keys, view, leaf, far) -> Iterator[pa.RecordBatch]:
        yield from batched.live_sums(batches, keys, view, leaf, small, far)

    whole, split = _summed(nodes, masks, view, most, run, "arbor_id bigint, bx bigint, by bigint, bz bigint, p binary, w binary")
    if split is None:
        return whole

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            p, counts = batched.values_of(t.column("p"), "i4")
            row = np.repeat(np.arange(b.num_rows), counts)
            cols = [*[pa.array(t.column(k).to_numpy()[row]) for k in batched.KEY], pa.array(p), pa.array(batched.values_of(t.column("w"), "f8")[0])]
            yield from pa.Table.from_arrays(cols, names=[*batched.KEY, "p", "w"]).to_batches(max_chunksize=1 << 17)

    each = split.mapInArrow(unpacked, "arbor_id bigint, bx bigint, by bigint, bz bigint, p int, w double")
    return whole.union(batched.gathered(each.groupBy(*batched.KEY, "p").agg(F.sum("w").alias("w")), {"p": "i4", "w": "f8"}))


def _summed(nodes: DataFrame, masks: DataFrame, view: View, most: int, run, schema: str) -> tuple[DataFrame, DataFrame | None]:
    """``run`` over the blocks that nodes see, and over parts of crowded blocks, if there are any."""
    leaf, keys = batched.side(view.fov), (*batched.KEY, "share")
    at = centers(nodes, view)
    rows = at.join(shuffled(batched.packed(masks, view)), ["arbor_id", "nid"], "left").withColumn("n", F.lit(1))
    if view.interpolate:
        more = centers(between(nodes, view.interpolate), view)
        at, rows = at.union(more), rows.unionByName(more.withColumns({"bits": F.lit(None).cast("binary"), "n": F.lit(0)}))
    distance, used = view.ball()
    far = np.where(used, distance, np.inf)
    pieces = met(rows, view, leaf)

    def sums(some: DataFrame) -> DataFrame:
        part = some.select(*batched.KEY, "share", "cx", "cy", "cz", "bits", "n")
        return batched.together(part, *keys).mapInArrow(lambda batches: run(batches, keys, view, leaf, far), schema)

    shares = crowded(met(at, view, leaf), most)
    if shares.isEmpty():
        return sums(pieces.withColumn("share", F.lit(0).cast("bigint"))), None
    rows = dealt(pieces, shares)
    return sums(rows.where("not shared")), sums(rows.where("shared"))


def confidence(incr_denom: float) -> Column:
    """Share of views that hold the voxel, 0 where none counts; raises above 1 and where it is no number."""
    views = F.col("view_count") + F.lit(float(incr_denom))
    share = F.when(views == 0, 0.0).otherwise(F.col("seg_count") / F.nullif(views, F.lit(0.0)))
    return F.when((share > 1) | F.isnan(share), F.raise_error(F.lit("confidence above 1")).cast("double")).otherwise(share)


def answered(nodes: DataFrame, blocks: DataFrame, view: View, leaf: Triple, run, schema: str, most: int = batched.MOST) -> DataFrame:
    """``run`` over rows of blocks (``kind`` 0, the columns of ``blocks``) and of the nodes that see them (``kind`` 1), block by
    block.  Blocks go to the tasks that share them, nodes to one of them."""
    seen, keys = met(centers(nodes, view), view, leaf), list(batched.KEY)
    shares = crowded(seen, most)
    more = [c for c in blocks.columns if c not in keys]
    number = F.lit(None).cast("bigint")
    here = blocks.join(F.broadcast(shares), keys, "left").withColumn("share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("shares", F.lit(1)) - 1)))
    left = here.select(*keys, "share", F.lit(0).alias("kind"), number.alias("nid"), *[number.alias("c" + a) for a in AXES], *more)
    none = [F.lit(None).cast(blocks.schema[c].dataType).alias(c) for c in more]
    right = dealt(seen, shares).select(*keys, "share", F.lit(1).alias("kind"), "nid", *["c" + a for a in AXES], *none)
    return batched.together(left.union(right), *keys, "share", within=("kind",)).mapInArrow(run, schema)


def weighted(nodes: DataFrame, voxels: DataFrame, view: View) -> DataFrame:
    """Each node's field of view with the four masks: ``boolean``, ``distance``-weighted, ``view``-weighted
    and both, as ``arbor_id, nid, i, j, k, boolean, dist, viewed, dist_view``.

    Outside the ball, if one is used, all are 0.  A never-seen distance counts as 0.  Every voxel of a
    field of view has a row.
    """
    leaf, used = batched.side(view.fov), view.ball()[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched.field_rows(batched.answers(batches, view, leaf, used, batched.sparse), view)

    return answered(nodes, batched.by_block(voxels, leaf), view, leaf, run, "arbor_id bigint, nid bigint, i int, j int, k int, boolean boolean, dist double, viewed double, dist_view double")


def greatest(nodes: DataFrame, voxels: DataFrame, view: View, value: str = "dist_view") -> DataFrame:
    """``arbor_id, nid, v, place``: of each node's mask ``value`` the greatest voxel of every block that it meets, the first in C order."""
    leaf, used = batched.side(view.fov), view.ball()[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched.greatest(batched.answers(batches, view, leaf, used, batched.sparse), value)

    return answered(nodes, batched.by_block(voxels, leaf), view, leaf, run, "arbor_id bigint, nid bigint, v double, place bigint")


def edited(nodes: DataFrame, kept: DataFrame, masks: DataFrame, view: View, value: str = "dist_view", most: int = batched.MOST) -> DataFrame:
    """``arbor_id, nid, kept, changed, v, place, v2, place2`` of every node and block that it meets: the greatest voxel (as ``greatest``
    gives it) of the volume of ``nodes`` and of that of ``kept``, and whether the volumes differ in the node's part of the block.

    ``kept`` are the nodes that an edit leaves, where they were.  Nodes go to the blocks that they see once; both volumes are
    summed, compared and looked up there, and no voxel is a row.  Of crowded blocks tasks sum their shares first; what they
    give is put together and sent to all of them.
    """
    leaf, keys = batched.side(view.fov), (*batched.KEY, "share")
    there = kept.select("arbor_id", "nid").distinct().withColumn("kept", F.lit(True))
    at = centers(nodes, view).join(shuffled(there), ["arbor_id", "nid"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    pieces = met(at.join(shuffled(batched.packed(masks, view)), ["arbor_id", "nid"], "left"), view, leaf)
    shares = crowded(met(at, view, leaf), most)
    split = not shares.isEmpty()
    rows = dealt(pieces, shares) if split else pieces.withColumns({"share": F.lit(0).cast("bigint"), "shared": F.lit(False)})
    rows = rows.select(*keys, "shared", "nid", "kept", "cx", "cy", "cz", "bits")
    distance, used = view.ball()
    far = np.where(used, distance, np.inf)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched.compared(batches, keys, view, leaf, far, used, value)

    found = "arbor_id bigint, nid bigint, kept boolean, changed boolean, v double, place bigint, v2 double, place2 bigint"
    out = batched.together(rows.where("not shared").drop("shared"), *keys).mapInArrow(told, found)
    if not split:
        return out

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched.both_sums(batches, keys, view, leaf, far)

    some = rows.where("shared").drop("shared")
    cols = "p int, seg int, view int, far double, seg2 int, view2 int, far2 double"
    each = batched.together(some, *keys).mapInArrow(parts, f"arbor_id bigint, bx bigint, by bigint, bz bigint, {cols}")
    whole = each.groupBy(*batched.KEY, "p").agg(*[F.sum(c).cast("int").alias(c) for c in ("seg", "view", "seg2", "view2")], *[F.min(c).alias(c) for c in ("far", "far2")])
    sums = batched.gathered(whole, batched.BOTH).join(F.broadcast(shares), list(batched.KEY)).withColumn("share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1))).drop("shares")
    asked = some.select(*keys, F.lit(1).alias("kind"), "nid", "kept", "cx", "cy", "cz", *[F.lit(None).cast("binary").alias(c) for c in batched.BOTH])
    number = F.lit(None).cast("bigint")
    told_ = sums.select(*keys, F.lit(0).alias("kind"), number.alias("nid"), F.lit(None).cast("boolean").alias("kept"), *[number.alias("c" + a) for a in AXES], *batched.BOTH)

    def looked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched.compared(batches, keys, view, leaf, far, used, value, given=True)

    return out.union(batched.together(told_.union(asked), *keys, within=("kind",)).mapInArrow(looked, found))
