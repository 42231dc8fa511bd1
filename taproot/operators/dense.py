"""Accumulation, masks, scores and connectivity for large fields of view, block by block.

A field of view of millions of voxels can't be a row per voxel.  Here a node's mask is one array; it
is cut along the blocks it touches before the shuffle, as packed bits, and each block adds its cuts
up in dense arrays of its own size.  Nodes are then sent to the blocks that they see, not blocks to nodes: a block
answers for its part of each field of view, and only these answers are put together.  ``volume`` and ``scores``
give the same figures for small fields, which are worked on many at once here too.  A block that very many nodes see is shared by several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taproot.operators import batched, scores, volume
from taproot.operators.batched import KEY, MOST, packed  # noqa: F401
from taproot.operators.volume import AXES, View, crowded, voxel_of

#: Voxels of a field of view up to which many nodes and blocks are worked on at once (``batched``).
SMALL = 4096
Triple = tuple[int, int, int]


def overlap(center: np.ndarray, view: View, block: np.ndarray, leaf: Triple) -> tuple[tuple[slice, ...], tuple[slice, ...]]:
    """Where a field of view and a block meet, in the coordinates of each."""
    low = center - view.half
    lo, hi = np.maximum(low, block * leaf), np.minimum(low + view.fov, (block + 1) * leaf)
    cut = lambda base: tuple(slice(int(p), int(q)) for p, q in zip(lo - base, hi - base, strict=True))
    return cut(low), cut(block * leaf)


def met(nodes: DataFrame, view: View, leaf: Triple) -> DataFrame:
    """``arbor_id, nid, cx, cy, cz, bx, by, bz``: each node with every block that its field of view meets."""
    out = nodes.select("arbor_id", "nid", *[voxel_of(a, v).alias("c" + a) for a, v in zip(AXES, view.voxel, strict=True)])
    for a, n, h in zip(AXES, leaf, view.half, strict=True):
        out = out.withColumn("b" + a, F.explode(F.sequence(F.floor((F.col("c" + a) - h) / n).cast("bigint"), F.floor((F.col("c" + a) + h) / n).cast("bigint"))))
    return out


def _thin(sums: DataFrame) -> DataFrame:
    """Blocks as rows of ``batched.by_block``: only the cells that a field of view met, so that less is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            seg, seen, far = (b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for c in (4, 5, 6))
            used = (seen != 0) | (seg != 0)
            counts, spot = used.sum(axis=1), np.nonzero(used)[1].astype(np.int32)
            data = (spot, seg[used].astype(np.int32), seen[used].astype(np.int32), np.nan_to_num(far[used].astype(float), nan=0.0))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *[batched.binaries(x, counts) for x in data]], names=[*KEY, *batched.BLOCK])

    schema = ", ".join([*[f"{k} bigint" for k in KEY], *[f"{v} binary" for v in batched.BLOCK]])
    return sums.select(*KEY, "seg", "view", "distance").mapInArrow(run, schema)


def _small(view: View, leaf: Triple) -> bool:
    return max(view.fov[0] * view.fov[1] * view.fov[2], leaf[0] * leaf[1] * leaf[2]) <= SMALL


def _dealt(rows: DataFrame, shares: DataFrame) -> DataFrame:
    """``rows`` of nodes with ``share``, 0 unless their block is crowded."""
    return volume.dealt(rows, shares).drop("shared")


def _ball(view: View) -> tuple[np.ndarray, np.ndarray]:
    """Distance from the middle of each voxel of a field of view, 1 at the corners, and whether it is used."""
    grid = np.stack(np.meshgrid(*[np.arange(n) - h for n, h in zip(view.fov, view.half, strict=True)], indexing="ij"), axis=-1)
    squares = ((grid * np.array(view.voxel)) ** 2).sum(axis=-1)
    corner = float(((np.array(view.half) * view.voxel) ** 2).sum()) ** 0.5 or 1.0
    side = min(n * v for n, v in zip(view.fov, view.voxel, strict=True))
    inside = 4 * squares <= side * side if view.use_sphere else np.ones(view.fov, bool)
    return np.sqrt(squares.astype(float)) / corner, inside


SUMS = "arbor_id bigint, bx bigint, by bigint, bz bigint, seg array<int>, view array<int>, distance array<double>"


def _block(key: list[int], sums: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    """A row of ``SUMS``."""
    seg, seen, least = (a.ravel() for a in sums)
    cols = [pa.array([k], pa.int64()) for k in key]
    lists = [pa.array([v], pa.list_(k)) for v, k in ((seg, pa.int32()), (seen, pa.int32()), (np.where(np.isinf(least), np.nan, least), pa.float64()))]
    return pa.RecordBatch.from_arrays([*cols, *lists], names=[*KEY, "seg", "view", "distance"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one block after each other as one."""
    now, total = None, None
    for b in batches:
        for r in range(b.num_rows):
            key = [b.column(c)[r].as_py() for c in range(4)]
            seg, seen, far = (b.column(c)[r].values.to_numpy(zero_copy_only=False) for c in (4, 5, 6))
            far = np.where(np.isnan(far), np.inf, far)
            if key == now:
                total = (total[0] + seg, total[1] + seen, np.minimum(total[2], far))
                continue
            if now is not None:
                yield _block(now, total)
            now, total = key, (seg, seen, far)
    if now is not None:
        yield _block(now, total)


def accumulate(nodes: DataFrame, masks: DataFrame, view: View, leaf: Triple = (64, 64, 64), most: int = MOST) -> DataFrame:
    """``arbor_id, bx, by, bz, seg, view, distance``: the three accumulators of each block, C order.

    ``masks`` has ``arbor_id, nid, bits`` as ``packed`` gives it; nodes without one only count views and
    distances.  A distance that was never seen is NaN.  Memory is that of one block and one mask.
    Interpolation along edges is for small fields only.
    """
    if view.interpolate:
        raise ValueError("dense accumulation does not interpolate along edges")
    at = volume.centers(nodes, view)
    rows = at.join(masks.select("arbor_id", "nid", "bits"), ["arbor_id", "nid"], "left").select("arbor_id", "nid", "cx", "cy", "cz", "bits")
    total = view.fov[0] * view.fov[1] * view.fov[2]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                arbor, nid, cx, cy, cz, bits = (c[r].as_py() for c in b.columns)
                center = np.array([cx, cy, cz])
                mask = None if bits is None else np.unpackbits(np.frombuffer(bits, np.uint8), count=total).reshape(view.fov)
                first, last = (center - view.half) // leaf, (center + view.half) // leaf
                keys, parts = [], []
                for block in np.ndindex(*(last - first + 1)):
                    block = first + block
                    mine, _ = overlap(center, view, block, leaf)
                    keys.append(block)
                    parts.append(None if mask is None else np.packbits(mask[mine]).tobytes())
                k = np.array(keys)
                cols = [np.full(len(k), arbor), *k.T, np.full(len(k), nid), *[np.full(len(k), c) for c in center]]
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols], pa.array(parts, pa.binary())], names=[*KEY, "nid", "cx", "cy", "cz", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far, inside = _ball(view)
        far = np.where(inside, far, np.inf)
        now, sums = None, None
        for b in batches:
            for r in range(b.num_rows):
                *key, share, cx, cy, cz, part = (c[r].as_py() for c in b.columns)
                if [*key, share] != now:
                    if now is not None:
                        yield _block(now[:4], sums)
                    now, sums = [*key, share], (np.zeros(leaf, np.int32), np.zeros(leaf, np.int32), np.full(leaf, np.inf))
                mine, theirs = overlap(np.array([cx, cy, cz]), view, np.array(key[1:]), leaf)
                shape = tuple(s.stop - s.start for s in mine)
                if part is not None:
                    sums[0][theirs] += np.unpackbits(np.frombuffer(part, np.uint8), count=int(np.prod(shape))).reshape(shape)
                sums[1][theirs] += 1
                sums[2][theirs] = np.minimum(sums[2][theirs], far[mine])
        if now is not None:
            yield _block(now[:4], sums)

    def add_small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far, inside = _ball(view)
        yield from batched.block_sums(batches, (*KEY, "share"), view, leaf, np.where(inside, far, np.inf))

    if _small(view, leaf):
        pieces = volume.met(rows, view, leaf).withColumn("n", F.lit(1))
        shares = crowded(met(nodes, view, leaf), most)
        few = _dealt(pieces, shares).select(*KEY, "share", "cx", "cy", "cz", "bits", "n")
        return _one(batched.together(few, *KEY, "share").mapInArrow(add_small, SUMS), shares)
    pieces = rows.mapInArrow(cut, "arbor_id bigint, bx bigint, by bigint, bz bigint, nid bigint, cx bigint, cy bigint, cz bigint, part binary")
    shares = crowded(met(nodes, view, leaf), most)
    dealt = _dealt(pieces, shares).select(*KEY, "share", "cx", "cy", "cz", "part")
    return _one(dealt.repartition(*KEY, "share").sortWithinPartitions(*KEY, "share").mapInArrow(add, SUMS), shares)


def _one(sums: DataFrame, shares: DataFrame) -> DataFrame:
    """The parts of blocks that were shared as one."""
    if shares.isEmpty():
        return sums
    return sums.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(_merged, SUMS)


def _answers(nodes: DataFrame, sums: DataFrame, view: View, leaf: Triple, most: int, answer, schema: str) -> DataFrame:
    """What every block has to say to the nodes that see it: ``answer(values, mine, theirs)`` gives the columns after ``arbor_id, nid``.

    ``values`` are the four weighted masks of a whole block, without the ball, and the ball's part.  A block without a
    row is all 0.  Blocks go to the tasks that share them, nodes to one of them.
    """
    seen = met(nodes, view, leaf)
    shares = crowded(seen, most)
    lists = ["seg", "view", "distance"]
    none = [F.lit(None).cast(t).alias(c) for c, t in zip(lists, ("array<int>", "array<int>", "array<double>"), strict=True)]
    number = F.lit(None).cast("bigint")
    here = sums.join(shares, list(KEY), "left").withColumn("share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("shares", F.lit(1)) - 1)))
    left = here.select(*KEY, "share", F.lit(0).alias("kind"), number.alias("nid"), *[number.alias("c" + a) for a in AXES], *lists)
    right = _dealt(seen, shares).select(*KEY, "share", F.lit(1).alias("kind"), "nid", *["c" + a for a in AXES], *none)
    denominator = float(view.incr_denom)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, inside = _ball(view)
        now, values = None, None
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns[:10]]
            out = []
            for r in range(b.num_rows):
                key = [int(c[r]) for c in cols[:4]]
                if key != now:
                    now, values = key, {k: np.zeros(leaf) for k in ("boolean", "dist", "viewed", "dist_view")}
                if cols[5][r] == 0:
                    seg, seen, far = (b.column(10 + c)[r].values.to_numpy(zero_copy_only=False).reshape(leaf) for c in range(3))
                    share = seg / np.where(seen + denominator > 0, seen + denominator, np.inf)
                    if (share > 1).any():
                        raise ValueError("confidence above 1")
                    far = np.nan_to_num(far, nan=0.0)
                    values = {"boolean": (seg > 0).astype(float), "dist": np.where(seg > 0, far, 0.0), "viewed": share, "dist_view": share * far}
                else:
                    center = np.array([int(c[r]) for c in cols[7:10]])
                    mine, theirs = overlap(center, view, np.array(key[1:]), leaf)
                    out.append((key[0], int(cols[6][r]), *answer(values, inside[mine], mine, theirs)))
            if out:
                fields = pa.schema([(n, _ARROW[t]) for n, t in (f.split(" ") for f in schema.split(", "))])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)

    both = left.union(right).repartition(*KEY, "share").sortWithinPartitions(*KEY, "share", "kind")
    return both.mapInArrow(run, schema)


_ARROW = {"bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary()}


def max_vectors(nodes: DataFrame, sums: DataFrame, view: View, leaf: Triple = (64, 64, 64), value: str = "dist_view", most: int = MOST) -> DataFrame:
    """``arbor_id, nid, di, dj, dk, score`` as ``scores.max_vector``: each block gives the greatest value of its part and
    the first place of it in C order, and the greatest of these is the node's."""
    if _small(view, leaf):

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from batched.greatest(batched.answers(batches, view, leaf, _ball(view)[1], batched.sparse), value)

        few = volume.answered(nodes, _thin(sums), view, leaf, run, "arbor_id bigint, nid bigint, v double, place bigint", most)
        return scores.vectors(scores.best_of(few), view)
    n1, n2 = view.fov[1], view.fov[2]

    def answer(values, inside, mine, theirs):
        part = values[value][theirs] * inside
        at = int(part.argmax())
        i, j, k = (int(x) + s.start for x, s in zip(np.unravel_index(at, part.shape), mine, strict=True))
        return float(part.ravel()[at]), (i * n1 + j) * n2 + k

    found = _answers(nodes, sums, view, leaf, most, answer, "arbor_id bigint, nid bigint, v double, place bigint")
    return scores.vectors(scores.best_of(found), view)


def weighted(nodes: DataFrame, sums: DataFrame, view: View, leaf: Triple = (64, 64, 64), value: str = "dist_view", most: int = MOST) -> DataFrame:
    """``arbor_id, nid, mask``: one of the masks ``boolean``, ``dist``, ``viewed``, ``dist_view`` of each node's whole field of view,
    as doubles in C order."""
    if _small(view, leaf):
        total = view.fov[0] * view.fov[1] * view.fov[2]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from batched.parts(batched.answers(batches, view, leaf, _ball(view)[1], batched.sparse), value)

        def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t, begin, at, w in batched.laid(batches, ("arbor_id", "nid"), total):
                grid = np.zeros(len(begin) * total)
                grid[at] = w
                ends = pa.array(np.arange(len(begin) + 1, dtype=np.int32) * total)
                ids = [pa.array(t.column(c).to_numpy()[begin]) for c in ("arbor_id", "nid")]
                yield pa.RecordBatch.from_arrays([*ids, pa.ListArray.from_arrays(ends, pa.array(grid))], names=["arbor_id", "nid", "mask"])

        few = volume.answered(nodes, _thin(sums), view, leaf, run, "arbor_id bigint, nid bigint, p binary, w binary", most)
        return batched.together(few, "arbor_id", "nid").mapInArrow(lay, "arbor_id bigint, nid bigint, mask array<double>")

    def answer(values, inside, mine, theirs):
        part = values[value][theirs] * inside
        return (*[s.start for s in mine], *part.shape, np.ascontiguousarray(part).tobytes())

    names = [*["o" + a for a in AXES], *["n" + a for a in AXES]]
    parts = _answers(nodes, sums, view, leaf, most, answer, "arbor_id bigint, nid bigint, " + ", ".join(f"{n} bigint" for n in names) + ", part binary")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, whole = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), pa.array([whole.ravel()], pa.list_(pa.float64()))], names=["arbor_id", "nid", "mask"])
        for b in batches:
            for r in range(b.num_rows):
                arbor, nid, *at, part = (c[r].as_py() for c in b.columns)
                if (arbor, nid) != now:
                    if now is not None:
                        yield done()
                    now, whole = (arbor, nid), np.zeros(view.fov)
                whole[tuple(slice(o, o + n) for o, n in zip(at[:3], at[3:], strict=True))] = np.frombuffer(part).reshape(at[3:])
        if now is not None:
            yield done()

    return parts.repartition("arbor_id", "nid").sortWithinPartitions("arbor_id", "nid").mapInArrow(join, "arbor_id bigint, nid bigint, mask array<double>")


def connectivity(nodes: DataFrame, masks: DataFrame, view: View) -> DataFrame:
    """``arbor_id, nid, pid, connectivity`` as ``scores.connectivity``; both ends' packed masks meet in one row of the edge."""
    at = nodes.select("arbor_id", "nid", "pid", *[voxel_of(a, v).alias("c" + a) for a, v in zip(AXES, view.voxel, strict=True)])
    held = at.join(masks.select("arbor_id", "nid", "bits"), ["arbor_id", "nid"], "left")
    up = held.select("arbor_id", F.col("nid").alias("pid"), *[F.col("c" + a).alias("p" + a) for a in AXES], F.col("bits").alias("theirs"))
    edges = held.where("pid is not null").join(up, ["arbor_id", "pid"]).select("arbor_id", "nid", "pid", *["c" + a for a in AXES], *["p" + a for a in AXES], "bits", "theirs")
    total = view.fov[0] * view.fov[1] * view.fov[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in range(b.num_rows):
                child, parent = (np.array([b.column(c)[r].as_py() for c in cs]) for cs in ((3, 4, 5), (6, 7, 8)))
                one, two = b.column(9)[r].as_py(), b.column(10)[r].as_py()
                low, high = np.maximum(child, parent), np.minimum(child, parent) + view.fov
                if one is None or two is None:
                    out.append(-1.0)
                elif (low >= high).any():
                    out.append(-2.0)
                else:
                    cuts = [tuple(slice(int(p), int(q)) for p, q in zip(low - c, high - c, strict=True)) for c in (child, parent)]
                    a, c = (np.unpackbits(np.frombuffer(m, np.uint8), count=total).reshape(view.fov)[s] for m, s in zip((one, two), cuts, strict=True))
                    out.append(float((a & c).sum()) / float(a.size))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.float64())], names=["arbor_id", "nid", "pid", "connectivity"])

    return edges.mapInArrow(run, "arbor_id bigint, nid bigint, pid bigint, connectivity double")


def ranking(nodes: DataFrame, masks: DataFrame, sums: DataFrame, view: View, leaf: Triple = (64, 64, 64), consensus: bool = False, most: int = MOST) -> DataFrame:
    """As ``scores.ranking``, from packed masks and the sums of blocks."""
    found = max_vectors(nodes, sums, view, leaf, most=most)
    return scores.listed(nodes, connectivity(nodes, masks, view), scores.smoothed(found, nodes) if consensus else found, view)


def to_voxels(sums: DataFrame, leaf: Triple) -> DataFrame:
    """The seen voxels of ``accumulate`` as the table that ``volume.accumulate`` gives."""
    e = sums.select(*KEY, F.posexplode(F.arrays_zip("seg", "view", "distance")).alias("p", "s")).where("s.view > 0")
    spot = (F.floor(F.col("p") / (leaf[1] * leaf[2])), F.pmod(F.floor(F.col("p") / leaf[2]), F.lit(leaf[1])), F.pmod(F.col("p"), F.lit(leaf[2])))
    at = [(F.col("b" + a) * n + d).cast("bigint").alias("v" + a) for a, n, d in zip(AXES, leaf, spot, strict=True)]
    return e.select("arbor_id", *at, F.col("s.seg").alias("seg_count"), F.col("s.view").alias("view_count"), F.nanvl(F.col("s.distance"), F.lit(None)).alias("distance"))
