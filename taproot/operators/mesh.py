"""Surfaces of sparse volumes: edge cells, vertices, triangles, decimation."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taproot.operators import batched
from taproot.operators.joins import shuffled

CORNERS = [(i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)]
SHIFT = 1 << 20


#: Side of the blocks that cells are found in; a voxel is sent (9/8)^3 = 1.4 times on average.
SIDE = 8

#: Blocks that are tested at once, as dense arrays.
AT_ONCE = 512


PACKED = {"p": "i4", "w": "f8"}


def of_voxels(voxels: DataFrame, value: str = "value") -> DataFrame:
    """``arbor_id, bx, by, bz, p, w``: voxels packed by blocks of side ``SIDE``, as ``volume.live`` gives them too.

    ``p`` is a voxel's place in its block, in C order.  Voxels of null value are left out.  A block may occur again.
    """
    block = {a: F.floor(F.col("v" + a) / SIDE).cast("bigint") for a in "xyz"}
    i, j, k = (F.col("v" + a) - block[a] * SIDE for a in "xyz")
    spots = voxels.where(F.col(value).isNotNull()).select("arbor_id", *[c.alias("b" + a) for a, c in block.items()], ((i * SIDE + j) * SIDE + k).alias("p"), F.col(value).alias("w"))
    return batched.gathered(spots, PACKED)


def _wide(packed: DataFrame, below: int) -> DataFrame:
    """``packed`` with each block's neighbourhood: the voxels beyond its high faces, and with ``below`` 1 those before its low ones.

    Places are those in a block of side ``SIDE + 1 + below``, in one task and one after the other by blocks.
    """
    n, wide = SIDE, SIDE + 1 + below
    moves = np.array(np.meshgrid(*[range(-below, 2)] * 3, indexing="ij")).reshape(3, -1).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batched.tables(batches, 4096):
            spots, counts = batched.values_of(t.column("p"), "i4")
            w = batched.values_of(t.column("w"), "f8")[0]
            row = np.repeat(np.arange(t.num_rows), counts)
            at = np.stack(np.unravel_index(spots, (n, n, n)))
            names = [t.column(k).to_numpy() for k in batched.KEY]
            rows, places, values, keys = [], [], [], []
            for d in moves:
                # the block that lies ``d`` before this one has the voxel at ``n * d`` further on
                here = at + (n * d)[:, None] + below
                fit = ((here >= 0) & (here < wide)).all(axis=0)
                mine, some = np.unique(row[fit], return_counts=True)
                if len(mine):
                    rows.append(some)
                    places.append(((here[0][fit] * wide + here[1][fit]) * wide + here[2][fit]).astype(np.int32))
                    values.append(w[fit])
                    keys.append([names[0][mine], *[names[1 + c][mine] - d[c] for c in range(3)]])
            if rows:
                size = np.concatenate(rows)
                cols = [*[pa.array(np.concatenate(k)) for k in zip(*keys, strict=True)], batched.binaries(np.concatenate(places), size), batched.binaries(np.concatenate(values), size)]
                yield from pa.Table.from_arrays(cols, names=[*batched.KEY, *PACKED]).to_batches()

    schema = "arbor_id bigint, bx bigint, by bigint, bz bigint, p binary, w binary"
    return batched.together(packed.mapInArrow(run, schema), *batched.KEY)


def _grids(batches: Iterator[pa.RecordBatch], wide: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Keys of blocks, and their values: of voxels that repeat a place the greatest, NaN being the greatest of all, 0 where there is none."""
    for t, begin, group in batched.groups(batches, batched.KEY, AT_ONCE):
        spots, counts = batched.values_of(t.column("p"), "i4")
        at, w = np.repeat(group, counts) * wide**3 + spots, batched.values_of(t.column("w"), "f8")[0]
        grid, set_ = np.full(len(begin) * wide**3, -np.inf), np.zeros(len(begin) * wide**3, bool)
        np.maximum.at(grid, at, w)
        set_[at] = True
        yield [t.column(k).to_numpy()[begin] for k in batched.KEY], np.where(set_, grid, 0.0).reshape(len(begin), wide, wide, wide)


def _cut(grid: np.ndarray, cutoff: float) -> np.ndarray:
    """Whether the cell that begins at each voxel has values on both sides of ``cutoff``."""
    def some(x: np.ndarray) -> np.ndarray:
        for axis in (1, 2, 3):
            one, two = ([slice(None)] * 4 for _ in range(2))
            one[axis], two[axis] = slice(None, -1), slice(1, None)
            x = x[tuple(one)] | x[tuple(two)]
        return x

    return some(grid < cutoff) & some((grid > cutoff) | np.isnan(grid))


def _cells(batches: Iterator[pa.RecordBatch], cutoff: float) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
    """Of blocks of ``_wide`` the edge cells: arbors, lowest voxels, and eight values each."""
    for key, grid in _grids(batches, SIDE + 1):
        found = np.nonzero(_cut(grid, cutoff))
        w = np.stack([grid[found[0], found[1] + i, found[2] + j, found[3] + k] for i, j, k in CORNERS], axis=1)
        yield key[0][found[0]], [key[1 + d][found[0]] * SIDE + found[1 + d] for d in range(3)], w


def edge_cells(voxels: DataFrame, cutoff: float = 0.5, value: str = "value") -> DataFrame:
    """``arbor_id, vx, vy, vz, w``: cells of 2 x 2 x 2 voxels whose values lie on both sides of ``cutoff``.

    A cell is named by its lowest voxel and has its eight values in C order.  Voxels without a row, or of
    null value, are 0, on all sides, so no surface is lost at a block's face; of rows that repeat a voxel the
    greatest counts, NaN being the greatest of all.  Voxels go to their own block, and those on its low faces
    to the blocks below as well: a block then holds all of its cells and is tested as one array.
    """
    return cells_of(of_voxels(voxels, value), cutoff)


def cells_of(packed: DataFrame, cutoff: float = 0.5, values: bool = True) -> DataFrame:
    """``edge_cells`` of packed voxels, without ``w`` unless ``values``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, base, w in _cells(batches, cutoff):
            cols, names = [pa.array(own), *map(pa.array, base)], ["arbor_id", "vx", "vy", "vz"]
            if values:
                ends = pa.array(np.arange(len(w) + 1, dtype=np.int32) * 8)
                cols, names = [*cols, pa.ListArray.from_arrays(ends, pa.array(w.ravel()))], [*names, "w"]
            yield from pa.Table.from_arrays(cols, names=names).to_batches(max_chunksize=1 << 15)

    return _wide(packed, 0).mapInArrow(run, "arbor_id bigint, vx bigint, vy bigint, vz bigint" + ", w array<double>" * values)


def vertex_id(x: Column, y: Column, z: Column) -> Column:
    """One number for a corner: 21 bits an axis, beyond which it is an error.  It needs no global numbering pass."""
    far = F.raise_error(F.lit("a voxel is too far out for a vertex id")).cast("bigint")
    x, y, z = (F.when((c >= -SHIFT) & (c < SHIFT), c).otherwise(far) for c in (x, y, z))
    return (F.shiftleft((x + SHIFT).cast("bigint"), 42) + F.shiftleft((y + SHIFT).cast("bigint"), 21) + (z + SHIFT)).cast("bigint")


def corners(cells: DataFrame, resolution: tuple[float, float, float] = (1, 1, 1)) -> DataFrame:
    """``arbor_id, vid, x, y, z, scalar``: the corners of all cells, each once."""
    n, wide, name = SIDE, SIDE + 1, batched.KEY

    def firsts(at: np.ndarray, w: np.ndarray, size: int) -> np.ndarray:
        """The rows to keep of those that repeat a place below ``size`` with an equal value."""
        first = np.full(size, -1)
        first[at[::-1]] = np.arange(len(at))[::-1]
        held = w[first[at]]
        other = np.flatnonzero(~((held == w) | (np.isnan(held) & np.isnan(w))))
        kept = first[first >= 0]
        if len(other):
            pair = np.stack([at[other].astype(float), w[other]], axis=1)
            kept = np.r_[kept, other[np.unique(pair, axis=0, return_index=True)[1]]]
        return kept

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # cells of one block mostly come one after the other; their corners are told once
        for t in batched.tables(batches, batched.ROWS):
            cell = np.stack([t.column("v" + a).to_numpy() for a in "xyz"], axis=1)
            own, block = t.column("arbor_id").to_numpy(), cell // n
            new = np.r_[True, (own[1:] != own[:-1]) | (block[1:] != block[:-1]).any(axis=1)]
            run, spot = np.cumsum(new) - 1, (cell - block * n)[:, None, :] + np.array(CORNERS)
            at = (run[:, None] * wide**3 + (spot[:, :, 0] * wide + spot[:, :, 1]) * wide + spot[:, :, 2]).ravel()
            w = t.column("w").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            kept = firsts(at, w, (run[-1] + 1) * wide**3)
            kept = kept[np.argsort(at[kept] // wide**3, kind="stable")]
            v = cell[kept // 8] + np.array(CORNERS)[kept % 8]
            owner = v // n
            p = ((v - owner * n) * np.array([n * n, n, 1])).sum(axis=1).astype(np.int32)
            cols = [own[kept // 8], *owner.T, p, w[kept]]
            yield from pa.Table.from_arrays([pa.array(c) for c in cols], names=[*name, "p", "w"]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, begin, group in batched.groups(batches, name, AT_ONCE):
            spots, counts = batched.values_of(t.column("p"), "i4")
            at, w = np.repeat(group, counts) * n**3 + spots, batched.values_of(t.column("w"), "f8")[0]
            kept = firsts(at, w, len(begin) * n**3)
            key = [t.column(k).to_numpy()[begin][at[kept] // n**3] for k in name]
            p = at[kept] % n**3
            spot = [key[1 + d] * n + s for d, s in enumerate((p // (n * n), p // n % n, p % n))]
            yield from pa.Table.from_arrays([pa.array(key[0]), *map(pa.array, spot), pa.array(w[kept])], names=["arbor_id", *"xyz", "scalar"]).to_batches(max_chunksize=1 << 17)

    near = cells.select("arbor_id", "vx", "vy", "vz", "w").mapInArrow(cut, "arbor_id bigint, bx bigint, by bigint, bz bigint, p int, w double")
    e = batched.together(batched.gathered(near, {"p": "i4", "w": "f8"}), *name).mapInArrow(run, "arbor_id bigint, x bigint, y bigint, z bigint, scalar double")
    return e.select("arbor_id", vertex_id(*[F.col(a) for a in "xyz"]).alias("vid"), *[(F.col(a) * float(r)).alias(a) for a, r in zip("xyz", resolution, strict=True)], "scalar")


def vertices(packed: DataFrame, cutoff: float = 0.5, resolution: tuple[float, float, float] = (1, 1, 1)) -> DataFrame:
    """``corners`` of the edge cells of packed voxels: each block tells its own from the cells about them, and no cell is a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, grid in _grids(batches, SIDE + 2):
            cut, met = _cut(grid, cutoff), np.zeros((len(grid), SIDE, SIDE, SIDE), bool)
            for i, j, k in CORNERS:
                met |= cut[:, i : i + SIDE, j : j + SIDE, k : k + SIDE]
            found = np.nonzero(met)
            w = grid[:, 1:-1, 1:-1, 1:-1][found]
            spot = [key[1 + d][found[0]] * SIDE + found[1 + d] for d in range(3)]
            yield from pa.Table.from_arrays([pa.array(c) for c in (key[0][found[0]], *spot, w)], names=["arbor_id", *"xyz", "scalar"]).to_batches(max_chunksize=1 << 17)

    e = _wide(packed, 1).mapInArrow(run, "arbor_id bigint, x bigint, y bigint, z bigint, scalar double")
    return e.select("arbor_id", vertex_id(*[F.col(a) for a in "xyz"]).alias("vid"), *[(F.col(a) * float(r)).alias(a) for a, r in zip("xyz", resolution, strict=True)], "scalar")


def hexahedra(cells: DataFrame) -> DataFrame:
    """``arbor_id, cid, vids``: each cell with its eight corners in ascending order."""
    first, last = (vertex_id(*[F.col("v" + a) + d for a in "xyz"]) for d in (0, 1))
    # corners in C order ascend, so nothing is sorted
    inner = [F.col("cid") + ((i << 42) + (j << 21) + k) for i, j, k in CORNERS[:-1]]
    named = cells.select("arbor_id", first.alias("cid"), last.alias("last"))
    return named.select("arbor_id", "cid", F.array(*inner, F.col("last")).alias("vids"))


#: A cube as six tetrahedra about its main diagonal: the ways from corner 0 to 7, one axis at a time.
TETRAHEDRA = [(0, a, a | b, 7) for a in (1, 2, 4) for b in (1, 2, 4) if a != b]


Points = list[np.ndarray]


def _cross(p: Points, q: Points) -> Points:
    return [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]


def _faces(case: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """The edges of a tetrahedron that are cut where the corners of ``case`` are high, and triangles of these cuts."""
    ins, outs = [k for k in range(4) if case >> k & 1], [k for k in range(4) if not case >> k & 1]
    if len(ins) == 1 or len(outs) == 1:
        one, rest = (ins[0], outs) if len(ins) == 1 else (outs[0], ins)
        return [(one, k) for k in rest], [(0, 1, 2)]
    return [(ins[0], outs[0]), (ins[0], outs[1]), (ins[1], outs[1]), (ins[1], outs[0])], [(0, 1, 2), (0, 2, 3)]


def _marched(w: np.ndarray, cutoff: float) -> Iterator[tuple[np.ndarray, Points, Points, Points, Points]]:
    """Triangles of cells of values ``w``: the cells, three corners within a unit cell as ``x, y, z``, and their normals, twice
    the area long.  Those without an area are left out.

    A cut of a tetrahedron by a plane is wound alike wherever the plane lies, so cuts at the middle tell how.
    """
    unit, values = np.array(CORNERS, float), np.ascontiguousarray(w.T)
    high = values > cutoff
    for tet in TETRAHEDRA:
        p = unit[list(tet)]
        code = sum(high[c].astype(np.uint8) << k for k, c in enumerate(tet))
        order = np.argsort(code, kind="stable")
        ends = np.cumsum(np.bincount(code, minlength=16))
        for case in range(1, 15):
            at = order[ends[case - 1] : ends[case]]
            if not len(at):
                continue
            v, cuts = [values[c][at] for c in tet], []
            edges, faces = _faces(case)
            middle = [(p[a] + p[b]) / 2 for a, b in edges]
            ins, outs = [k for k in range(4) if case >> k & 1], [k for k in range(4) if not case >> k & 1]
            away = p[outs].mean(axis=0) - p[ins].mean(axis=0)
            with np.errstate(divide="ignore", invalid="ignore"):
                for a, b in edges:
                    t = (cutoff - v[a]) / (v[b] - v[a])
                    cuts.append([p[a][d] + t * (p[b] - p[a])[d] for d in range(3)])
                for a, b, c in faces:
                    if np.cross(middle[b] - middle[a], middle[c] - middle[a]) @ away < 0:
                        b, c = c, b
                    one, two, three = cuts[a], cuts[b], cuts[c]
                    normal = _cross([y - x for x, y in zip(one, two, strict=True)], [y - x for x, y in zip(one, three, strict=True)])
                    real = np.sqrt(sum(x * x for x in normal)) > 1e-12
                    if real.all():
                        yield at, one, two, three, normal
                    else:
                        yield at[real], *[[x[real] for x in q] for q in (one, two, three, normal)]


def triangles(cells: DataFrame, cutoff: float = 0.5, resolution: tuple[float, float, float] = (1, 1, 1)) -> DataFrame:
    """``arbor_id, ax .. cz``: the surface at ``cutoff`` by marching tetrahedra, wound outwards.

    Points lie on the tetrahedra's edges by linear interpolation.  Neighbouring cells cut their shared
    face alike, so the surface is closed where the volume's values end within it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                base = [batch.column(k).to_numpy() for k in (1, 2, 3)]
                yield from _rows(batch.column(0).to_numpy(), base, np.array(batch.column(4).flatten()).reshape(-1, 8), cutoff, resolution)

    return cells.select("arbor_id", "vx", "vy", "vz", "w").mapInArrow(run, _TRIANGLES)


_NAMES = ["arbor_id", *[p + a for p in "abc" for a in "xyz"]]
_TRIANGLES = "arbor_id bigint, " + ", ".join(f"{x} double" for x in _NAMES[1:])
#: Cells whose triangles are made at once.
MARCHED = 1 << 15


def _placed(own: np.ndarray, base: list[np.ndarray], w: np.ndarray, cutoff: float, resolution: tuple[float, float, float]) -> Iterator[tuple]:
    """Arbors, three corners in space, and normals in space of the triangles of some cells."""
    for lo in range(0, len(w), MARCHED):
        cut = slice(lo, lo + MARCHED)
        arbors, at_ = own[cut], [c[cut].astype(float) for c in base]
        for at, *points, normal in _marched(w[cut], cutoff):
            if len(at):
                x, y, z = map(float, resolution)
                yield arbors[at], [[(q[d] + at_[d][at]) * resolution[d] for d in range(3)] for q in points], [c * f for c, f in zip(normal, (y * z, x * z, x * y), strict=True)]


def _rows(own: np.ndarray, base: list[np.ndarray], w: np.ndarray, cutoff: float, resolution: tuple[float, float, float]) -> Iterator[pa.RecordBatch]:
    for arbors, points, _ in _placed(own, base, w, cutoff, resolution):
        yield pa.RecordBatch.from_arrays([pa.array(arbors), *[pa.array(x) for q in points for x in q]], names=_NAMES)


def measures(packed: DataFrame, cutoff: float = 0.5, resolution: tuple[float, float, float] = (1, 1, 1)) -> DataFrame:
    """``arbor_id, triangles, area, volume`` of the surface of packed voxels: every triangle is made and added up where it is made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, base, w in _cells(batches, cutoff):
            ids, group = np.unique(own, return_inverse=True)
            sums = np.zeros((3, len(ids)))
            for at, (one, _, _), normal in _placed(group, base, w, cutoff, resolution):
                for k, x in enumerate((None, np.sqrt(sum(c * c for c in normal)), sum(p * c for p, c in zip(one, normal, strict=True)))):
                    sums[k] += np.bincount(at, x, len(ids))
            cols = [pa.array(ids), pa.array(sums[0].astype(np.int64)), pa.array(sums[1] / 2), pa.array(sums[2] / 6)]
            yield pa.RecordBatch.from_arrays(cols, names=["arbor_id", "triangles", "area", "volume"])

    parts = _wide(packed, 0).mapInArrow(run, "arbor_id bigint, triangles bigint, area double, volume double")
    return parts.groupBy("arbor_id").agg(*[F.sum(c).alias(c) for c in ("triangles", "area", "volume")]).where("triangles > 0")


def decimated(mesh: DataFrame, cell: float) -> DataFrame:
    """Vertices clustered on a grid of side ``cell``, each cluster at its mean; collapsed triangles go.

    With ``cell`` 0 the mesh stays as it is.
    """
    if not cell:
        return mesh
    key = lambda p: [F.floor(F.col(p + a) / cell).cast("bigint") for a in "xyz"]
    points = None
    for p in "abc":
        some = mesh.select("arbor_id", *[k.alias("k" + a) for a, k in zip("xyz", key(p), strict=True)], *[F.col(p + a).alias(a) for a in "xyz"])
        points = some if points is None else points.union(some)
    mean = points.groupBy("arbor_id", "kx", "ky", "kz").agg(*[F.avg(a).alias(a) for a in "xyz"])
    out = mesh.select("arbor_id", *[k.alias(p + "k" + a) for p in "abc" for a, k in zip("xyz", key(p), strict=True)])
    same = lambda p, q: (F.col(p + "kx") == F.col(q + "kx")) & (F.col(p + "ky") == F.col(q + "ky")) & (F.col(p + "kz") == F.col(q + "kz"))
    out = out.where(~(same("a", "b") | same("b", "c") | same("a", "c"))).distinct()
    for p in "abc":
        m = mean.select("arbor_id", *[F.col("k" + a).alias(p + "k" + a) for a in "xyz"], *[F.col(a).alias(p + a) for a in "xyz"])
        out = out.join(shuffled(m), ["arbor_id", *[p + "k" + a for a in "xyz"]])
    return out.select("arbor_id", *[p + a for p in "abc" for a in "xyz"])


def _distinct(code: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of whole numbers, the first of each that differs and which one each row is."""
    low = [c.min() for c in code]
    size = [int(c.max() - m) + 1 for c, m in zip(code, low, strict=True)]
    if math.prod(size) < 1 << 62:
        whole = np.zeros(len(code[0]), np.int64)
        for c, m, n in zip(code, low, size, strict=True):
            whole = whole * n + (c - m)
        _, first, which = np.unique(whole, return_index=True, return_inverse=True)
    else:
        _, first, which = np.unique(np.stack(code, axis=1), axis=0, return_index=True, return_inverse=True)
    return first, which.reshape(-1)


def clustered(packed: DataFrame, cell: float, cutoff: float = 0.5, resolution: tuple[float, float, float] = (1, 1, 1)) -> DataFrame:
    """``decimated`` triangles of packed voxels, without a row for any triangle before: ``arbor_id, ax .. cz``.

    A task adds up the points of each cluster and tells its triangles of clusters once.  Both go to boxes of many
    clusters: a triangle to the box of its least cluster, a cluster's sums to all boxes whose triangles may name it.
    """
    # clusters that the corners of one triangle may lie apart, clusters to a box's side, and with those beyond it
    apart = np.array([math.floor(r / cell) + 1 for r in resolution])
    side = np.maximum(16, 4 * apart)
    wide = side + apart
    if math.prod(map(int, wide)) * AT_ONCE >= 1 << 62:
        raise ValueError("a cluster is too small for the voxels")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = lambda k, box: ((k[0] - box[0] * side[0]) * wide[1] + k[1] - box[1] * side[1]) * wide[2] + k[2] - box[2] * side[2]
        for own, base, w in _cells(batches, cutoff):
            found = list(_placed(own, base, w, cutoff, resolution))
            if not found:
                continue
            arbor = np.concatenate([f[0] for f in found])
            xyz = [np.concatenate([f[1][p][d] for p in range(3) for f in found]) for d in range(3)]
            code = [np.tile(arbor, 3), *[np.floor(c / cell).astype(np.int64) for c in xyz]]
            first, which = _distinct(code)
            code, n = [c[first] for c in code], len(first)
            sums = [np.bincount(which, minlength=n), *[np.bincount(which, c, n) for c in xyz]]
            t = which.reshape(3, -1)
            t = t[:, (t[0] != t[1]) & (t[1] != t[2]) & (t[0] != t[2])]
            t = t[:, _distinct(list(t))[0]] if t.shape[1] else t
            # clusters to boxes, then triangles to boxes
            boxes, rows, places = [], [], []
            for d in itertools.product((0, 1), repeat=3):
                box = [(c - m * a) // s for c, m, a, s in zip(code[1:], d, apart, side, strict=True)]
                new = np.logical_and.reduce([(b != c // s) | (m == 0) for b, c, m, s in zip(box, code[1:], d, side, strict=True)])
                boxes.append(np.stack([code[0], *box], axis=1)[new])
                rows.append(np.flatnonzero(new))
                places.append(place(code[1:], box)[new])
            home = [np.minimum.reduce([c[k] for k in t]) // s for c, s in zip(code[1:], side, strict=True)]
            boxes.append(np.stack([code[0][t[0]], *home], axis=1))
            corner = np.stack([place([c[k] for c in code[1:]], home) for k in t], axis=1).astype(np.int64)
            boxes, row = np.concatenate(boxes), np.concatenate(rows)
            head, box = _distinct(list(boxes.T))
            one, two = np.argsort(box[: len(row)], kind="stable"), np.argsort(box[len(row) :], kind="stable")
            many, few = np.bincount(box[: len(row)], minlength=len(head)), np.bincount(box[len(row) :], minlength=len(head))
            cols = [batched.binaries(x[one], many) for x in (np.concatenate(places).astype(np.int64), *[x[row].astype(k) for x, k in zip(sums, ("i8", "f8", "f8", "f8"), strict=True)])]
            cols.append(batched.binaries(corner[two].ravel(), few * 3))
            yield from pa.Table.from_arrays([*map(pa.array, boxes[head].T.copy()), *cols], names=[*batched.KEY, *parts]).to_batches()

    parts = ["p", "n", "x", "y", "z", "t"]

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = math.prod(map(int, wide))
        for t, begin, group in batched.groups(batches, batched.KEY, AT_ONCE):
            spots, counts = batched.values_of(t.column("p"), "i8")
            at = np.repeat(group, counts) * total + spots
            n, x, y, z = (batched.values_of(t.column(c), k)[0] for c, k in (("n", "i8"), ("x", "f8"), ("y", "f8"), ("z", "f8")))
            # in one order, so that boxes which share a cluster place it alike
            order = np.lexsort((n, z, y, x, at))
            at = at[order]
            start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            mean = [np.add.reduceat(c[order], start) / np.add.reduceat(n[order], start) for c in (x, y, z)]
            corner, counts = batched.values_of(t.column("t"), "i8")
            if not len(corner):
                continue
            corner = np.searchsorted(at[start], np.repeat(group, counts) * total + corner).reshape(-1, 3)
            corner = corner[_distinct(list(corner.T))[0]]
            arbor = t.column("arbor_id").to_numpy()[begin][at[start][corner[:, 0]] // total]
            cols = [pa.array(arbor), *[pa.array(m[corner[:, k]]) for k in range(3) for m in mean]]
            yield from pa.Table.from_arrays(cols, names=_NAMES).to_batches(max_chunksize=1 << 16)

    schema = "arbor_id bigint, bx bigint, by bigint, bz bigint, " + ", ".join(f"{c} binary" for c in parts)
    return batched.together(_wide(packed, 0).mapInArrow(told, schema), *batched.KEY).mapInArrow(laid, _TRIANGLES)


def surface_of(packed: DataFrame, cutoff: float = 0.5, resolution: tuple[float, float, float] = (1, 1, 1), cell: float = 0.0) -> DataFrame:
    """``surface`` of packed voxels."""
    if cell:
        return clustered(packed, cell, cutoff, resolution)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, base, w in _cells(batches, cutoff):
            yield from _rows(own, base, w, cutoff, resolution)

    return _wide(packed, 0).mapInArrow(run, _TRIANGLES)


def surface(voxels: DataFrame, cutoff: float = 0.5, resolution: tuple[float, float, float] = (1, 1, 1), cell: float = 0.0, value: str = "value") -> DataFrame:
    """Cells, triangles and decimation in one plan."""
    return surface_of(of_voxels(voxels, value), cutoff, resolution, cell)
