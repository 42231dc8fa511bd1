"""Block-sparse volumes: one row per block that exists, uniform blocks without data.

``arbor_id, bx, by, bz, uniform, data``: ``data`` is a block's values in C order, null where the block is
``uniform``.  Blocks that do not exist hold the fill value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taproot.operators import batched
from taproot.operators.joins import shuffled

AXES = ("x", "y", "z")
Triple = tuple[int, int, int]
Range = tuple[int, int]
KEY = batched.KEY
BLOCKS = "arbor_id bigint, bx bigint, by bigint, bz bigint, uniform double, data array<double>"


def cells(leaf: Triple) -> int:
    return leaf[0] * leaf[1] * leaf[2]


def place(leaf: Triple, prefix: str = "v") -> Column:
    """A voxel's place in its block, in C order."""
    i, j, k = (F.pmod(F.col(prefix + a), F.lit(n)) for a, n in zip(AXES, leaf, strict=True))
    return ((i * leaf[1] + j) * leaf[2] + k).cast("int")


def from_voxels(voxels: DataFrame, leaf: Triple, value: str = "value", fill: float = 0.0) -> DataFrame:
    """Blocks of the voxels ``arbor_id, vx, vy, vz, value``; a block all of one value becomes uniform.

    Voxels are put together by blocks before they are shuffled."""
    n = cells(leaf)
    spots = voxels.select("arbor_id", *[F.floor(F.col("v" + a) / m).cast("bigint").alias("b" + a) for a, m in zip(AXES, leaf, strict=True)], place(leaf).alias("p"), F.col(value).cast("double").alias("w"))
    spots = spots.withColumn("o", F.col("w").isNotNull().cast("tinyint")).withColumn("w", F.coalesce("w", F.lit(0.0)))
    return _built(batched.gathered(spots, {"p": "i4", "w": "f8", "o": "i1"}), leaf, fill)


def from_packed(packed: DataFrame, leaf: Triple, fill: float = 0.0) -> DataFrame:
    """``from_voxels`` of voxels that are packed by blocks of ``leaf``, as ``volume.live`` gives them: no voxel is a row."""
    return _built(packed.select(*KEY, "p", "w"), leaf, fill)


def _lists(grid: np.ndarray, null: np.ndarray, kept: np.ndarray) -> pa.Array:
    """The rows ``kept`` of ``grid`` as lists, of the others none."""
    ends = pa.array(np.r_[0, np.cumsum(np.where(kept, grid.shape[1], 0))].astype(np.int32), mask=np.r_[~kept, False])
    return pa.ListArray.from_arrays(ends, pa.array(grid[kept].ravel(), mask=null[kept].ravel()))


def _alike(grid: np.ndarray, null: np.ndarray) -> np.ndarray:
    """Which rows are of one value."""
    return ~null.any(axis=1) & ((grid == grid[:, :1]) | (np.isnan(grid) & np.isnan(grid[:, :1]))).all(axis=1)


def _built(put: DataFrame, leaf: Triple, fill: float) -> DataFrame:
    n, nulls = cells(leaf), "o" in put.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, begin, group in batched.groups(batches, KEY, max(1, batched.CELLS // n)):
            at, counts = batched.values_of(t.column("p"), "i4")
            at = np.repeat(group, counts) * n + at
            grid, set_, null = np.full(len(begin) * n, float(fill)), np.zeros(len(begin) * n, bool), np.zeros(len(begin) * n, bool)
            grid[at], set_[at] = batched.values_of(t.column("w"), "f8")[0], True
            if nulls:
                null[at] = batched.values_of(t.column("o"), "i1")[0] == 0
            rows, null = grid.reshape(-1, n), null.reshape(-1, n)
            same = set_.reshape(-1, n).all(axis=1) & _alike(rows, null)
            keys = [pa.array(t.column(k).to_numpy()[begin]) for k in KEY]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(rows[:, 0], mask=~same), _lists(rows, null, ~same)], names=[*KEY, "uniform", "data"])

    return batched.together(put, *KEY).mapInArrow(run, BLOCKS)


def to_voxels(blocks: DataFrame, leaf: Triple) -> DataFrame:
    """Every voxel of the blocks there are: ``arbor_id, vx, vy, vz, value``."""
    full = F.coalesce(F.col("data"), F.array_repeat(F.col("uniform"), cells(leaf)))
    e = blocks.select("arbor_id", "bx", "by", "bz", F.posexplode(full).alias("p", "value"))
    i, j, k = F.floor(F.col("p") / (leaf[1] * leaf[2])), F.pmod(F.floor(F.col("p") / leaf[2]), F.lit(leaf[1])), F.pmod(F.col("p"), F.lit(leaf[2]))
    return e.select("arbor_id", *[(F.col("b" + a) * n + d).cast("bigint").alias("v" + a) for a, n, d in zip(AXES, leaf, (i, j, k), strict=True)], "value")


def checked(key: object, shape: tuple[Range, Range, Range]) -> tuple[Range, Range, Range]:
    """Half-open ranges of a three-part key of numbers and slices without step; ``[:]`` is all."""
    if key == slice(None):
        return shape
    if not isinstance(key, tuple) or len(key) != 3:
        raise IndexError("a key has three parts")
    out = []
    for part, (lo, hi) in zip(key, shape, strict=True):
        if isinstance(part, slice):
            if part.step not in (None, 1):
                raise IndexError("steps are not supported")
            a, b = lo if part.start is None else part.start, hi if part.stop is None else part.stop
        else:
            a, b = int(part), int(part) + 1
        if not lo <= a < b <= hi:
            raise IndexError(f"{a}:{b} is empty or out of {lo}:{hi}")
        out.append((a, b))
    return tuple(out)


def touching(blocks: DataFrame, leaf: Triple, region: tuple[Range, Range, Range]) -> DataFrame:
    """Blocks that meet a region: literal ranges on the block keys, which Parquet can skip by."""
    fit = F.lit(True)
    for a, n, (lo, hi) in zip(AXES, leaf, region, strict=True):
        fit &= F.col("b" + a).between(lo // n, (hi - 1) // n)
    return blocks.where(fit)


def inside(region: tuple[Range, Range, Range]) -> Column:
    fit = F.lit(True)
    for a, (lo, hi) in zip(AXES, region, strict=True):
        fit &= (F.col("v" + a) >= lo) & (F.col("v" + a) < hi)
    return fit


def get_region(blocks: DataFrame, leaf: Triple, region: tuple[Range, Range, Range]) -> DataFrame:
    """Voxels of existing blocks in the region."""
    return to_voxels(touching(blocks, leaf, region), leaf).where(inside(region))


def set_region(blocks: DataFrame, leaf: Triple, region: tuple[Range, Range, Range], value: float, arbors: DataFrame, fill: float = 0.0) -> DataFrame:
    """The volume with a scalar written into a region of each of ``arbors(arbor_id)``.

    Blocks within the region become uniform, blocks that it cuts are rewritten, others stay.
    """
    keys = arbors.select("arbor_id").distinct()
    for a, n, (lo, hi) in zip(AXES, leaf, region, strict=True):
        keys = keys.withColumn("b" + a, F.explode(F.sequence(F.lit(lo // n).cast("bigint"), F.lit((hi - 1) // n).cast("bigint"))))
    whole = F.lit(True)
    for a, n, (lo, hi) in zip(AXES, leaf, region, strict=True):
        whole &= (F.col("b" + a) * n >= lo) & ((F.col("b" + a) + 1) * n <= hi)
    both = blocks.join(shuffled(keys.select(*KEY, F.lit(True).alias("hit"), whole.alias("whole"))), list(KEY), "full")
    n, at = cells(leaf), np.stack(np.indices(leaf).reshape(3, -1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batched.tables(batches, max(1, batched.CELLS // n)):
            hit, covered = (t.column(c).combine_chunks().fill_null(False).to_numpy(zero_copy_only=False) for c in ("hit", "whole"))
            grid, null, dense = _dense(t, n, fill)
            cut, put = hit & ~covered, np.ones((t.num_rows, n), bool)
            for d, (lo, hi) in enumerate(region):
                v = (t.column(KEY[1 + d]).to_numpy() * leaf[d])[:, None] + at[d]
                put &= (v >= lo) & (v < hi)
            put &= cut[:, None]
            grid[put], null[put] = float(value), False
            flat = t.column("uniform").combine_chunks().fill_null(0.0).to_numpy()
            none = np.asarray(t.column("uniform").is_null())
            uniform = pa.array(np.where(covered, float(value), flat), mask=cut | (none & ~covered))
            yield from pa.Table.from_arrays([*[t.column(k) for k in KEY], uniform, _lists(grid, null, cut | (dense & ~covered))], names=[*KEY, "uniform", "data"]).to_batches()

    return both.select(*KEY, "uniform", "data", "hit", "whole").mapInArrow(run, BLOCKS)


def _dense(t: pa.Table, n: int, fill: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of blocks ``uniform, data``, which of them are null, and which blocks have data."""
    data = t.column("data").combine_chunks()
    dense = ~np.asarray(data.is_null())
    grid = np.repeat(t.column("uniform").combine_chunks().fill_null(float(fill)).to_numpy()[:, None], n, axis=1)
    null = np.zeros(grid.shape, bool)
    flat = data.flatten()
    null[dense] = np.asarray(flat.is_null()).reshape(-1, n)
    grid[dense] = flat.fill_null(float(fill)).to_numpy(zero_copy_only=False).reshape(-1, n)
    return grid, null, dense


def _pieces(arrays: DataFrame, leaf: Triple, fill: float) -> DataFrame:
    """``arrays`` cut along blocks and laid over each other as far as they come together: ``KEY, p, s, w``, packed places,
    seqs and values of the voxels on top."""
    n = cells(leaf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            o, s = (np.stack([b.column(m + a).to_numpy() for a in AXES], axis=1).astype(np.int64) for m in "os")
            values, size = b.column("values"), s.prod(axis=1)
            if (np.asarray(pc.fill_null(pc.list_value_length(values), -1)) != size).any():
                raise ValueError("an array has other than sx * sy * sz values")
            flat, ends = values.flatten().fill_null(float(fill)).to_numpy(zero_copy_only=False), np.cumsum(size)
            arbor, seq = b.column("arbor_id").to_numpy(), b.column("seq").to_numpy()
            for lo in range(0, len(flat), batched.PLACES):
                spot = np.arange(lo, min(lo + batched.PLACES, len(flat)))
                row = np.searchsorted(ends, spot, "right")
                local, (sy, sz) = spot - (ends - size)[row], (s[row, 1], s[row, 2])
                v = [local // (sy * sz) + o[row, 0], local // sz % sy + o[row, 1], local % sz + o[row, 2]]
                block = [c // m for c, m in zip(v, leaf, strict=True)]
                p = ((v[0] - block[0] * leaf[0]) * leaf[1] + v[1] - block[1] * leaf[1]) * leaf[2] + v[2] - block[2] * leaf[2]
                # runs of one array in one block are few beside voxels; they tell the blocks
                head = np.flatnonzero(np.logical_or.reduce([np.r_[True, c[1:] != c[:-1]] for c in (row, *block)]))
                names = np.stack([arbor[row[head]], *[c[head] for c in block]], axis=1)
                keys, which = np.unique(names, axis=0, return_inverse=True)
                code = np.repeat(which.reshape(-1), np.diff(np.r_[head, len(row)])) * n + p
                order = np.lexsort((flat[spot], seq[row], code))
                top = order[np.r_[code[order][1:] != code[order][:-1], True]]
                counts = np.bincount(code[top] // n, minlength=len(keys))
                cols = [batched.binaries(x, counts) for x in (p[top].astype(np.int32), seq[row[top]].astype(np.int64), flat[spot[top]])]
                yield from pa.Table.from_arrays([*map(pa.array, keys.T.copy()), *cols], names=[*KEY, "p", "s", "w"]).to_batches()

    some = arrays.where("sx > 0 and sy > 0 and sz > 0").select(F.col("arbor_id").cast("bigint").alias("arbor_id"), *["o" + a for a in AXES], *["s" + a for a in AXES], "values", F.col("seq").cast("bigint").alias("seq"))
    return some.mapInArrow(run, "arbor_id bigint, bx bigint, by bigint, bz bigint, p binary, s binary, w binary")


def _thin(blocks: DataFrame, leaf: Triple, fill: float) -> DataFrame:
    """``KEY, uniform, held, p, w, o``: of blocks with data (``held``) the cells other than ``fill``, packed, ``o`` 0 for a null."""
    n = cells(leaf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batched.tables(batches, max(1, batched.CELLS // n)):
            grid, null, dense = _dense(t, n, fill)
            kept = dense[:, None] & ((grid != fill) | null)
            counts, spot = kept.sum(axis=1), np.nonzero(kept)[1].astype(np.int32)
            cols = [batched.binaries(x, counts) for x in (spot, grid[kept], (~null[kept]).astype(np.int8))]
            yield from pa.Table.from_arrays([*[t.column(k) for k in KEY], t.column("uniform"), pa.array(dense), *cols], names=[*KEY, "uniform", "held", "p", "w", "o"]).to_batches()

    return blocks.select(*KEY, "uniform", "data").mapInArrow(run, "arbor_id bigint, bx bigint, by bigint, bz bigint, uniform double, held boolean, p binary, w binary, o binary")


def set_arrays(blocks: DataFrame, leaf: Triple, arrays: DataFrame, fill: float = 0.0) -> DataFrame:
    """The volume with ``arrays(arbor_id, ox, oy, oz, sx, sy, sz, values, seq)`` written at their offsets.

    ``values`` are in C order.  Where arrays overlap the greatest ``seq`` stands, of equal ones the greater value;
    null values count as ``fill``, an array of another length raises, one without a voxel writes nothing.
    Blocks that no array meets stay as they are; missing ones are filled first.

    Arrays are cut along blocks and laid over each other in ``batched.PLACES`` voxels at a time, so that of each the block
    gets at most its own size; these layers and the cells of old blocks other than ``fill`` are shuffled, packed.
    """
    n = cells(leaf)
    old = _thin(blocks, leaf, fill).select(*KEY, F.lit(0).alias("kind"), "uniform", "held", "p", F.lit(None).cast("binary").alias("s"), "w", "o")
    new = _pieces(arrays, leaf, fill).select(*KEY, F.lit(1), F.lit(None).cast("double"), F.lit(None).cast("boolean"), "p", "s", "w", F.lit(None).cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, begin, group in batched.groups(batches, KEY, max(1, batched.CELLS // n)):
            kind, many = t.column("kind").to_numpy(), len(begin)
            olds, news = t.filter(pa.array(kind == 0)), t.filter(pa.array(kind == 1))
            own, group = group[kind == 0], group[kind == 1]
            uniform, none = np.full(many, float(fill)), np.ones(many, bool)
            none[own] = np.asarray(olds.column("uniform").is_null())
            uniform[own] = olds.column("uniform").combine_chunks().fill_null(float(fill)).to_numpy()
            held = np.zeros(many, bool)
            held[own] = olds.column("held").combine_chunks().to_numpy(zero_copy_only=False)
            grid, null = np.repeat(uniform, n), np.zeros(many * n, bool)
            spot, counts = batched.values_of(olds.column("p"), "i4")
            at = np.repeat(own, counts) * n + spot
            grid[at], null[at] = batched.values_of(olds.column("w"), "f8")[0], batched.values_of(olds.column("o"), "i1")[0] == 0
            spot, counts = batched.values_of(news.column("p"), "i4")
            at, w = np.repeat(group, counts) * n + spot, batched.values_of(news.column("w"), "f8")[0]
            order = np.lexsort((w, batched.values_of(news.column("s"), "i8")[0], at))
            top = order[np.r_[at[order][1:] != at[order][:-1], True]] if len(order) else order
            grid[at[top]], null[at[top]] = w[top], False
            hit = np.zeros(many, bool)
            hit[group] = True
            grid, null = grid.reshape(-1, n), null.reshape(-1, n)
            same = hit & _alike(grid, null)
            keys = [pa.array(t.column(k).to_numpy()[begin]) for k in KEY]
            out = [pa.array(np.where(same, grid[:, 0], uniform), mask=~same & (hit | none)), _lists(grid, null, np.where(hit, ~same, held))]
            yield pa.RecordBatch.from_arrays([*keys, *out], names=[*KEY, "uniform", "data"])

    return batched.together(old.union(new), *KEY).mapInArrow(run, BLOCKS)


def populated(blocks: DataFrame, keys: DataFrame, populate: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """Blocks for all of ``keys(arbor_id, bx, by, bz)``; missing ones are uniform by ``populate(bx, by, bz)``."""
    name = ["arbor_id", "bx", "by", "bz"]
    new = keys.select(*name).distinct().join(blocks.select(*name), name, "left_anti")
    value = populate(*[F.col("b" + a) for a in AXES]).cast("double")
    return blocks.select(*name, "uniform", "data").union(new.select(*name, value, F.lit(None).cast("array<double>")))


def z_order(bits: int = 20, shift: int = 1 << 19) -> Column:
    """Octant order of blocks: interleaved bits, x highest.  A block beyond ``bits`` an axis is an error."""
    inside = lambda c: F.when((c >= 0) & (c < 1 << bits), c).otherwise(F.raise_error(F.lit("a block is too far out for octant order")).cast("bigint"))
    at = [inside(F.col("b" + a) + shift) for a in AXES]
    out = F.lit(0).cast("bigint")
    for b in range(bits):
        for d, c in enumerate(at):
            bit = F.shiftright(c, b).bitwiseAND(F.lit(1).cast("bigint"))
            out = out + F.shiftleft(bit, 3 * b + 2 - d)
    return out


def leaves(blocks: DataFrame) -> DataFrame:
    """Blocks with data, with ``z`` to sort them by in octant order."""
    return blocks.where("data is not null").withColumn("z", z_order())


def leaf_bounds(blocks: DataFrame, leaf: Triple, clip: tuple[Range, Range, Range] | None = None) -> DataFrame:
    """Per arbor the voxel box of all blocks, clipped."""
    sides = []
    for d, (a, n) in enumerate(zip(AXES, leaf, strict=True)):
        lo, hi = F.min("b" + a) * n, (F.max("b" + a) + 1) * n
        if clip:
            lo, hi = F.greatest(lo, F.lit(clip[d][0])), F.least(hi, F.lit(clip[d][1]))
        sides += [lo.cast("bigint").alias(f"lo_{a}"), hi.cast("bigint").alias(f"hi_{a}")]
    return blocks.groupBy("arbor_id").agg(*sides)


def mapped(blocks: DataFrame, leaf_map: Callable[[Column], Column], uniform_map: Callable[[Column], Column] | None = None) -> DataFrame:
    """A copy with every value mapped."""
    return blocks.select("arbor_id", "bx", "by", "bz", (uniform_map or leaf_map)(F.col("uniform")).alias("uniform"), F.transform("data", leaf_map).alias("data"))


def fullness(blocks: DataFrame, leaf: Triple, bounds: tuple[Range, Range, Range]) -> DataFrame:
    """Per arbor, blocks that exist over blocks that the bounds could hold."""
    most = 1
    for n, (lo, hi) in zip(leaf, bounds, strict=True):
        most *= -(-(hi - lo) // n)
    return blocks.groupBy("arbor_id").agg((F.count(F.lit(1)) / most).alias("fullness"))


def intersection(a: tuple[Range, ...], b: tuple[Range, ...]) -> tuple[Range, ...] | None:
    out = tuple((max(p, r), min(q, s)) for (p, q), (r, s) in zip(a, b, strict=True))
    return out if all(p < q for p, q in out) else None


def edge_length(leaf: Triple, extent: Triple) -> int:
    """Side of the cube of blocks that holds the extent: the greatest leaf side times a power of two."""
    import math

    return max(n * 2 ** max(0, math.ceil(math.log2(e / n))) for n, e in zip(leaf, extent, strict=True))


def confidence_bytes(voxels: DataFrame, incr_denom: float) -> DataFrame:
    """``arbor_id, vx, vy, vz, value``: confidence as whole numbers to 255, truncated, where a distance is known."""
    share = F.col("seg_count") / (F.col("view_count") + F.lit(float(incr_denom)))
    return voxels.where("distance is not null").select("arbor_id", "vx", "vy", "vz", F.floor(255 * share).cast("smallint").alias("value"))
