"""Distances, boxes and neighbourhoods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taproot.operators.lineage import stored
from taproot.operators.topology import neighbours

AXES = ("x", "y", "z")
DEPTH = 28  # bits of a coordinate in the pyramid of cells
LEAF = 64  # nodes of a cell that isn't cut further, unless it is of the last level


def squared(a: str, b: str) -> Column:
    """Squared distance between points of column prefixes ``a`` and ``b``."""
    return sum((F.col(a + c) - F.col(b + c)) * (F.col(a + c) - F.col(b + c)) for c in AXES)


def bounds(nodes: DataFrame) -> DataFrame:
    """Per arbor, the box of its centres, each side truncated to a whole number."""
    sides = [f(c).cast("bigint").alias(f"{m}_{c}") for m, f in (("lo", F.min), ("hi", F.max)) for c in AXES]
    return nodes.groupBy("arbor_id").agg(*sides)


def node_bounds(nodes: DataFrame, fov: tuple[int, int, int]) -> DataFrame:
    """The box [c - fov // 2, c + fov // 2 + 1) about each centre."""
    lo = [(F.col(c) - n // 2).alias(f"lo_{c}") for c, n in zip(AXES, fov, strict=True)]
    hi = [(F.col(c) + n // 2 + 1).alias(f"hi_{c}") for c, n in zip(AXES, fov, strict=True)]
    return nodes.select("arbor_id", "nid", *lo, *hi)


def region_bounds(nodes: DataFrame, fov: tuple[int, int, int]) -> DataFrame:
    """Per arbor, its box widened by the field of view: [lo - fov // 2, hi + fov // 2 + 1)."""
    b = bounds(nodes)
    lo = [(F.col(f"lo_{c}") - n // 2).alias(f"lo_{c}") for c, n in zip(AXES, fov, strict=True)]
    hi = [(F.col(f"hi_{c}") + n // 2 + 1).alias(f"hi_{c}") for c, n in zip(AXES, fov, strict=True)]
    return b.select("arbor_id", *lo, *hi)


def transformed(nodes: DataFrame, shift: tuple[float, float, float], scale: tuple[float, float, float]) -> DataFrame:
    """Centres moved by ``shift`` and then scaled."""
    moved = {c: (F.col(c) + float(t)) * float(s) for c, t, s in zip(AXES, shift, scale, strict=True)}
    return nodes.withColumns(moved)


def angle(a: list[Column], b: list[Column]) -> Column:
    """The angle between two vectors, its cosine clipped to [-1, 1]; null for a zero vector."""
    dot = sum(p * q for p, q in zip(a, b, strict=True))
    sizes = F.sqrt(sum(p * p for p in a)) * F.sqrt(sum(q * q for q in b))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / F.nullif(sizes, F.lit(0.0)))))


def distance(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(sum((p - q) * (p - q) for p, q in zip(a, b, strict=True)))


def _key(c: str, level: int) -> Column:
    """A node's cell of a level: 2 bits an axis and level."""
    return F.concat(*[F.lpad(F.hex(F.shiftright(c + k, DEPTH - level)), 8, "0") for k in "xyz"])


def _pyramid(spots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells with the boxes of what they hold, and nodes with the cell they are leaves of.

    A cell of over ``LEAF`` nodes is cut into 64, level by level, and only its nodes go on.
    """
    box = [f("n" + c).alias(m + c) for m, f in (("lo", F.min), ("hi", F.max)) for c in AXES]
    size = F.greatest(*[F.col("hi" + c) - F.col("lo" + c) for c in AXES])
    scaled = [F.floor(F.least(F.lit(float(2**DEPTH - 1)), (F.col("n" + c) - F.col("lo" + c)) / F.col("size") * 2.0**DEPTH)).cast("bigint").alias("g" + c) for c in AXES]
    whole = spots.groupBy("arbor_id").agg(*box).select("*", F.nullif(size, F.lit(0.0)).alias("size"))
    left = spots.join(whole, "arbor_id").select(*spots.columns, *[F.coalesce(c, F.lit(0)).alias("g" + k) for c, k in zip(scaled, AXES, strict=True)])
    left = left.withColumn("above", F.lit("").cast("string"))
    cells, leaves = [], []
    for level in range(0, DEPTH + 1, 2):
        keyed = left.withColumn("cell", F.concat(F.lit(f"{level:02d}:"), _key("g", level)))
        held = stored(keyed.groupBy("arbor_id", "above", "cell").agg(F.count(F.lit(1)).alias("n"), *box).withColumn("leaf", (F.col("n") <= LEAF) | F.lit(level == DEPTH)))
        cells.append(held.drop("n"))
        sized = stored(keyed.drop("above").join(held.select("arbor_id", "cell", "leaf"), ["arbor_id", "cell"]))
        leaves.append(sized.where("leaf").select("arbor_id", "cell", *spots.columns[1:]))
        left = sized.where("not leaf").drop("leaf").withColumnRenamed("cell", "above")
        if left.isEmpty():
            break
    return reduce(DataFrame.union, cells), reduce(DataFrame.union, leaves)


def closest(nodes: DataFrame, places: DataFrame) -> DataFrame:
    """For each of ``places(arbor_id, px, py, pz)`` the nearest node, of equally near ones the least id.

    ``arbor_id, px, py, pz, nid, distance``.  A place descends a pyramid of cells and keeps, level by level, those
    that may hold its nearest node: none whose box is farther than another's farthest corner.  Only the nodes of
    the leaves that remain are compared.  Nodes and places that lack a coordinate take no part; a place
    whose arbor has no node gets no row.
    """
    real = lambda m: reduce(lambda a, b: a & b, [F.col(m + c).isNotNull() & ~F.isnan(F.col(m + c).cast("double")) for c in AXES])
    spots = nodes.where(real("")).groupBy("arbor_id", *[F.col(c).alias("n" + c) for c in AXES]).agg(F.min("nid").alias("nid"))
    cells, leaves = _pyramid(spots)
    place = ["arbor_id", "px", "py", "pz"]
    none = F.lit(0.0)
    gap = sum(F.pow(F.greatest(F.col("lo" + c) - F.col("p" + c), F.col("p" + c) - F.col("hi" + c), none), 2.0) for c in AXES)
    far = sum(F.pow(F.greatest(F.abs(F.col("p" + c) - F.col("lo" + c)), F.abs(F.col("hi" + c) - F.col("p" + c))), 2.0) for c in AXES)
    bound = F.min("far").over(Window.partitionBy(*place))
    asked = places.where(real("p")).select(*place).distinct()
    kept, open_ = [], asked.withColumn("above", F.lit("")).withColumn("limit", F.lit(float("inf")))
    for _ in range(0, DEPTH + 1, 2):
        met = open_.join(cells, ["arbor_id", "above"]).select(*place, "cell", "leaf", "limit", gap.alias("gap"), far.alias("far"))
        met = met.withColumn("limit", F.least("limit", bound))
        met = stored(met.where(F.col("gap") <= F.col("limit") * (1 + 1e-9) + 1e-9).select(*place, "cell", "leaf", "limit", "gap"))
        kept.append(met.where("leaf").select(*place, "cell", "gap", "limit"))
        open_ = met.where("not leaf").select(*place, F.col("cell").alias("above"), "limit")
        if open_.isEmpty():
            break
    # a leaf kept early goes if a later level found something nearer
    last = F.min("limit").over(Window.partitionBy(*place))
    left = reduce(DataFrame.union, kept).withColumn("limit", last).where(F.col("gap") <= F.col("limit") * (1 + 1e-9) + 1e-9)
    both = left.select(*place, "cell").join(leaves, ["arbor_id", "cell"]).withColumn("d2", squared("n", "p"))
    best = both.groupBy(*place).agg(F.min(F.struct("d2", "nid")).alias("b"))
    return best.select(*place, F.col("b.nid").alias("nid"), F.sqrt("b.d2").alias("distance"))


def _flood(nodes: DataFrame, starts: DataFrame, near: Column, sides: tuple[float, ...]) -> DataFrame:
    """Connected nodes about each start for which ``near`` holds; the start's neighbours always are.

    ``near`` never holds beyond ``sides``, so candidates come from cells of that size.  Of a start's candidates those
    are connected that have the same topmost node, going up through candidates alone; pointers to it are
    doubled, which takes as many joins as the logarithm of the deepest way.  A cycle of parents raises.
    """
    own, key = ["arbor_id", "start"], ["arbor_id", "start", "nid"]
    at = nodes.select("arbor_id", "nid", *[F.col(c).alias("n" + c) for c in AXES])
    cell = lambda m: [F.floor(F.col(m + c) / (r * (1 + 1e-9) or 1.0)).cast("bigint") for c, r in zip(AXES, sides, strict=True)]
    origin = starts.select("arbor_id", F.col("nid").alias("start")).distinct()
    here = at.select("arbor_id", F.col("nid").alias("start"), *[F.col("n" + c).alias("s" + c) for c in AXES])
    origin = stored(origin.join(here, own))
    spread = origin
    for c, k in zip(AXES, cell("s"), strict=True):
        spread = spread.withColumn("c" + c, F.explode(F.array(k - 1, k, k + 1)))
    placed = at.select("*", *[k.alias("c" + c) for c, k in zip(AXES, cell("n"), strict=True)])
    within = placed.join(spread, ["arbor_id", *["c" + c for c in AXES]]).where(near).select(*key)
    beside = neighbours(nodes).where("nid <> other").withColumnRenamed("nid", "start").join(origin.select(*own), own).select(*own, F.col("other").alias("nid"))
    found = within.union(beside).union(origin.select(*own, F.col("start").alias("nid"))).distinct()
    up = nodes.where("pid is not null and pid <> nid").select("arbor_id", "nid", "pid")
    found = stored(found.join(up, ["arbor_id", "nid"], "left").select(*key, "pid"))
    parent = found.select(*own, F.col("nid").alias("pid"), F.lit(True).alias("there"))
    state = stored(found.join(parent, [*own, "pid"], "left").select(*key, F.when(F.col("there"), F.col("pid")).alias("up"), F.col("nid").alias("top")))
    for _ in range(64):
        if state.where("up is not null").isEmpty():
            mine = state.where("nid = start").select(*own, "top")
            return state.join(mine, [*own, "top"]).select(*key)
        there = state.select(*own, F.col("nid").alias("up"), F.col("up").alias("up2"), F.col("top").alias("top2"))
        moved = state.where("up is not null").join(there, [*own, "up"]).select(*key, F.col("up2").alias("up"), F.col("top2").alias("top"))
        state = stored(moved.union(state.where("up is null")))
    raise ValueError("parents of the nodes go round in a cycle")


def radius(nodes: DataFrame, starts: DataFrame, reach: float | tuple[float, float, float]) -> DataFrame:
    """``arbor_id, start, nid``: what is connected to each start within ``reach`` of it.

    One number is a Euclidean radius, strict; three are bounds per axis, inclusive.  Direct
    neighbours of the start always belong to it.
    """
    sides = (reach,) if isinstance(reach, (int, float)) else tuple(reach)
    if len(sides) == 1:
        near = squared("n", "s") < float(sides[0]) ** 2
    else:
        near = F.lit(True)
        for c, r in zip(AXES, sides, strict=True):
            near &= F.abs(F.col("n" + c) - F.col("s" + c)) <= float(r)
    return _flood(nodes, starts, near, tuple(map(float, sides * 3 if len(sides) == 1 else sides)))


def constrained_radius(nodes: DataFrame, starts: DataFrame, dx: int, dy: int, dz: int) -> DataFrame:
    """As ``radius`` with three bounds, offsets truncated to whole numbers first."""
    near = F.lit(True)
    for c, r in zip(AXES, (dx, dy, dz), strict=True):
        near &= F.abs((F.col("n" + c) - F.col("s" + c)).cast("bigint")) <= int(r)
    return _flood(nodes, starts, near, (float(dx) + 1, float(dy) + 1, float(dz) + 1))


def around(nodes: DataFrame, group: DataFrame, reach: float) -> DataFrame:
    """``arbor_id, nid`` of all nodes within ``reach`` per axis (strict) of any node of ``group``.

    Connection plays no part.  Space is cut into cells of that size, so the join is on cells: the
    group's nodes are spread over their 27 cells and made distinct.
    """
    cell = lambda c: F.floor(F.col(c) / float(reach)).cast("bigint")
    g = nodes.join(group.select("arbor_id", "nid"), ["arbor_id", "nid"], "left_semi")
    g = g.select("arbor_id", *[F.col(c).alias("g" + c) for c in AXES]).distinct()
    offsets = F.explode(F.transform(F.sequence(F.lit(0), F.lit(26)), lambda i: F.struct((i % 3 - 1).alias("x"), (F.floor(i / 3) % 3 - 1).alias("y"), (F.floor(i / 9) - 1).alias("z"))))
    g = g.withColumn("o", offsets).select("arbor_id", *["g" + c for c in AXES], *[(cell("g" + c) + F.col("o")[c]).alias("c" + c) for c in AXES])
    n = nodes.select("arbor_id", "nid", *[F.col(c).alias("n" + c) for c in AXES], *[cell(c).alias("c" + c) for c in AXES])
    near = F.lit(True)
    for c in AXES:
        near &= F.abs(F.col("n" + c) - F.col("g" + c)) < float(reach)
    return n.join(g, ["arbor_id", *["c" + c for c in AXES]]).where(near).select("arbor_id", "nid").distinct()
