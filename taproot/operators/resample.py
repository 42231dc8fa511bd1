"""Even spacing of nodes along segments.

New nodes are where spheres of radius ``delta`` cross a segment's line: each sphere is about the last new node.
A batch of arbors is walked in lockstep, all its segments at once, in numpy; crossings are roots of a quadratic.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taproot import schemas
from taproot.operators.arrow import by_arbor
from taproot.operators.topology import segments

RESAMPLED = schemas.NODES + ", origin bigint"
NEAR_END = 1.5  # a walk goes straight to the end from within so many deltas of it
PAIRS = 1 << 20  # candidates for an origin that are held at once


def gaussian(values: np.ndarray, sigma: float) -> np.ndarray:
    """A Gaussian filter along the first axis; ends are carried on, the kernel is cut at four sigma."""
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2) if sigma > 0 else np.ones(1)
    w /= w.sum()
    wide = np.pad(values, ((r, r), (0, 0)), mode="edge")
    return np.stack([np.convolve(wide[:, c], w, mode="valid") for c in range(values.shape[1])], axis=1)


def dense_line(points: np.ndarray, delta: float, sigma: float, smoothing: str) -> np.ndarray:
    """The corners of the line that a segment's new nodes lie on.

    Without smoothing these are its points.  Smoothed, they are taken evenly in the points' numbering, four a point
    and ten a ``delta`` of length at least, and filtered with a width of ``sigma`` of their number; the true ends come
    before and after, as smoothing moves the ends.
    """
    if smoothing not in ("none", "gaussian"):
        raise ValueError(f"smoothing {smoothing!r} is neither none nor gaussian")
    if smoothing == "none":
        return points
    length = np.sqrt((np.diff(points, axis=0) ** 2).sum(axis=1)).sum()
    count = max(4 * len(points), 10 * int(np.ceil(length / delta)), 10)
    spots = np.linspace(0, len(points) - 1, count)
    lower = np.minimum(spots.astype(np.int64), max(len(points) - 2, 0))
    share = (spots - lower)[:, None]
    even = points[lower] * (1 - share) + points[np.minimum(lower + 1, len(points) - 1)] * share
    return np.vstack([points[:1], gaussian(even, count * sigma), points[-1:]])


def walked(line: np.ndarray, first: np.ndarray, last: np.ndarray, delta: float) -> tuple[np.ndarray, np.ndarray]:
    """New points of many lines at once and the line of each, in order along the lines.

    Line s has the corners ``line[first[s]:last[s] + 1]``.  Its points are ``delta`` apart, in a straight line, until the
    end is nearer than 1.5 ``delta``; then comes the end, so all gaps are within 0.5 and 1.5 ``delta``.  A line's beginning
    isn't among its points, nor is its end if it is where the walk stands.  One that ends near where it begins has
    only its end.
    """
    edge, at, end = first.copy(), line[first].copy(), line[last]
    whose, points, order = [], [], []
    live, step = np.arange(len(first)), 0
    square = lambda v: v[:, 0] * v[:, 0] + v[:, 1] * v[:, 1] + v[:, 2] * v[:, 2]
    fresh = live
    while True:
        # only a walk that has moved can have come near its end
        done = fresh[square(end[fresh] - at[fresh]) < NEAR_END * NEAR_END * delta * delta]
        if len(done):
            apart = done[square(end[done] - at[done]) > 1e-12 * (1 + square(end[done]))]
            whose.append(apart), points.append(end[apart]), order.append(np.full(len(apart), step))
            gone = np.zeros(len(first), bool)
            gone[done] = True
            live = live[~gone[live]]
        if not len(live):
            break
        beyond = square(line[edge[live] + 1] - at[live]) >= delta * delta
        edge[live[~beyond]] += 1
        fresh = live[beyond]
        if len(fresh):
            a, d = line[edge[fresh]] - at[fresh], line[edge[fresh] + 1] - line[edge[fresh]]
            dd, ad, aa = square(d), a[:, 0] * d[:, 0] + a[:, 1] * d[:, 1] + a[:, 2] * d[:, 2], square(a)
            u = (np.sqrt(ad * ad - dd * (aa - delta * delta)) - ad) / dd
            at[fresh] = line[edge[fresh]] + u[:, None] * d
            whose.append(fresh), points.append(at[fresh]), order.append(np.full(len(fresh), step))
        step += 1
    if not whose:
        return np.empty(0, np.int64), np.empty((0, 3))
    which, spots = np.concatenate(whose), np.concatenate(points)
    by = np.lexsort((np.concatenate(order), which))
    return which[by], spots[by]


def _below(group: np.ndarray, x: np.ndarray, asked: np.ndarray, value: np.ndarray, equal: bool) -> np.ndarray:
    """Per question how many rows of (group, x) come before (asked, value), those equal to it included or not."""
    rank = np.concatenate([np.zeros(len(x), np.int8), np.full(len(value), 1 if equal else -1, np.int8)])
    by = np.lexsort((rank, np.concatenate([x, value]), np.concatenate([group, asked])))
    seen = np.cumsum(by < len(x))
    out = np.empty(len(by), np.int64)
    out[by] = seen
    return out[len(x):]


def nearest(xyz: np.ndarray, group: np.ndarray, points: np.ndarray, whose: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """Per point the row of its group that is nearest, of equally near ones the first.

    ``group`` ascends.  No row can be nearer than ``guess``'s unless its x is within that distance, so only such rows
    are compared; as many points at a time as have ``PAIRS`` of them.
    """
    by = np.lexsort((xyz[:, 0], group))
    reach = np.sqrt(((xyz[guess] - points) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-9
    low = _below(group[by], xyz[by, 0], whose, points[:, 0] - reach, False)
    high = _below(group[by], xyz[by, 0], whose, points[:, 0] + reach, True)
    sizes = np.cumsum(high - low)
    out, start = np.empty(len(points), np.int64), 0
    while start < len(points):
        base = sizes[start - 1] if start else 0
        stop = max(int(np.searchsorted(sizes, base + PAIRS, "right")), start + 1)
        n = (high - low)[start:stop]
        owner = np.repeat(np.arange(stop - start), n)
        row = by[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[start:stop], n)]
        d = points[start:stop][owner] - xyz[row]
        square = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]
        best = np.lexsort((row, square, owner))
        out[start:stop] = row[best[np.cumsum(n) - n]]
        start = stop
    return out


def resampled(indexed: DataFrame, delta: float, sigma: float = 0.05, smoothing: str = "none") -> DataFrame:
    """``arbor_id, nid, pid, x, y, z, origin``: every segment of each tree at a spacing of about ``delta``.

    New ids count from 0 at the root, segment by segment in order.  A segment begins at the new id of
    its first node; one that emits no point passes that id on to its tail.  ``origin`` is the nearest
    old node of the segment, the first of equally near ones.  A tree of one node stays as it is.
    """
    if not delta > 0:
        raise ValueError("delta is not above 0")
    rows = segments(indexed).join(indexed.select("arbor_id", "nid", "x", "y", "z"), ["arbor_id", "nid"])
    roots = indexed.where("pid is null").select("arbor_id", F.lit(-1).cast("bigint").alias("seg_id"), F.lit(0).alias("pos"), "nid", "x", "y", "z")
    both = rows.select("arbor_id", "seg_id", "pos", "nid", "x", "y", "z").union(roots)

    def run(t: pa.Table) -> pa.Table:
        arbor, seg, nid = (t.column(c).to_numpy() for c in ("arbor_id", "seg_id", "nid"))
        xyz = np.stack([t.column(c).to_numpy() for c in "xyz"], axis=1)
        begin = np.r_[0, np.flatnonzero((arbor[1:] != arbor[:-1]) | (seg[1:] != seg[:-1])) + 1]
        tail = np.r_[begin[1:], len(seg)] - 1
        is_root = seg[begin] < 0
        # a root is a line of one corner: it has no edge, and its walk ends where it begins
        if smoothing == "none":
            line, first, last = xyz, begin, tail
        else:
            lines = [xyz[s : e + 1] if r else dense_line(xyz[s : e + 1], delta, sigma, smoothing) for s, e, r in zip(begin, tail, is_root, strict=True)]
            last = np.cumsum([len(x) for x in lines]) - 1
            line, first = np.concatenate(lines), np.r_[0, last[:-1] + 1]
        whose, points = walked(line, first, last, delta)
        count = np.bincount(whose, minlength=len(begin))
        place = np.arange(len(whose)) - (np.cumsum(count) - count)[whose]
        share = (place + 1) / count[whose]
        guess = begin[whose] + np.rint(share * (tail - begin)[whose]).astype(np.int64)
        group = np.repeat(np.arange(len(begin)), tail - begin + 1)
        origin = nid[nearest(xyz, group, points, whose, guess)]

        # ids go on from one segment to the next; a segment's first point hangs from its first node's new id
        emitted = np.cumsum(count) - count
        root_row = np.maximum.accumulate(np.where(is_root, np.arange(len(begin)), 0))
        offset = 1 + emitted - emitted[root_row]
        above, names = np.zeros(len(begin), np.int64), {}
        for s in range(len(begin)):
            if is_root[s]:
                names = {nid[begin[s]]: 0}
            else:
                above[s] = names[nid[begin[s]]]
                names[nid[tail[s]]] = offset[s] + count[s] - 1 if count[s] else above[s]
        new = offset[whose] + place
        parent = np.where(place == 0, above[whose], new - 1)
        r = begin[is_root]
        spots = np.concatenate([xyz[r], points])
        no_parent = np.r_[np.ones(len(r), bool), np.zeros(len(new), bool)]
        return pa.table({
            "arbor_id": pa.array(np.r_[arbor[r], arbor[begin[whose]]], pa.int64()),
            "nid": pa.array(np.r_[np.zeros(len(r), np.int64), new], pa.int64()),
            "pid": pa.array(np.r_[np.zeros(len(r), np.int64), parent], pa.int64(), mask=no_parent),
            **{c: pa.array(spots[:, k], pa.float64()) for k, c in enumerate("xyz")},
            "origin": pa.array(np.r_[nid[r], origin], pa.int64()),
        })

    return by_arbor(both, run, RESAMPLED, order=("seg_id", "pos"))
