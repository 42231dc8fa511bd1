"""Near-duplicate vectors by spherical-cap filters from a structured random product code."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from taproot.llm.common import F, blocked, components, loosened, runs, written

BLOCK = 1024


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def both_tails(z: float, rho: float) -> float:
    """P(y >= z | x >= z) for standard normals of correlation ``rho``."""
    x = np.linspace(z, z + 8, 4001)
    w = np.exp(-x * x / 2)
    y = np.array([normal_tail((z - rho * v) / math.sqrt(1 - rho * rho)) for v in x])
    return float((w * y).sum() / w.sum())


@dataclass(frozen=True)
class CapCode:
    """Filter directions (c1, .., cm) / sqrt(m), one code word of each of ``m`` blocks.

    A vector passes a filter when their inner product is ``alpha`` or more.  A random rotation
    first spreads every vector's mass over the blocks.  The code is a function of its numbers.
    """

    dim: int
    blocks: int
    words: int
    alpha: float
    seed: int = 23

    def parts(self) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        r = np.random.default_rng((self.seed, self.dim, self.blocks, self.words))
        rotation, _ = np.linalg.qr(r.normal(size=(self.dim, self.dim)))
        cuts = [self.dim * k // self.blocks for k in range(self.blocks + 1)]
        codes = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            c = r.normal(size=(self.words, b - a))
            codes.append(c / np.linalg.norm(c, axis=1, keepdims=True) / math.sqrt(self.blocks))
        return rotation, codes, r.normal(size=(self.dim, 128))

    def passed(self, x: np.ndarray, ready: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``x`` and the filters that they pass, as two arrays."""
        rotation, words, _ = ready
        y, at, scores = x @ rotation, 0, []
        for c in words:
            scores.append(y[:, at : at + c.shape[1]] @ c.T)
            at += c.shape[1]
        return self.decoded(scores)

    def decoded(self, scores: list[np.ndarray], most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
        """All filters whose block scores sum to ``alpha`` or more, for each row of the scores.

        Blocks are taken one by one; a partial choice is kept only while the best that the blocks
        left can add would still lift it over ``alpha``.  At most ``most`` sums are looked at at once.
        """
        n = len(scores[0])
        left = [np.zeros(n)]
        for s in reversed(scores[1:]):
            left.append(left[-1] + s.max(axis=1))
        rows, ids, sums = np.arange(n), np.zeros(n, np.int64), np.zeros(n)
        for s, more in zip(scores, left[::-1], strict=True):
            parts = []
            step = max(1, most // s.shape[1])
            for at in range(0, len(rows), step):
                here = slice(at, at + step)
                total = sums[here, None] + s[rows[here]]
                i, j = np.nonzero(total + more[rows[here], None] >= self.alpha)
                parts.append((rows[here][i], ids[here][i] * self.words + j, total[i, j]))
            rows, ids, sums = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (rows, ids, sums)
        return rows, ids

    def decode(self, scores: list[np.ndarray]) -> np.ndarray:
        """``decoded`` for one vector."""
        return self.decoded([s[None, :] for s in scores])[1]


def fitting(dim: int, rows: int, cosine: float, miss: float = 1e-5, most_words: int = 1 << 16) -> list[CapCode]:
    """Independent product codes for ``rows`` vectors of length ``dim``.

    A cap passes about 8 vectors, however many there are.  Filters of a product code go together, so the
    chance that a pair at ``cosine`` shares none of one code is measured on random pairs, and as many
    codes are taken as bring it under ``miss``.  How many filters of a code such a pair shares on average
    is chosen so that a vector passes the fewest filters in all.
    """
    share = min(1e-2, 8 / max(rows, 1))
    lo, hi = 0.0, 12.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if normal_tail(mid) > share else (lo, mid)
    cosine = min(cosine, 0.999)
    r, trials = np.random.default_rng(29), 1000
    x, g = r.normal(size=(2, trials, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if dim > 1:
        g -= (g * x).sum(axis=1, keepdims=True) * x
        g /= np.linalg.norm(g, axis=1, keepdims=True)
    y = cosine * x + math.sqrt(1 - cosine * cosine) * g
    best: tuple[float, list[CapCode]] | None = None
    for shared in (0.25, 0.5, 1.0, 2.0, 4.0, 8.0):
        filters = shared / both_tails(lo, cosine) / share
        blocks = 1 if dim < 4 else max(2, math.ceil(math.log(max(filters, 2)) / math.log(most_words)))
        one = CapCode(dim, min(blocks, dim), max(2, math.ceil(filters ** (1 / blocks))), lo / math.sqrt(dim))
        ready = one.parts()
        mine, theirs = (set(zip(*(c.tolist() for c in one.passed(z, ready)), strict=True)) for z in (x, y))
        none = trials - len({k for k, _ in mine & theirs})
        if none > 0.95 * trials:
            continue
        codes = max(1, math.ceil(math.log(miss) / math.log(min(0.99, (none + 2 * math.sqrt(none) + 3) / trials))))
        # a filter costs a row; a code word costs a product, which is some 500 times cheaper
        cost = codes * (one.words**one.blocks * share + one.words * one.blocks / 500)
        if best is None or cost < best[0]:
            best = cost, [CapCode(dim, one.blocks, one.words, one.alpha, one.seed + k) for k in range(codes)]
    return best[1]


def vectors(table: DataFrame, key: str = "vec_id", column: str = "embedding", label: str = "label") -> DataFrame:
    """``id, label, class, v``; ``class`` names label and vector, null where nothing can be linked."""
    kind, tag = table.schema[key].dataType.simpleString(), table.schema[label].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, out = [], []
            for x, g in zip(batch.column(2), batch.column(1), strict=True):
                v = x.as_py()
                if v is None or not v or g.as_py() is None or None in v:
                    cls.append(None)
                    out.append(None)
                    continue
                a = np.array(v, np.float64) + 0.0
                top = np.abs(a).max()
                if not np.isfinite(top) or top == 0:
                    cls.append(None)
                    out.append(None)
                    continue
                cls.append(hashlib.blake2b(f"{g.as_py()}|".encode() + (a + 0.0).tobytes(), digest_size=16).digest())
                a = a / top
                out.append(a / np.sqrt(a @ a))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cls, pa.binary()), pa.array(out, pa.list_(pa.float64()))],
                names=["id", "label", "class", "v"],
            )

    picked = table.select(F.col(key).alias("id"), F.col(label).alias("label"), column)
    return picked.mapInArrow(run, f"id {kind}, label {tag}, class binary, v array<double>")


def filtered(reps: DataFrame, codes: dict[int, list[CapCode]]) -> DataFrame:
    """``bucket, rep, s0, s1``: a row for each filter a vector passes, with a sign sketch of 128 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = {d: [(c, c.parts()) for c in some] for d, some in codes.items()}
        tags: dict[tuple, int] = {}

        def tag_of(label, d: int) -> int:
            if (label, d) not in tags:
                tags[label, d] = int.from_bytes(hashlib.blake2b(f"{label}|{d}".encode(), digest_size=8).digest(), "little")
            return tags[label, d]

        for batch in batches:
            rep, label, v = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist(), batch.column(2)
            sizes = v.value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(sizes).tolist():
                for at in range(0, batch.num_rows, 1024):
                    some = np.flatnonzero(sizes[at : at + 1024] == d) + at
                    if not len(some):
                        continue
                    x = v.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                    own = np.array([tag_of(label[k], d) for k in some.tolist()], np.uint64)
                    signs = np.packbits((x @ ready[d][0][1][2]) > 0, axis=1).view(np.int64)
                    for k, (code, parts) in enumerate(ready[d]):
                        rows, ids = code.passed(x, parts)
                        bucket = ((ids * len(ready[d]) + k).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ own[rows]
                        cols = [bucket.view(np.int64), rep[some][rows], signs[rows, 0], signs[rows, 1]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["bucket", "rep", "s0", "s1"])

    return reps.select("rep", "label", "v").mapInArrow(run, "bucket bigint, rep bigint, s0 bigint, s1 bigint")


def candidates(hits: DataFrame, cosine: float) -> DataFrame:
    """Pairs that share a filter and whose sign sketches do not rule out ``cosine``, by six deviations."""
    p = math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    most = 128 * p + 6 * math.sqrt(128 * p * (1 - p)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, p, q), t in runs(batches, 3):
            own, ids, s0, s1 = (t.column(c).to_numpy() for c in ("own", "rep", "s0", "s1"))
            left, right = np.flatnonzero(own == p), np.flatnonzero(own == q)
            for at in range(0, len(left), 256):
                part = left[at : at + 256]
                apart = np.bitwise_count((s0[part][:, None] ^ s0[right][None, :]).view(np.uint64)).astype(np.int16)
                apart += np.bitwise_count((s1[part][:, None] ^ s1[right][None, :]).view(np.uint64))
                near = apart <= most
                if p == q:
                    near &= ids[part][:, None] < ids[right][None, :]
                i, j = np.nonzero(near)
                if len(i):
                    a, b = ids[part[i]], ids[right[j]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return blocked(hits, "bucket", "rep", BLOCK).mapInArrow(run, "a bigint, b bigint").distinct()


def confirmed(pairs: DataFrame, reps: DataFrame, cosine: float) -> DataFrame:
    """Of ``pairs(a, b)`` those of one label whose cosine is at least ``cosine`` in double precision."""
    side = lambda c: reps.select(F.col("rep").alias(c), F.col("v").alias("v" + c), F.col("label").alias("g" + c))
    both = pairs.join(side("b"), "b").join(side("a"), "a").where("ga = gb and size(va) = size(vb)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, near = batch.column(2).value_lengths().to_numpy(zero_copy_only=False), np.zeros(batch.num_rows, bool)
            for d in np.unique(sizes).tolist():
                some = np.flatnonzero(sizes == d)
                x, y = (batch.column(k).take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d) for k in (2, 3))
                dot = lambda u, v: (u * v).sum(axis=1)
                near[some] = dot(x, y) / np.sqrt(dot(x, x) * dot(y, y)) >= cosine
            keep = np.flatnonzero(near)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    return both.select("a", "b", "va", "vb").mapInArrow(run, "a bigint, b bigint")


def near_vectors(
    table: DataFrame, *, cosine: float = 0.93, miss: float = 1e-5, key: str = "vec_id", column: str = "embedding", label: str = "label"
) -> DataFrame:
    """``key, n_links, component_id, kept``: links of cosine >= ``cosine`` between vectors of one label.

    Equal vectors of a label are one class, of which the least id stands for all; a class of k links
    each member with k - 1 others.  Every representative is decoded to all filters it exceeds, rows
    meet on filters, sign sketches drop hopeless pairs inside a bucket, and the rest is confirmed in
    double precision.  A pair at exactly ``cosine`` is missed with a chance of about ``miss``, a closer
    one far more rarely.
    Vectors of different lengths don't link.  A vector that is null, empty, zero or holds null or
    non-finite parts, or whose label is null, has no links and is its own component.  Ids are whole
    numbers; a row of null id counts as a copy but has no component but null.  Rows that repeat an id
    count as two vectors.  Other columns are not read.
    """
    all_ = written(vectors(table, key, column, label))
    reps = written(
        all_.where("class is not null and id is not null")
        .groupBy("class")
        .agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    )
    sizes = reps.groupBy("label", F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    largest = {r.d: r.n for r in sizes.groupBy("d").agg(F.max("n").alias("n")).collect()}
    codes = {d: fitting(d, n, cosine, miss) for d, n in largest.items()}
    pairs = candidates(filtered(reps, codes), cosine)
    links = written(confirmed(pairs, reps, cosine))
    comps = components(links)
    ends = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    weight = reps.select(F.col("rep").alias("b"), "copies")
    linked = ends.join(weight, "b").groupBy("a").agg(F.sum("copies").alias("far"))
    named = (
        reps.select("class", "rep", "copies")
        .join(linked.withColumnRenamed("a", "rep"), "rep", "left")
        .join(comps.withColumnRenamed("node", "rep"), "rep", "left")
        .select("class", (F.col("copies") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    )
    whole = F.coalesce(F.col("component"), F.col("id"))
    return (
        all_.select("id", "class")
        .join(loosened(named, "class"), "class", "left")
        .select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), whole.alias("component_id"), F.col("id").eqNullSafe(whole).alias("kept"))
    )
