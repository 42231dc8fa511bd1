"""Hard negatives by distributed radix selection over integer inner products."""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taproot.llm.common import discard, runs, written

#: Rows and queries of a tile; both are sent to every tile of their row or column.
ROWS, QUERIES = 4096, 1024
#: A digit of the selection, in bits.
DIGIT = 10
#: A window is gathered once its last bucket holds no more rows than this beyond those asked for.
SLACK = 32
#: The greatest squared length for which an inner product, twentyfold, stays in 64 bits.
LONGEST = 4e17

WINDOW = "struct<slot: bigint, top: bigint, low: bigint, first: bigint, last: bigint, need: bigint>"


def quantised(rows: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """``id, label, vector``: the rows that take part, each component as ``floor(scale * x)`` in doubles.

    A row without id, label or vector, or with a component that is null or not finite, takes no part.
    Rows of one id count once, as the least of them.  A vector too long for 64-bit scores raises.
    """
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("bigint"))
    whole = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    part = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).where(whole)
    size = F.aggregate(vector, F.lit(0.0), lambda s, c: s + (F.abs(c.cast("double")) * scale + 1) * (F.abs(c.cast("double")) * scale + 1))
    fits = F.when(size > LONGEST, F.raise_error(F.lit("a vector is too long for 64-bit scores")).cast("array<bigint>")).otherwise(x)
    named = part.select(F.col(key).cast("bigint").alias("id"), F.struct(F.col(label).cast("bigint").alias("label"), fits.alias("vector")).alias("v"))
    return named.groupBy("id").agg(F.min("v").alias("v")).select("id", "v.label", "v.vector")


def _tiles(rows: DataFrame, queries: DataFrame, n_rows: int, n_queries: int) -> DataFrame:
    """Rows and queries (those with ``windows``) by tile ``p, q``, queries first."""
    cut_r, cut_q = max(1, -(-n_rows // ROWS)), max(1, -(-n_queries // QUERIES))
    none = F.lit(None).cast(f"array<{WINDOW}>")
    part = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cols = ["p", "q", "kind", "id", "label", "vector", "windows"]
    one = rows.withColumn("p", part(cut_r, 1)).withColumn("q", each(cut_q)).withColumn("kind", F.lit(1)).withColumn("windows", none).select(cols)
    two = queries.withColumn("q", part(cut_q, 2)).withColumn("p", each(cut_r)).withColumn("kind", F.lit(0)).select(cols)
    tiles = cut_r * cut_q
    return two.union(one).repartition(min(tiles, 20_000), "p", "q").sortWithinPartitions("p", "q", "kind")


def _scored(batches: Iterator[pa.RecordBatch], same: bool) -> Iterator[tuple]:
    """Per tile and slice of queries: scores, the cells that a window may take, ids of rows and of queries, windows.

    Vectors of unequal length have no score.  Scores are whole numbers; doubles serve while exact.
    """
    for _, t in runs(batches, 2):
        kind = t.column("kind").to_numpy()
        split = int((kind == 0).sum())
        if not split or split == len(kind):
            continue
        ids, labels = t.column("id").to_numpy(), t.column("label").to_numpy()
        vectors = t.column("vector").combine_chunks()
        width = np.diff(vectors.offsets.to_numpy())
        values, cuts = vectors.values.to_numpy(), vectors.offsets.to_numpy()
        windows = t.column("windows").combine_chunks()
        field = windows.values.flatten()
        w_cuts = windows.offsets.to_numpy()
        w = np.stack([f.to_numpy() for f in field], axis=1) if len(field) and len(field[0]) else np.zeros((0, 6), np.int64)
        for d in np.unique(width[:split]):
            mine = np.flatnonzero(width[:split] == d)
            theirs = split + np.flatnonzero(width[split:] == d)
            if not len(theirs):
                continue
            take = lambda i: values[(cuts[i][:, None] + np.arange(d)).ravel()].reshape(len(i), d)  # noqa: B023, E731
            right = take(theirs)
            for s in range(0, len(mine), 128):
                some = mine[s : s + 128]
                left = take(some)
                if not d:
                    scores = np.zeros((len(some), len(theirs)), np.int64)
                elif d * float(np.abs(left).max()) * float(np.abs(right).max()) < 2**53:
                    scores = (left.astype(float) @ right.astype(float).T).astype(np.int64)
                else:
                    scores = left @ right.T
                fine = (labels[some][:, None] == labels[theirs][None, :]) == same
                fine &= ids[some][:, None] != ids[theirs][None, :]
                yield scores, fine, ids[theirs], ids[some].tolist(), [w[w_cuts[i] : w_cuts[i + 1]].tolist() for i in some]


def _shift(size: int) -> int:
    """Bits below the leading digit of a range of so many values."""
    return max(max(size - 1, 0).bit_length() - DIGIT, 0)


def _histograms(batches: Iterator[pa.RecordBatch], same: bool) -> Iterator[pa.RecordBatch]:
    """``anchor, slot, bucket, n``: how many rows of a tile fall into each bucket of a window's digit.

    Buckets count from the best.  Those behind the first that reaches ``need`` in this very tile can't hold
    the one that is looked for, and are left out.
    """
    for scores, fine, ids, anchors, windows in _scored(batches, same):
        names, buckets, counts = [], [], []
        for anchor, row, ok, ws in zip(anchors, scores, fine, windows, strict=True):
            for slot, top, low, first, last, need in ws:
                on = ok & (row <= top) & (row >= low)
                if top == low:
                    there = ids[on]
                    there = there[(there >= first) & (there <= last)] - first
                    shift = _shift(last - first + 1)
                else:
                    there = top - row[on]
                    shift = _shift(top - low + 1)
                if len(there):
                    b, n = np.unique(there >> shift, return_counts=True)
                    until = int(np.searchsorted(np.cumsum(n), need)) + 1
                    buckets.append(b[:until])
                    counts.append(n[:until])
                    names += [(anchor, slot)] * len(buckets[-1])
        if names:
            cols = [*np.array(names, np.int64).T, np.concatenate(buckets), np.concatenate(counts)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["anchor", "slot", "bucket", "n"])


def _gathered(batches: Iterator[pa.RecordBatch], same: bool) -> Iterator[pa.RecordBatch]:
    """``anchor, slot, id, score`` of the rows within each window's bounds: better ones, and those of its last range."""
    for scores, fine, ids, anchors, windows in _scored(batches, same):
        names, found, values = [], [], []
        for anchor, row, ok, ws in zip(anchors, scores, fine, windows, strict=True):
            for slot, top, low, _, last, _ in ws:
                # above the last score every id qualifies, at it those up to the last id
                on = np.flatnonzero(ok & (row <= top) & ((row > low) | ((row == low) & (ids <= last))))
                names += [(anchor, slot)] * len(on)
                found.append(ids[on])
                values.append(row[on])
        if names:
            cols = [*np.array(names, np.int64).T, np.concatenate(found), np.concatenate(values)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["anchor", "slot", "id", "score"])


def _refined(state: DataFrame, histogram: DataFrame, slack: int) -> DataFrame:
    """The next state of each window from its histogram; ``done`` where what is left may be gathered.

    A window without rows or with fewer than it needs takes all of its bounds.
    """
    name = ["anchor", "slot"]
    upto = F.sum("n").over(Window.partitionBy(*name).orderBy("bucket"))
    counted = histogram.groupBy(*name, "bucket").agg(F.sum("n").alias("n")).withColumn("upto", upto)
    joined = counted.join(state.select(*name, "need"), name)
    hit = joined.where("upto >= need").groupBy(*name).agg(F.min(F.struct("bucket", "n", "upto")).alias("hit"))
    s = state.join(hit, name, "left")
    on_ids = F.col("top") == F.col("low")
    size = F.when(on_ids, F.col("last") - F.col("first") + 1).otherwise(F.col("top") - F.col("low") + 1)
    bits = F.when(size <= 1, 0).otherwise(F.length(F.bin(size - 1)))
    shift = F.greatest(bits - DIGIT, F.lit(0))
    s = s.withColumn("on_ids_", on_ids).withColumn("shift_", shift.cast("int")).withColumn("step_", F.expr("shiftleft(1L, shift_)"))
    best, few = F.col("hit.bucket"), F.col("hit").isNull()
    top = F.when(few | F.col("on_ids_"), F.col("top")).otherwise(F.col("top") - best * F.col("step_"))
    low = F.when(few | F.col("on_ids_"), F.col("low")).otherwise(F.greatest(F.col("low"), F.col("top") - (best + 1) * F.col("step_") + 1))
    first = F.when(few | ~F.col("on_ids_"), F.col("first")).otherwise(F.col("first") + best * F.col("step_"))
    last = F.when(few | ~F.col("on_ids_"), F.col("last")).otherwise(F.least(F.col("last"), F.col("first") + (best + 1) * F.col("step_") - 1))
    need = F.when(few, F.col("need")).otherwise(F.col("need") - (F.col("hit.upto") - F.col("hit.n")))
    exact = (top == low) & (first == last)
    done = few | exact | (F.col("hit.n") <= need + slack)
    return s.select("anchor", "slot", "start", top.alias("top"), low.alias("low"), first.alias("first"), last.alias("last"), need.alias("need"), done.alias("done"))


def select(rows: DataFrame, anchors: DataFrame, windows: DataFrame, k: int, same: bool, slack: int = SLACK) -> DataFrame:
    """The first ``k`` rows of each window: ``anchor, slot, id, score, rank``, by falling score, then by id.

    ``rows`` and ``anchors`` are ``id, label, vector``, ``windows`` is ``anchor, slot, low, top`` with bounds
    of the score, both inclusive.  A row belongs to an anchor's windows if its id is another and its label
    is the same (``same``) or another one.

    Selection goes by digits of the key (score, id).  Each round, tiles of rows and anchors count the rows
    of every window's present range by the digit, counts are summed, and the bucket that holds the ``k``th
    becomes the next range; when scores are used up, ids go on.  Nothing but counts is shuffled until a
    range is exact or holds only ``slack`` rows more than needed; then the rows down to it are gathered
    and ranked, at most ``k + slack`` a window, however many copies tie.
    """
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.max("id").alias("most")).first()
    n_anchors = anchors.count()
    if not facts["n"] or not n_anchors:
        return windows.select("anchor", "slot", F.col("anchor").alias("id"), F.col("low").alias("score"), F.lit(0).alias("rank")).limit(0)
    bounds = [F.lit(facts["least"]).alias("first"), F.lit(facts["most"]).alias("last")]
    fresh = windows.where("low <= top").select("anchor", "slot", F.col("top").alias("start"), "top", "low", *bounds, F.lit(k).cast("bigint").alias("need"), F.lit(False).alias("done"))
    state = written(fresh)

    def tiled(s: DataFrame, top: str) -> DataFrame:
        w = s.select("anchor", F.struct("slot", F.col(top).alias("top"), "low", "first", "last", "need").alias("w"))
        w = w.groupBy(F.col("anchor").alias("id")).agg(F.collect_list("w").alias("windows"))
        return _tiles(rows, anchors.join(w, "id"), facts["n"], n_anchors)

    while not (open_ := state.where("not done")).isEmpty():
        counts = tiled(open_, "top").mapInArrow(lambda b: _histograms(b, same), "anchor bigint, slot bigint, bucket bigint, n bigint")
        fresh = written(_refined(open_, counts, slack).union(state.where("done")))
        discard(state)
        state = fresh
    rest = tiled(state, "start").mapInArrow(lambda b: _gathered(b, same), "anchor bigint, slot bigint, id bigint, score bigint")
    order = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "id")
    return rest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _share(score: Column, share: tuple[int, int], up: bool) -> Column:
    """``score * share`` in whole numbers, rounded up or down."""
    part = gcd(*share)
    a, b = share[0] // part, share[1] // part
    if not 0 <= a <= 20 or b < 1:
        raise ValueError("shares are fractions with a numerator of 20 at most")
    x = -score * a if up else score * a
    down = F.call_function("div", x - F.pmod(x, F.lit(b)), F.lit(b))
    return -down if up else down


def hard_negatives(
    rows: DataFrame, queries: Column, *, positives: int = 5, negatives: int = 3, above: tuple[int, int] = (50, 100), below: tuple[int, int] = (95, 100)
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` is what ``quantised`` gives, ``queries`` says of ``id`` which rows are anchors.  An anchor's
    positives are its best other rows of the same label.  The negatives of a pair are the best rows of
    other labels whose score is from ``above`` to ``below``, as shares of the positive's.  A pair without such
    rows gives none, as does an anchor alone in its label.  Vectors score against those of their own length
    only; an empty one scores 0 with other empty ones.  An empty table gives no rows.
    """
    rows = written(rows)
    anchors = written(rows.where(queries))
    size = F.aggregate("vector", F.lit(0).cast("bigint"), lambda s, c: s + c * c)
    bound = (rows.agg(F.max(size)).first()[0] or 0) + 1  # no inner product is greater than the longest vector's own
    whole = anchors.select(F.col("id").alias("anchor"), F.lit(0).cast("bigint").alias("slot"), F.lit(-bound).cast("bigint").alias("low"), F.lit(bound).cast("bigint").alias("top"))
    best = select(rows, anchors, whole, positives, True)
    pairs = written(best.select("anchor", F.col("rank").cast("bigint").alias("slot"), F.col("id").alias("positive"), F.col("score").alias("positive_score")))
    windows = pairs.select("anchor", "slot", _share(F.col("positive_score"), above, True).alias("low"), _share(F.col("positive_score"), below, False).alias("top"))
    out = select(rows, anchors, windows, negatives, False)
    return out.join(pairs, ["anchor", "slot"]).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )
