"""Near-duplicate texts by b-bit MinHash, every link confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from taproot.llm.common import F, blocked, components, discard, loosened, runs, written

BITS = 2  # kept of each minimum
PER_LONG = 64 // BITS
ODD = 0x5555555555555555


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII blanks and controls 9 to 13, ASCII letters in lower case."""
    return (text or "").encode("utf-8").lower().split()


def shingles(words: list[bytes], known: WordHashes, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``n``-word shingles; of all words if there are fewer."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(n, len(words))
    out = np.full(len(h) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ h[k : len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
            out *= np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(32)
    return np.unique(out)


class Sketcher:
    """``bands`` of ``rows`` minima each; of every minimum ``BITS`` low bits are kept."""

    def __init__(self, bands: int, rows: int, seed: int = 11):
        if bands * rows % PER_LONG:
            raise ValueError(f"bands * rows must be a multiple of {PER_LONG}")
        self.bands, self.rows = bands, rows
        r = np.random.default_rng(seed)
        self.mul = r.integers(0, 1 << 32, (bands * rows, 1), np.uint32) | np.uint32(1)
        self.add = r.integers(0, 1 << 32, (bands * rows, 1), np.uint32)

    def minima(self, sh: np.ndarray) -> np.ndarray:
        least = np.full(len(self.mul), 0xFFFFFFFF, np.uint32)
        h = (sh >> np.uint64(32)).astype(np.uint32)
        low = sh.astype(np.uint32)
        for at in range(0, len(h), 2048):
            block = (h[at : at + 2048] ^ self.add) * self.mul
            block ^= block >> np.uint32(16)
            block += low[at : at + 2048]
            block *= self.mul
            np.minimum(least, block.min(axis=1), out=least)
        return least

    def sketch(self, sh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Band keys, and the packed low bits of the minima."""
        least = self.minima(sh)
        raw = least.reshape(self.bands, self.rows)
        keys = np.array([xxhash.xxh64_intdigest(raw[k].tobytes(), seed=k) for k in range(self.bands)], np.uint64).view(np.int64)
        low = (least & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(-1, PER_LONG)
        packed = np.bitwise_or.reduce(low << (np.arange(PER_LONG, dtype=np.uint64) * np.uint64(BITS)), axis=1)
        return keys, packed.view(np.int64)


def sketches(docs: DataFrame, n: int, sketcher: Sketcher, key: str = "doc_id", text: str = "text", tag=None) -> DataFrame:
    """``id, tag, class, n_shingles, bands, sig`` of each row; ``class`` names the word sequence.

    ``tag`` is a column that goes along.  A row without a word has no class, no band and no signature.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            cls, size, bands, sig = [], [], [], []
            for x in batch.column(2):
                words = words_of(x.as_py())
                sh = shingles(words, known, n)
                size.append(len(sh))
                if not words:
                    cls.append(None)
                    bands.append(None)
                    sig.append(None)
                    continue
                cls.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                k, s = sketcher.sketch(sh)
                bands.append(k)
                sig.append(s)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(cls, pa.binary()), pa.array(size, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.list_(pa.int64()))],
                names=["id", "tag", "class", "n_shingles", "bands", "sig"],
            )

    whole = docs.select(F.col(key).alias("id"), (F.lit(None).cast("boolean") if tag is None else tag).alias("tag"), F.col(text))
    kinds = [whole.schema[c].dataType.simpleString() for c in ("id", "tag")]
    return whole.mapInArrow(run, f"id {kinds[0]}, tag {kinds[1]}, class binary, n_shingles bigint, bands array<bigint>, sig array<bigint>")


def estimate(a, b, hashes: int):
    """Similarity from two packed signatures: equal ``BITS``-bit fields, corrected for chance."""
    apart = None
    for k in range(hashes // PER_LONG):
        x = a[k].bitwiseXOR(b[k])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(ODD))
        apart = F.bit_count(x) if apart is None else apart + F.bit_count(x)
    chance = 1 / (1 << BITS)
    return ((1 - apart / F.lit(hashes)) - chance) / (1 - chance)


def loosest(threshold: float, hashes: int, sigmas: float = 5.0) -> float:
    """The least estimate a pair at ``threshold`` may show, ``sigmas`` deviations below it."""
    chance = 1 / (1 << BITS)
    p = threshold + (1 - threshold) * chance
    return threshold - sigmas * (p * (1 - p) / hashes) ** 0.5 / (1 - chance)


def confirmed(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Of ``pairs(a, b)`` those with 100 * intersection >= percent * union of whole shingle sets.

    ``texts`` has ``id, t``.  Each pair meets both whole texts by two joins, whose skewed sides Spark can split; the left
    texts arrive sorted, so the set of a common left end is made once in a row.
    """
    both = pairs.join(texts.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")
    both = both.join(texts.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last, left = WordHashes(), None, None
        for batch in batches:
            a, b, ta, tb = batch.columns
            keep = []
            for i in range(batch.num_rows):
                t = ta[i].as_py()
                if t != last:
                    last, left = t, shingles(words_of(t), known, n)
                right = shingles(words_of(tb[i].as_py()), known, n)
                same = len(np.intersect1d(left, right, assume_unique=True))
                if 100 * same >= percent * (len(left) + len(right) - same):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([a.take(at), b.take(at)], names=["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return both.mapInArrow(run, f"a {kind}, b {kind}").distinct()


BLOCK, WEIGHT = 512, 1 << 20  # rows and shingles of a block


def likely(p: int, q: int, own, ids, comp, size, sig, low: float, hashes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs across components of one group whose estimate is at least ``low``."""
    chance = 1 / (1 << BITS)
    left, right = np.flatnonzero(own == p), np.flatnonzero(own == q)
    for at in range(0, len(left), 256):
        part = left[at : at + 256]
        apart = np.zeros((len(part), len(right)), np.int16)
        for w in range(hashes // PER_LONG):
            x = sig[part, w][:, None] ^ sig[right, w][None, :]
            x = (x | (x >> np.uint64(1))) & np.uint64(ODD)
            apart += np.bitwise_count(x)
        like = ((1 - apart / hashes) - chance) / (1 - chance) >= low
        like &= comp[part][:, None] != comp[right][None, :]
        if p == q:
            like &= ids[part][:, None] < ids[right][None, :]
        like &= np.minimum(size[part][:, None], size[right][None, :]) >= low * np.maximum(size[part][:, None], size[right][None, :])
        i, j = np.nonzero(like)
        yield part[i], right[j]


def unpacked(t: pa.Table, hashes: int) -> tuple:
    """The columns that ``likely`` reads."""
    sig = np.array(t.column("sig").combine_chunks().flatten()).reshape(t.num_rows, hashes // PER_LONG).view(np.uint64)
    return *(t.column(c).to_numpy() for c in ("own", "id", "component", "n_shingles")), sig


def involved(members: DataFrame, low: float, hashes: int) -> DataFrame:
    """Rows ``bucket, id`` of ``members`` that have a likely partner of another component in the bucket.

    ``members`` has ``bucket, id, component, n_shingles, sig``.  Only rows leave a group, not pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket, p, q), t in runs(batches, 3):
            columns = unpacked(t, hashes)
            hit = np.zeros(t.num_rows, bool)
            for i, j in likely(p, q, *columns, low, hashes):
                hit[i] = hit[j] = True
            ids = columns[1][hit]
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), bucket)), pa.array(ids)], names=["bucket", "id"])

    return blocked(members.select("bucket", "id", "component", "n_shingles", "sig"), "bucket", "id", BLOCK).mapInArrow(run, "bucket bigint, id bigint").distinct()


def joining(members: DataFrame, low: float, hashes: int, n: int, percent: int) -> DataFrame:
    """Links ``a, b`` that join components inside a bucket, confirmed on whole shingle sets.

    ``members`` has the columns of ``involved`` and ``t``, the text, which comes once per bucket and
    block, not once per pair.  Likely pairs are confirmed unless a link already found in the group
    joins their components, so at most one link per component leaves a group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for (_, p, q), t in runs(batches, 3):
            columns = unpacked(t, hashes)
            _, ids, comp, _, _ = columns
            texts, sets, top, found = t.column("t"), {}, {}, []

            def root(c: int) -> int:
                while top.get(c, c) != c:
                    c = top[c]
                return c

            def set_of(k: int) -> np.ndarray:
                if k not in sets:
                    sets[k] = shingles(words_of(texts[k].as_py()), known, n)
                return sets[k]

            for i, j in likely(p, q, *columns, low, hashes):
                cuts = np.flatnonzero(np.diff(i)) + 1
                for x, ys in zip(i[np.r_[0, cuts]] if len(i) else [], np.split(j, cuts), strict=False):
                    x = int(x)
                    while True:
                        mine = root(int(comp[x]))
                        ys = np.array([y for y in ys if root(int(comp[y])) != mine], int)
                        some, ys = ys[:64], ys[64:]
                        if not len(some):
                            break
                        one, others = set_of(x), [set_of(int(y)) for y in some]
                        all_ = np.concatenate(others)
                        hit = one[np.minimum(np.searchsorted(one, all_), len(one) - 1)] == all_
                        sizes = np.array([len(o) for o in others])
                        same = np.add.reduceat(hit, np.r_[0, np.cumsum(sizes)[:-1]], dtype=np.int64)
                        for y in some[100 * same >= percent * (len(one) + sizes - same)]:
                            a, b = root(int(comp[x])), root(int(comp[y]))
                            if a != b:
                                top[max(a, b)] = min(a, b)
                                found.append(sorted((int(ids[x]), int(ids[y]))))
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return blocked(members, "bucket", "id", BLOCK, "n_shingles", WEIGHT).mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(
    docs: DataFrame, *, n: int = 5, percent: int = 80, bands: int = 32, rows: int = 5, key: str = "doc_id", text: str = "text", tag=None
) -> DataFrame:
    """``key, n_shingles, component_id, kept``: one row per document, and the column ``tag`` if one is given.

    Documents are linked when 100 * intersection >= ``percent`` * union of their sets of distinct
    ``n``-word shingles; fewer words are one shingle.  A document without a word links with nothing.
    Equal word sequences form a class and only its least id goes on.  Band keys give buckets.  First
    every member is held against its bucket's least member, which joins the usual group of copies at
    a linear cost.  In buckets that still hold several components, the members whose b-bit estimate
    with one of another component could reach the threshold then bring their texts to the bucket, and
    every such pair is confirmed there unless its components are joined already, so that no candidate
    pair that matters is left out and no list of pairs is made.  A pair at a similarity of 0.8 misses all bands with probability 3e-6.

    Whole texts are shuffled once, when those of bucket members are set apart; what follows reads these
    alone.  Scratch tables go as soon as their successors are written.

    Ids must be whole numbers.  A null id is kept and has no component but null.  Rows that repeat an
    id and text fall in one class.  Other columns are not read.
    """
    hashes = bands * rows
    low = loosest(percent / 100, hashes)
    sk = written(sketches(docs, n, Sketcher(bands, rows), key, text, tag))
    classes = written(
        sk.where("class is not null and id is not null")
        .groupBy("class")
        .agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    )
    banded = classes.select("rep", F.posexplode("bands").alias("band", "h")).select(F.xxhash64("band", "h").alias("bucket"), "rep")
    shared = banded.groupBy("bucket").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = written(banded.join(loosened(shared.select("bucket", "least"), "bucket"), "bucket"))
    marks = classes.select("rep", "n_shingles", "sig")
    star = members.where("rep <> least").select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct()
    near = (
        star.join(marks.select(F.col("rep").alias("b"), F.col("n_shingles").alias("nb"), F.col("sig").alias("sb")), "b")
        .join(marks.select(F.col("rep").alias("a"), F.col("n_shingles").alias("na"), F.col("sig").alias("sa")), "a")
        .where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        .where(estimate(F.col("sa"), F.col("sb"), hashes) >= low)
        .select("a", "b")
    )
    near = written(near)
    inside = members.select(F.col("rep").alias("id")).distinct()
    texts = written(docs.select(F.col(key).alias("id"), F.col(text).alias("t")).join(inside, "id", "left_semi"))
    ends = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    links = written(confirmed(near, texts.join(ends, "id", "left_semi"), n, percent))
    discard(near)
    comps = written(components(links))
    named = members.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select(
        "bucket", F.col("rep").alias("id"), F.coalesce("component", "rep").alias("component")
    )
    open_ = named.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    rest = named.join(loosened(open_.select("bucket"), "bucket"), "bucket").join(marks.withColumnRenamed("rep", "id"), "id")
    rest = written(rest)
    discard(members)
    hit = written(involved(rest, low, hashes))
    ones = rest.join(hit, ["bucket", "id"], "left_semi").join(texts, "id")
    extra = written(joining(ones.select("bucket", "id", "component", "n_shingles", "sig", "t"), low, hashes, n, percent))
    discard(rest, hit, texts)
    if not extra.isEmpty():
        old, comps = comps, written(components(links.union(extra)))
        discard(old)
    discard(links, extra)
    names = classes.select("class", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    names = written(names.select("class", F.coalesce("component", "rep").alias("component")))
    discard(classes, comps)
    found = sk.select("id", "tag", "class", "n_shingles").join(names, "class", "left")
    whole = F.coalesce(F.col("component"), F.col("id"))
    carried = [] if tag is None else ["tag"]
    return found.select(
        F.col("id").alias(key), "n_shingles", whole.alias("component_id"), F.col("id").eqNullSafe(whole).alias("kept"), *carried
    )
