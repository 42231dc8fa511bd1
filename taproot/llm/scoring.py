"""Scoring texts by language models that are learned from the whole corpus."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taproot.llm import attention
from taproot.llm.alignment import batches_of_texts, bounds, gathered, run_sums
from taproot.llm.common import discard, runs, written

#: Bytes of text that are numbered and scored together.
BATCH = 4 << 20
#: Bytes of text for each bucket of words.
LINES = 12 << 20
#: Rounds of training; each takes its share of the windows, so that every window trains in one of them.
ROUNDS = 2


def packed(values: np.ndarray) -> bytes:
    """An array as its length in bytes and a Zstandard frame."""
    raw = np.ascontiguousarray(values).tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True), kind)


@lru_cache(maxsize=2)
def subwords(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1


def encoded(words: list[str], tool, end: int) -> list[list[int]]:
    """Ids of each word with a space before it; the empty word is the end of a document."""
    return [tool.encode_ordinary(" " + w) if w else [end] for w in words]


def numbered(docs: DataFrame, held: Column, buckets: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Batches of documents as numbers of their words: one row a batch.

    ``batch, ids, held, sizes, codes``; each document ends in the empty word.  ``parts`` are the batch's distinct
    words by a hash of the word: their ``codes``, how often they are ``seen`` in documents that train, and ``words``,
    by lines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for rows in batches_of_texts(batches, 1, BATCH):
            lower = pc.ascii_lower(pc.fill_null(rows.column(1), "")).combine_chunks()
            split = pc.ascii_split_whitespace(lower)
            coded = pc.dictionary_encode(split.flatten())
            words, raw = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            spare = words.index("") if "" in words else len(words)  # blanks at either end give empty words
            if spare == len(words):
                words.append("")
            owner = np.repeat(np.arange(len(split)), np.diff(split.offsets.to_numpy()))
            there = raw != spare
            sizes = np.bincount(owner[there], minlength=len(split)) + 1
            cuts = bounds(sizes)
            codes = np.full(cuts[-1], spare, np.uint32)
            inside = np.ones(cuts[-1], bool)
            inside[cuts[1:] - 1] = False
            codes[inside] = raw[there]
            out = rows.column(2).to_numpy()
            seen = np.bincount(codes[np.repeat(~out, sizes)], minlength=len(words))
            bucket = (pd.util.hash_array(np.array(words, dtype=object), categorize=False) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            parts = []
            for some in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                lines = "\n".join(map(words.__getitem__, some.tolist()))
                parts.append({"bucket": int(bucket[some[0]]), "codes": packed(some.astype(np.uint32)), "seen": packed(seen[some]), "words": lines})
            one = lambda v, kind: pa.array([v], pa.list_(kind))
            ids = pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column(0).combine_chunks())
            cols = [pa.array([task << 32 | n], pa.int64()), ids, one(out, pa.bool_()), pa.array([packed(sizes.astype(np.uint32))], pa.binary()), pa.array([packed(codes)], pa.binary())]
            struct = pa.struct([("bucket", pa.int64()), ("codes", pa.binary()), ("seen", pa.binary()), ("words", pa.string())])
            n += 1
            yield pa.RecordBatch.from_arrays([*cols, one(parts, struct)], names=["batch", "ids", "held", "sizes", "codes", "parts"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text, held).mapInArrow(
        run, f"batch bigint, ids array<{kind}>, held array<boolean>, sizes binary, codes binary, parts array<struct<bucket: bigint, codes: binary, seen: binary, words: string>>"
    )


def counted(batches: DataFrame, buckets: int, path: str, pattern: str) -> DataFrame:
    """The words of each batch with their counts in all documents that train, and their subword ids.

    A row ``batch, codes, n, sub_sizes, sub`` for each part of a batch, and for each bucket of words a row
    without ``batch``: ``tokens``, ``kinds``, and ``uses`` of subword ids, each word taken once.  A word is in a
    batch once, however frequent, so no bucket is much larger than another.
    """
    parts = batches.select("batch", F.explode("parts").alias("p")).select("p.bucket", "batch", "p.codes", "p.seen", "p.words")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, end = subwords(path, pattern)
        names = ["batch", "codes", "n", "sub_sizes", "sub", "tokens", "kinds", "uses"]
        use = pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int64())]))
        types = [pa.int64(), *[pa.binary()] * 4, pa.int64(), pa.int64(), use]
        for _, t in runs(rows, 1):
            lines = pc.split_pattern(t.column("words"), "\n").combine_chunks()
            coded = pc.dictionary_encode(lines.flatten())
            words, place = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            seen = np.concatenate([unpacked(x.as_py(), np.int64) for x in t.column("seen")])
            n = np.zeros(len(words), np.int64)
            np.add.at(n, place, seen)
            ids = encoded(words, tool, end)
            sizes = np.array([len(x) for x in ids], np.int64)
            cuts, flat = bounds(sizes), np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))
            uses = np.bincount(flat, np.repeat(n, sizes), end + 1).astype(np.int64)
            there = np.flatnonzero(uses)
            told = [{"id": i, "n": k} for i, k in zip(there.tolist(), uses[there].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([None] * 5 + [int(n.sum()), int((n > 0).sum()), told], types, strict=True)], names=names)
            offsets = lines.offsets.to_numpy()
            for r, (batch, codes) in enumerate(zip(t.column("batch").to_pylist(), t.column("codes").to_pylist(), strict=True)):
                mine = place[offsets[r] - offsets[0] : offsets[r + 1] - offsets[0]]
                row = [batch, codes, packed(n[mine]), packed(sizes[mine].astype(np.int32)), packed(flat[gathered(cuts, mine)]), None, None, None]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, types, strict=True)], names=names)

    dealt = parts.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "batch bigint, codes binary, n binary, sub_sizes binary, sub binary, tokens bigint, kinds bigint, uses array<struct<id: bigint, n: bigint>>")


def joined(batches: DataFrame, counts: DataFrame) -> DataFrame:
    """Each batch and the counts and subword ids of its words, one after the other in one task; the batch comes last."""
    none = lambda c: F.lit(None).cast(c)
    kind = batches.schema["ids"].dataType.simpleString()
    left = counts.where("batch is not null").select("batch", F.lit(0).alias("kind"), "codes", "n", "sub_sizes", "sub", none(kind).alias("ids"), none("array<boolean>").alias("held"), none("binary").alias("sizes"))
    right = batches.select("batch", F.lit(1), "codes", none("binary"), none("binary"), none("binary"), "ids", "held", "sizes")
    return left.union(right).repartition(max(1, min(batches.count(), 20_000)), "batch").sortWithinPartitions("batch", "kind")


def opened(t: pa.Table) -> tuple[np.ndarray, ...]:
    """Of a batch of ``joined``: words of each document, each word's count in all that trains and its number of subwords, and the subword ids."""
    last = t.num_rows - 1
    read = lambda c, kind: [unpacked(x.as_py(), kind) for x in t.column(c).slice(0, last)]
    code = np.concatenate(read("codes", np.uint32))
    n, sub_size, start = (np.zeros(len(code), np.int64) for _ in range(3))
    n[code] = np.concatenate(read("n", np.int64))
    lengths = np.concatenate(read("sub_sizes", np.int32))
    sub_size[code], start[code] = lengths, np.cumsum(lengths) - lengths
    sub = np.concatenate(read("sub", np.int32))
    sizes, word = (unpacked(t.column(c)[last].as_py(), np.uint32).astype(np.int64) for c in ("sizes", "codes"))
    each = sub_size[word]
    ids = sub[np.arange(each.sum()) + np.repeat(start[word] - np.cumsum(each) + each, each)]
    return sizes, n[word], each, ids


def windows_of(ids: np.ndarray, sizes: np.ndarray, use: np.ndarray, end: int, nth: int = 0, of: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The windows of the documents in ``use``, every ``of``-th from the ``nth`` on, as ids and which of them are there.

    ``sizes`` are the documents' numbers of ``ids``.  A document's windows follow each other without a gap: a row is the id
    before a window, ``end`` for a document's first, and the window's ids, so that each id is a target once.
    """
    starts, windows = np.cumsum(sizes) - sizes, np.where(use, -(-sizes // attention.WINDOW), 0)
    owner = np.repeat(np.arange(len(sizes)), windows)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    owner, place = owner[nth::of], place[nth::of]
    at = place[:, None] * attention.WINDOW + np.arange(-1, attention.WINDOW)
    seen = at < sizes[owner][:, None]
    out = np.full(at.shape, end, np.int64)
    there = seen & (at >= 0)
    out[there] = ids[(starts[owner][:, None] + at)[there]]
    return out, seen


def trained(batches: DataFrame, counts: DataFrame, codes: attention.Codes, end: int, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Weights by averaged local descent over all windows of all documents that train, each in one of the ``rounds``.

    In a round each batch goes over its share of its windows from common weights, and the mean of what batches find, by
    tokens, is where the next round begins.  Means are taken in the tasks, 32 at a time, so that the driver gets 32
    sets of weights at most.
    """
    w = attention.initial(codes)
    spark = batches.sparkSession
    for nth in range(rounds):
        now = spark.sparkContext.broadcast(attention.flat(w))

        def fit(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, t in runs(rows, 1):
                sizes, _, each, ids = opened(t)
                use = ~np.array(t.column("held")[t.num_rows - 1].values.to_pylist(), bool)
                some = windows_of(ids, run_sums(bounds(sizes), each), use, end, nth, rounds)  # noqa: B023
                if not len(some[0]):
                    continue
                mine, _, n = attention.fitted(attention.shaped(now.value, attention.initial(codes)), codes, *some)  # noqa: B023
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([(attention.flat(mine).astype(np.float64) * n).tobytes()], pa.binary())], names=["n", "sums"])

        def add(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = 0, None
            for b in rows:
                for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    x = np.frombuffer(x)
                    n, total = n + k, x.copy() if total is None else total + x
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "sums"])

        found = written(joined(batches, counts).mapInArrow(fit, "n bigint, sums binary"))
        parts, left = found, max(1, batches.count())
        while left > 32:
            left = -(-left // 32)
            parts = parts.repartition(left).mapInArrow(add, "n bigint, sums binary")
        parts = parts.collect()
        discard(found)
        n = sum(r["n"] for r in parts)
        if n:
            w = attention.shaped((sum(np.frombuffer(r["sums"]) for r in parts) / n).astype(np.float32), w)
        now.unpersist()
    return w


def scored(docs: DataFrame, path: str, pattern: str, held: Column, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores every whole text by a unigram model of words and by a causal self-attention model of subwords.

    Columns ``key``, ``held_out``, ``n_tokens`` (words and one end), ``n_known``, ``train_tokens``, ``base_score``,
    ``score`` and ``n_subwords``.  Words are lower-cased (A-Z) runs of anything but ASCII white space; the subword model
    reads them with a space before each and the end.  ``held`` says which rows are kept out of all that is
    learned; where it is null they train.  A null text is an empty one, which is its end.  Repeated
    rows stay and count as often; other columns are not read.

    Counts of words and subwords are those of all that train, and the attention weights train on every window of
    all their texts, once.  Words are numbered batch by batch; a batch's distinct words are dealt by a hash, counted
    and encoded, and come back to their batch, which trains and is scored there.  No table of words is ever in one place.
    """
    end = subwords(path, pattern)[1]
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(1, round(size / LINES))
    batches = written(numbered(docs, F.coalesce(held, F.lit(False)), buckets, key, text))
    counts = written(counted(batches, buckets, path, pattern))
    facts = counts.agg(F.sum("tokens"), F.sum("kinds")).first()
    tokens, kinds = facts[0] or 0, facts[1] or 0
    uses = np.zeros(end + 1, np.int64)  # one row an id at most comes to the driver
    for r in counts.select(F.explode("uses").alias("u")).groupBy("u.id").agg(F.sum("u.n").alias("n")).collect():
        uses[r["id"]] = r["n"]
    codes = attention.Codes.of(uses)
    weights = attention.flat(trained(batches, counts, codes, end))
    model = docs.sparkSession.sparkContext.broadcast((weights, codes))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, codes = model.value
        w = attention.shaped(values, attention.initial(codes))
        for _, t in runs(rows, 1):
            last = t.num_rows - 1
            sizes, n, each, ids = opened(t)
            cuts = bounds(sizes)
            logs = np.concatenate([[0.0], np.cumsum(np.log10(n + 1.0))])
            base = logs[cuts[1:]] - logs[cuts[:-1]] - sizes * np.log10(tokens + kinds + 1.0)
            sub_sizes = run_sums(cuts, each)
            score = attention.scores(w, codes, ids, sub_sizes, end)
            cols = [t.column("ids")[last].values, t.column("held")[last].values, pa.array(sizes), pa.array(run_sums(cuts, n > 0)), pa.array(np.full(len(sizes), tokens)), pa.array(base), pa.array(score), pa.array(sub_sizes)]
            yield pa.RecordBatch.from_arrays(cols, names=[key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_subwords"])

    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_subwords bigint"
    result = written(joined(batches, counts).mapInArrow(run, schema))
    discard(batches, counts)
    return result
