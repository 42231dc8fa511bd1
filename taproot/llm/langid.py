"""Language identification: sparse multinomial regression on TF-IDF character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from taproot.llm.common import F, hash_sample, vectors_of

_WORDLIKE = re.compile(r"[^\W\d_]").finditer
UNKNOWN = "und"
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def has_letter(text: str) -> bool:
    """Superscripts and fractions are word characters to ``re``, but no letters."""
    return any(m[0].isalpha() for m in _WORDLIKE(text))


def ngram_counts(text: str, bits: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 1- to 3-grams of the whole lower-case text, and how often each occurs.

    Runs of anything but letters count as one blank, so figures, marks and layout have no say.
    """
    c = np.frombuffer(re.sub(r"[\W\d_]+", " ", f" {text.lower()} ").encode("utf-32-le"), np.uint32)
    shift = np.uint32(32 - bits)
    total = np.zeros(1 << bits, np.int64)
    h = np.zeros(len(c), np.uint32)
    for n, mix in enumerate(_MIX):
        if len(c) <= n:
            break
        h = (h[: len(c) - n] ^ c[n:]) * mix
        h ^= h >> np.uint32(15)
        total += np.bincount((h * _MIX[0]) >> shift, minlength=1 << bits)
    found = np.flatnonzero(total)
    return found.astype(np.int32), total[found]


@dataclass
class Model:
    """Weights of nonzero features only; ``temperature`` divides the scores before the softmax."""

    languages: list[str]
    idf: np.ndarray  # float32, one per bucket
    rows: np.ndarray  # bucket -> row of weights, 0 for none
    weights: np.ndarray  # float32 (rows, languages); row 0 is zero
    bias: np.ndarray
    temperature: float = 1.0
    bits: int = 15

    def tfidf(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return scaled(found, counts, self.idf)

    def logits(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.tfidf(found, counts) @ self.weights[self.rows[found]] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(*ngram_counts(text, self.bits)).astype(float) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def scaled(found: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts).astype(np.float32) * idf[found]
    return x / max(float(np.sqrt(x @ x)), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit_ftrl(
    rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], kinds: int, width: int, *,
    alpha: float = 1.0, beta: float = 1.0, l1: float = 2e-3, l2: float = 1e-3, epochs: int = 4, seed: int = 7,
) -> tuple[np.ndarray, np.ndarray]:
    """Follow-the-regularised-leader (proximal, per coordinate) for the softmax loss.

    ``l1`` and ``l2`` are the elastic net: a weight whose gradient sum stays within ``l1`` is
    exactly zero.  The bias, the last feature, isn't penalised by ``l1``.
    """
    z = np.zeros((width + 1, kinds))
    n = np.zeros((width + 1, kinds))
    rng = np.random.default_rng(seed)

    def weights(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            f, x = rows[i]
            f, x = np.append(f, width), np.append(x, 1.0)
            w = weights(z[f], n[f], np.where(f == width, 0.0, l1)[:, None])
            g = softmax(x @ w)
            g[labels[i]] -= 1.0
            g = np.outer(x, g)
            z[f] += g - (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / alpha * w
            n[f] += g * g
    w = weights(z, n, np.r_[np.full(width, l1), 0.0][:, None])
    return w[:-1], w[-1]


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss on rows that were not trained on, by golden section.

    Targets are smoothed by Laplace's rule of succession: of ``n`` rows of ``k`` kinds the right one
    counts ``(n + 1) / (n + k)``, the others share the rest.  So rows that are all told apart don't drive
    the temperature to nought: ``n`` right answers are no proof of more certainty than that.
    """
    if not len(labels):
        return 1.0
    n, k = logits.shape
    rest = (k - 1) / (n + k)

    def loss(t: float) -> float:
        z = logits / np.exp(t)
        z = z - z.max(axis=1, keepdims=True)
        right = z[np.arange(n), labels]
        others = (z.sum(axis=1) - right) / max(k - 1, 1)
        return float((np.log(np.exp(z).sum(axis=1)) - (1 - rest) * right - rest * others).mean())

    a, b, ratio = -5.0, 5.0, (5**0.5 - 1) / 2
    for _ in range(50):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def document_counts(docs: DataFrame, bits: int, text: str = "text") -> tuple[int, np.ndarray]:
    """How many rows of ``docs`` have a letter, and how many of them have each bucket; one pass over whole texts.

    A task sends a row per bucket, and only their sums, ``2**bits`` at most, come to the driver.
    """
    width = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(width + 1, np.int64)
        for batch in batches:
            for x in batch.column(0):
                t = x.as_py()
                if t and has_letter(t):
                    seen[ngram_counts(t, bits)[0]] += 1
                    seen[width] += 1
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(seen[found])], names=["bucket", "n"])

    sums = docs.select(text).mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(width + 1, np.int64)
    out[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    return int(out[width]), out[:width]


def train(labelled: DataFrame, *, max_rows: int = 3000, bits: int = 15, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """Fits a model on about ``max_rows`` rows of ``labelled``, as many of each language, chosen by a hash of ``key`` and text.

    The sample is a documented bound on the fit and the temperature alone: document frequencies are
    counted over all rows, and every language there is takes part, however rare.  Only buckets and counts
    come to the driver, at most ``2**bits`` a row.  A fifth of the sample is kept from the fit and sets the
    temperature.  Null texts and labels, and texts without a letter, teach nothing; without any row the
    model answers ``und``.
    """
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("h"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(h, g, *ngram_counts(t, bits)) for h, t, g in zip(*(c.to_pylist() for c in batch.columns), strict=True) if has_letter(t)]
            cols = [
                pa.array([x[0] for x in got], pa.int64()),
                pa.array([x[1] for x in got], pa.string()),
                pa.array([x[2] for x in got], pa.list_(pa.int32())),
                pa.array([x[3] for x in got], pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["h", "lang", "found", "counts"])

    picked = (
        hash_sample(rows, ["h"], max_rows, "lang")
        .mapInArrow(count, "h bigint, lang string, found array<int>, counts array<int>")
        .toArrow()
    )
    sample = sorted(
        zip(picked.column(0).to_pylist(), picked.column(1).to_pylist(), vectors_of(picked.column(2)), vectors_of(picked.column(3)), strict=True),
        key=lambda r: (r[0], r[1], len(r[2]), int(r[3].sum())),
    )
    languages = sorted({r[1] for r in sample})
    width = 1 << bits
    n, seen = document_counts(rows, bits) if sample else (0, np.zeros(width))
    idf = (np.log((1 + n) / (1 + seen)) + 1).astype(np.float32)
    x = [(r[2], scaled(r[2], r[3], idf)) for r in sample]
    y = [languages.index(r[1]) for r in sample]
    held = [i for i, r in enumerate(sample) if (r[0] >> 40) % 5 == 0] if len(sample) >= 50 else []
    rest = sorted(set(range(len(sample))) - set(held))
    w, bias = fit_ftrl([x[i] for i in rest], [y[i] for i in rest], len(languages), width)
    live = np.flatnonzero(np.abs(w).sum(axis=1)) if languages else np.array([], int)
    index = np.zeros(width, np.int32)
    index[live] = np.arange(1, len(live) + 1)
    small = np.vstack([np.zeros((1, len(languages))), w[live]]).astype(np.float32)
    model = Model(languages, idf, index, small, bias.astype(np.float32), 1.0, bits)
    if held:
        model.temperature = calibrate(np.array([model.logits(sample[i][2], sample[i][3]) for i in held]).astype(float), np.array([y[i] for i in held]))
    return model


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep``, ``lang_pred`` and ``score`` of every whole text; one row per row, no shuffle.

    A null text, an empty one and one without a letter are ``und`` with score 0.  Equal texts have
    equal predictions.
    """
    kept = docs.select(*keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.predict(x.as_py()) for x in batch.column(len(keep))]
            made = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names=[*keep, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return docs.select(*keep, text).mapInArrow(run, schema + ", lang_pred string, score double")


def held_out(key: str = "doc_id"):
    """The quarter of documents that nothing is learned from."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify(docs: DataFrame, *, max_rows: int = 3000) -> DataFrame:
    """Trains on the rows that are not held out and predicts all rows."""
    model = train(docs.where(~held_out()), max_rows=max_rows)
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
