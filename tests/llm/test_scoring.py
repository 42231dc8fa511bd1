import base64
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from taproot.llm import attention, scoring

PATH = P.path("byte_bpe_multi_50k.tiktoken")
HELD = lambda: F.crc32(F.col("doc_id").cast("string")) % 7 == 2
NAMES = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score"]


def brute(rows):
    """The contract's base, word by word."""
    words = {}
    for i, t in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        words[i] = [*re.findall("[^\x20\x09-\x0d]+", lower), None]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    count = Counter(w for i, x in words.items() if not held[i] for w in x)
    n, v = sum(count.values()), len(count)
    return {i: (held[i], len(x), sum(count[w] > 0 for w in x), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in x)) for i, x in words.items()}


def scored(df):
    return {r["doc_id"]: r for r in scoring.scored(df, PATH, P.PATTERN, HELD()).collect()}


def agree(got, want):
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert tuple(got[i][c] for c in NAMES[:-1]) == w[:-1]
        assert got[i]["base_score"] == pytest.approx(w[-1], rel=1e-9, abs=1e-9)
        assert math.isfinite(got[i]["score"]) and got[i]["score"] <= 0


def test_base_equals_brute_force(spark):
    texts = ["The the THE", "", None, " ", "\x0b lead and trail \x0c", "Ünï ÄÖ ſK", "a\x85b a\xa0b c\x1cd", "x" * 5000, "end", "x\ny\tz\r", "The the THE"] + [f"word{i % 7} of {i}" for i in range(40)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, 3, "w") for i, t in rows], "doc_id bigint, text string, n bigint, words string").repartition(3)
    agree(scored(df), brute(rows))


def test_given_documents_and_batches(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    agree(scored(docs), brute(rows))
    monkeypatch.setattr(scoring, "BATCH", 5000)
    agree(scored(docs.repartition(3)), brute(rows))


def test_odd_tables(spark):
    df = spark.createDataFrame([(2, "a b"), (2, "a b"), (None, "c"), (7, None)], "doc_id bigint, text string")
    assert scoring.scored(df, PATH, P.PATTERN, HELD()).count() == 4
    assert scored(df.limit(0)) == {}
    only_held = scored(spark.createDataFrame([(i, "a b") for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id bigint, text string"))
    assert {(r["n_known"], r["train_tokens"], r["base_score"]) for r in only_held.values()} == {(0, 0, 0.0)}


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(3)
    codes = attention.Codes.of(rng.zipf(1.3, 6000).clip(0, 10**6))
    w = attention.initial(codes)
    return {k: (x + rng.normal(size=x.shape) * 0.2).astype(np.float32) for k, x in w.items()}, codes


def test_probabilities_sum_to_one(model):
    w, codes = model
    h = np.tanh(np.random.default_rng(1).normal(size=(3, attention.HIDDEN))).astype(np.float32)
    for row in h:
        p = np.exp(attention.log_probs(w, np.repeat(row[None], 6000, axis=0), codes, np.arange(6000)))
        assert p.sum() == pytest.approx(1, abs=1e-4)


def naive(w, codes, ids, end):
    """One id at a time: the inputs of its window before it, one softmax each."""
    total = 0.0
    inputs = [end, *ids[:-1]]
    for t, target in enumerate(ids):
        low = t // attention.STRIDE * attention.STRIDE - (attention.WINDOW - attention.STRIDE)
        span = range(max(low, 0), t + 1)
        x = np.stack([w["embed"][codes.row[inputs[i]]] + w["place"][i - low] for i in span]).astype(float)
        s = np.clip((x @ w["key"]) @ (x[-1] @ w["query"]) / attention.DIM**0.5, -60, 60)
        a = np.exp(s - s.max())
        mid = x[-1] + (a / a.sum()) @ (x @ w["value"]) @ w["out"]
        h = np.tanh(mid @ w["layer"] + w["shift"])
        one, two = codes.a[target], codes.b[target]
        z = h @ w["head_a"] + w["bias_a"]
        y = (h * w["gate"][one]) @ w["head_b"] + w["bias_b"][one]
        total += z[one] - np.log(np.exp(z).sum()) + y[two] - np.log(np.exp(y).sum()) + codes.rest[target]
    return total / math.log(10)


def test_overlapping_windows_score_each_id_once(model):
    w, codes = model
    rng = np.random.default_rng(2)
    sizes = np.array([1, 31, 32, 33, 47, 48, 49, 300, 1])
    docs = [np.append(rng.integers(0, 5999, n - 1), 5999) for n in sizes]
    got = attention.scores(w, codes, np.concatenate(docs), sizes, 5999, chunk=5)
    assert got == pytest.approx([naive(w, codes, d.tolist(), 5999) for d in docs], rel=1e-4)


def test_a_position_is_the_sum_of_two_rows(model):
    w, codes = model
    tables, rows = attention.by_row(w), codes.row[np.random.default_rng(6).integers(0, 6000, 48)]
    x = w["embed"][rows] + w["place"]
    want = np.concatenate([x, x @ w["query"] / attention.DIM**0.5, x @ w["key"], x @ w["value"] @ w["out"]], axis=1)
    assert np.allclose(tables[0][rows] + tables[1], want, atol=1e-4)


def test_gradients_are_those_of_the_loss(model):
    w, codes = model
    w = {k: x.astype(np.float64) for k, x in w.items()}
    rng = np.random.default_rng(4)
    ids = rng.integers(0, 6000, (3, 13))
    seen = np.ones(ids.shape, bool)
    seen[1, 9:] = False
    loss, n, g = attention.gradients(w, codes, ids, seen)
    for k in w:
        place = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        near = []
        for step in (1e-3, -1e-3):
            moved = {**w, k: w[k].copy()}
            moved[k][place] += step
            near.append(attention.gradients(moved, codes, ids, seen)[0])
        assert (near[0] - near[1]) / 2e-3 / n == pytest.approx(g[k][place], rel=2e-2, abs=1e-5), k


def test_context_helps_on_held_out_documents(spark):
    """After training, held-out texts are likelier than under the corpus' unigram model of the same subwords."""
    rng = np.random.default_rng(8)
    nouns, verbs = [f"noun{i}" for i in range(20)], [f"verb{i}" for i in range(20)]
    rows = [(i, " ".join(f"{nouns[k]} {verbs[k]} and" for k in rng.integers(0, 20, 60))) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = scored(df)
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    tool = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    held = [i for i, _ in rows if got[i]["held_out"]]
    ids = {i: [*(x for w in rows[i][1].split() for x in tool.encode_ordinary(" " + w)), len(ranks)] for i, _ in rows}
    count = Counter(x for i in ids if i not in set(held) for x in ids[i])
    n = sum(count.values())
    unigram = sum(math.log10((count[x] + 1) / (n + len(ranks) + 1)) for i in held for x in ids[i])
    assert sum(got[i]["score"] for i in held) > 0.75 * unigram
    assert all(got[i]["n_subwords"] == len(ids[i]) for i in held)


def test_every_training_window_trains_once(spark):
    """Each subword of each document that trains is a target of the descent exactly once; none of a held one is."""
    ids, sizes = np.arange(200), np.array([1, 48, 49, 100, 2])
    use = np.array([True, True, False, True, True])
    got = []
    for nth in range(2):
        rows, seen = scoring.windows_of(ids, sizes, use, 999, nth, 2)
        assert all(r[0] == (999 if r[1] in (0, 1, 98, 198) else r[1] - 1) for r in rows)
        got += rows[:, 1:][seen[:, 1:]].tolist()
    assert sorted(got) == [i for i in range(200) if not 49 <= i < 98]
    docs = spark.createDataFrame([(0, "only these few words")], "doc_id bigint, text string")
    batches = scoring.written(scoring.numbered(docs, F.lit(False), 1))
    counts = scoring.written(scoring.counted(batches, 1, PATH, P.PATTERN))
    end = scoring.subwords(PATH, P.PATTERN)[1]
    w = scoring.trained(batches, counts, attention.Codes.of(np.ones(end + 1, np.int64)), end)
    assert w["head_a"].any()


def test_logits_that_overflow_are_shifted(model):
    """Heads far from their biases: losses, gradients and log-probabilities are those of double precision."""
    w, codes = model
    w = {k: x * 300 if k.startswith("head") else x for k, x in w.items()}
    double = {k: x.astype(np.float64) for k, x in w.items()}
    rng = np.random.default_rng(5)
    ids, seen = rng.integers(0, 6000, (4, 20)), np.ones((4, 20), bool)
    (_, n, got), (_, _, want) = (attention.gradients(x, codes, ids, seen) for x in (w, double))
    assert n == 76
    assert all(np.isfinite(got[k]).all() and np.abs(got[k] - want[k]).max() < 1e-3 * max(1, np.abs(want[k]).max()) for k in w)
    h = np.tanh(rng.normal(size=(50, attention.HIDDEN)))
    one, two = (attention.log_probs(x, h.astype(x["embed"].dtype), codes, ids[0].repeat(3)[:50]) for x in (w, double))
    assert one == pytest.approx(two, rel=1e-3, abs=1e-2)


def test_scoring_needs_no_shift_where_nothing_overflows(model, monkeypatch):
    """Heads that training can reach, though bounds of their logits pass 30, take one product each: no row's greatest is sought."""
    w, codes = model
    w = {k: x * 4 if k.startswith("head") else x for k, x in w.items()}
    h = np.tanh(np.random.default_rng(7).normal(size=(200, attention.HIDDEN))).astype(np.float32)

    class Told(np.ndarray):
        def max(self, *args, axis=None, **more):
            assert axis != 1
            return np.asarray(self).max(*args, axis=axis, **more)

    ids = np.arange(200)
    got = attention.log_probs(w, h.view(Told), codes, ids)
    wide = {k: x.astype(np.float64) for k, x in w.items()}
    assert np.asarray(got) == pytest.approx(attention.log_probs(wide, h.astype(np.float64), codes, ids), rel=1e-4, abs=1e-4)
