import random
import re

import numpy as np

from taproot.llm import minhash


def brute(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    comp = {i: i for i, _ in rows}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                comp[b] = a
    return {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


def rows_of(seed):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(900)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "one two"), (7, "É one"), (8, "é one")]
    i = 10
    for _ in range(12):
        base = [r.choice(vocab) for _ in range(r.randint(30, 400))]
        for _ in range(r.choice([1, 2, 12])):
            v = list(base)
            for _ in range(int(len(v) * r.choice([0, 0.005, 0.02, 0.04]))):
                v[r.randrange(len(v))] = r.choice(vocab)
            rows.append((i, "  ".join(v)))
            i += r.randint(1, 3)
    shared = " ".join(r.choice(vocab) for _ in range(60))
    for _ in range(30):
        rows.append((i, shared + " " + " ".join(r.choice(vocab) for _ in range(40))))
        i += 1
    chain = [r.choice(vocab) for _ in range(200)]
    for k in range(25):  # neighbours link, far ones don't
        rows.append((i + (k * 7) % 25, " ".join(chain[k * 8 :] + [f"x{k}_{j}" for j in range(0)] + chain[: k * 8][:0] + [f"t{m}" for m in range(k * 8)])))
    rows.append((900, "long " + " ".join(r.choice(vocab) for _ in range(90000))))
    r.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    for seed, n in ((1, 4), (2, 5)):
        rows = rows_of(seed)
        docs = spark.createDataFrame([(*x, "y") for x in rows], "doc_id long, text string, class string")
        got = minhash.near_duplicates(docs, n=n).collect()
        assert {tuple(g) for g in got} == brute(rows, n, 80) and len(got) == len(rows)


def test_repeats_empty_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "q r s t u v"), (2, "A b  c d e F")], "doc_id long, text string")
    got = sorted((tuple(g) for g in minhash.near_duplicates(docs).collect()), key=str)
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, None, True)]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_blocks_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 5)
    rows = rows_of(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(g) for g in minhash.near_duplicates(docs, n=4).collect()} == brute(rows, 4, 80)


def test_estimate_is_unbiased(spark):
    r = np.random.default_rng(4)
    s = minhash.Sketcher(32, 10)
    pool = r.integers(0, 1 << 63, 3000, np.uint64)
    made = []
    for share in (0.2, 0.5, 0.8):
        k = int(2000 * share / (1 + share) * 2 / 2)
        a, b = np.unique(pool[:1000]), np.unique(np.r_[pool[1000 - k : 1000], pool[1000 : 2000 - k]])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        made.append((true, *[[int(v) for v in s.sketch(x)[1]] for x in (a, b)]))
    df = spark.createDataFrame(made, "t double, a array<bigint>, b array<bigint>")
    from pyspark.sql import functions as F

    for row in df.select("t", minhash.estimate(F.col("a"), F.col("b"), 320).alias("e")).collect():
        assert abs(row.t - row.e) < 0.12
