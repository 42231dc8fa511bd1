import math

import numpy as np
import pytest

from taproot.llm import caps


def brute(rows, cosine):
    good = {}
    for i, v, g in rows:
        if v and g is not None and None not in v and all(map(math.isfinite, v)) and any(v):
            good[i] = (np.array(v, float), g)
    links = {i: set() for i, _, _ in rows}
    for i, (x, g) in good.items():
        for j, (y, h) in good.items():
            if i < j and g == h and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= cosine:
                links[i].add(j)
                links[j].add(i)
    comp = {}
    for i in sorted(links):
        if i in comp:
            continue
        todo = [i]
        while todo:
            k = todo.pop()
            if k not in comp:
                comp[k] = i
                todo += links[k]
    return {(i, len(links[i]), comp[i], comp[i] == i) for i in links}


def sample(seed, dim=64, n=500):
    r = np.random.default_rng(seed)
    rows, i = [], 0
    while i < n:
        base = r.normal(size=dim)
        for _ in range(r.choice([1, 1, 2, 6])):
            v = base + r.normal(size=dim) * r.choice([0, 0.1, 0.25, 0.38, 0.42])
            rows.append((i, [float(x) for x in v.astype(np.float32)], int(r.integers(0, 3))))
            i += 1
    return rows


@pytest.mark.parametrize("dim", [64, 16])
def test_against_brute_force(spark, dim):
    rows = sample(dim, dim)
    rows += [(2000, None, 1), (2001, [0.0] * dim, 1), (2002, [1.0, None] * (dim // 2), 1), (2003, [float("nan")] * dim, 1)]
    rows += [(2004, [float("inf")] * dim, 1), (2005, [], 1), (2006, rows[0][1], None), (2007, [x * 3 for x in rows[0][1]], rows[0][2])]
    rows += [(2008, rows[0][1], rows[0][2]), (2009, rows[0][1][:10], rows[0][2]), (2010, [-x for x in rows[0][1]], rows[0][2])]
    df = spark.createDataFrame([(i, v, g, "e") for i, v, g in rows], "vec_id long, embedding array<float>, label int, class string")
    got = caps.near_vectors(df).collect()
    assert {tuple(g) for g in got} == brute([(i, v and [x if x is None else float(np.float32(x)) for x in v], g) for i, v, g in rows], 0.93)
    assert len(got) == len(rows)


def test_blocks_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(caps, "BLOCK", 4)
    rows = sample(9, n=150)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert {tuple(g) for g in caps.near_vectors(df).collect()} == brute(rows, 0.93)


def test_empty(spark):
    assert caps.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_decode_lists_every_filter():
    code = caps.fitting(24, 300, 0.9)[0]
    rotation, words, _ = code.parts()
    r = np.random.default_rng(1)
    for _ in range(20):
        x = r.normal(size=24)
        x = x / np.linalg.norm(x) @ rotation
        cuts = np.cumsum([0, *(w.shape[1] for w in words)])
        scores = [w @ x[a:b] for w, a, b in zip(words, cuts[:-1], cuts[1:], strict=True)]
        total = scores[0]
        for s in scores[1:]:
            total = (total[:, None] + s[None, :]).ravel()
        assert set(code.decode(scores).tolist()) == set(np.flatnonzero(total >= code.alpha).tolist())
