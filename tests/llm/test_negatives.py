import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from taproot.llm import negatives
from taproot.llm.queries import ORACLES, QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, label int, id int, score string"


def brute(rows, k=5, m=3):
    """Pairs compared one by one in whole numbers."""
    seen = {}
    for vec_id, e, label, *_ in rows:
        if vec_id is None or label is None or e is None or any(x is None or not np.isfinite(x) for x in e):
            continue
        v = (label, [int(np.floor(256 * float(np.float32(x)))) for x in e])
        seen[vec_id] = min(seen.get(vec_id, v), v)
    out = []
    for a, (label, e) in seen.items():
        if a % 50:
            continue
        s = sorted((-sum(x * y for x, y in zip(e, f)), b, other) for b, (other, f) in seen.items() if b != a and len(f) == len(e))
        for p, b, _ in [x for x in s if x[2] == label][:k]:
            fit = [x for x in s if x[2] != label and 50 * -p <= 100 * -x[0] <= 95 * -p][:m]
            out += [(a, b, i, x[1], -p, -x[0]) for i, x in enumerate(fit, 1)]
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in negatives.hard_negatives(negatives.quantised(df), F.col("id") % 50 == 0).collect())


def vectors(n, dim=6, seed=1, labels=4):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, dim))
    e = base[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * rng.choice([0, 0.02, 0.3], (n, 1))
    return [(i, [float(np.float32(x)) for x in e[i]], int(rng.integers(0, labels)), 7, "z") for i in range(n)]


@pytest.mark.parametrize("digit, slack", [(10, 32), (3, 0)])
def test_equals_brute_force(spark, monkeypatch, digit, slack):
    monkeypatch.setattr(negatives, "ROWS", 90)
    monkeypatch.setattr(negatives, "QUERIES", 3)
    monkeypatch.setattr(negatives, "DIGIT", digit)
    monkeypatch.setattr(negatives.select, "__defaults__", (slack,))
    rows = vectors(400)
    got = mined(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got == brute(rows) and len(got) > 50


def test_ties_repeats_nulls_and_lengths(spark):
    """Hundreds of equal copies tie, so ids decide; odd rows take no part; ids that repeat count once."""
    rows = [(i, [0.5, 0.25], 1 if i < 300 else 2, 0, "") for i in range(500)] + [(i, [0.4, 0.2], 3, 0, "") for i in range(500, 900)]
    rows += [(50, [9.0, 9.0], 1, 0, ""), (901, None, 1, 0, ""), (902, [1.0, None], 1, 0, ""), (903, [float("nan"), 1.0], 2, 0, ""), (904, [float("inf"), 1.0], 2, 0, "")]
    rows += [(905, [1.0, 1.0], None, 0, ""), (None, [0.4, 0.2], 3, 0, ""), (950, [], 1, 0, ""), (951, [], 2, 0, ""), (1000, [1.0, 1.0, 1.0], 1, 0, ""), (1001, [1.0, 0.5, 1.0], 1, 0, "")]
    rows += [(-50, [-0.5, -0.5], 5, 0, ""), (-49, [0.5, 0.5], 5, 0, ""), rows[100]]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_no_rows_and_no_anchors(spark):
    df = spark.createDataFrame(vectors(20), SCHEMA)
    assert mined(df.limit(0)) == [] and mined(df.where("vec_id % 50 <> 0")) == []
    assert negatives.hard_negatives(negatives.quantised(df.limit(0)), F.col("id") % 50 == 0).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_large_components(spark):
    """Scores beyond 53 bits stay whole; beyond 64 bits they raise."""
    rows = [(i, [1e6 + i * 1001, 3e4], i % 2, 0, "") for i in range(60)]
    rows = [(i, [float(np.float32(x)) for x in e], *z) for i, e, *z in rows]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    with pytest.raises(Exception, match="too long"):
        mined(spark.createDataFrame([(0, [1e30], 1, 0, "")], SCHEMA))


def test_given_vectors_equal_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{d}/embeddings.parquet'")
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = con.execute(f"select {', '.join(cols)} from ({ORACLES['op13_negatives']})").fetchall()
    assert sorted(want) == sorted(tuple(r) for r in QUERIES["op13_negatives"](spark, d).select(cols).collect())
