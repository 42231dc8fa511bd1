import random

import numpy as np

from taproot.llm import mixing


def corpus(spark, n=600):
    r = random.Random(3)
    rows, tags = [], []
    for i in range(n):
        kind = r.choices(["clean", "junk", "toxic"], [6, 3, 1])[0]
        words = [f"word{r.randrange(500)}" for _ in range(r.randint(5, 120))]
        if kind == "junk":
            words = [w.upper() + "!!" for w in words]
        if kind == "toxic":
            words[r.randrange(len(words))] = "nasty"
            words[r.randrange(len(words))] = "vile"
        rows.append((i, " ".join(words), kind))
        if i % 3:
            tags.append((i, kind))
    docs = spark.createDataFrame([(i, t, 5) for i, t, _ in rows] + [(n, None, 5), (n + 1, "", 5), (n + 2, "word1 " * 50000, 5)], "doc_id long, text string, rate int")
    return rows, docs, spark.createDataFrame(tags, "doc_id long, domain string")


TARGETS = {"clean": 0.8, "junk": 0.15, "toxic": 0.05}


def test_totals_match_targets(spark):
    rows, docs, tags = corpus(spark)
    got = mixing.rated(docs.where("doc_id < 600"), tags, TARGETS).toPandas()
    assert len(got) == 600 and (got.rate >= 0).all() and (got.rate <= 8).all()
    total = got.n_tokens.sum()
    for k, share in TARGETS.items():
        assert abs((got.n_tokens * got[f"p_{k}"] * got.rate).sum() / total - share) < 1e-3
    p = got.set_index("doc_id")[["p_clean", "p_junk", "p_toxic"]]
    guess = p.idxmax(axis=1).str[2:]
    unseen = [i for i, _, _ in rows if i % 3 == 0]
    assert np.mean([guess[i] == rows[i][2] for i in unseen]) > 0.9


def test_against_dense_projected_gradient(spark):
    r = np.random.default_rng(6)
    n, p = r.integers(1, 50, 200), r.dirichlet([1, 1, 1], 200)
    members = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)], "n_tokens long, p array<double>")
    names, targets = ["a", "b", "c"], {"a": 0.15, "b": 0.25, "c": 0.6}
    fit = mixing.fit_rates(members, names, targets)
    A = n[:, None] * p / n.sum()
    rate = ahead = np.ones(200)
    for u, push in fit.steps:
        new = np.clip(ahead - A @ u, 0, 8)
        rate, ahead = new, new + push * (new - rate)
    got = [x.r for x in fit.members.select(fit.rates()["rate"].alias("r")).collect()]
    assert np.allclose(sorted(got), sorted(rate)) and np.abs(A.T @ rate - [0.15, 0.25, 0.6]).max() < 1e-4
    assert (rate == 0).any() and mixing.STRIDE < len(fit.steps) < 30


def test_every_domain_is_within_tolerance_of_its_own_target(spark):
    r = np.random.default_rng(1)
    n, p = r.integers(1, 50, 300), r.dirichlet([6, 3, 1], 300)
    members = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)], "n_tokens long, p array<double>")
    goal = np.array([0.65, 0.28, 0.07])
    fit = mixing.fit_rates(members, ["a", "b", "c"], dict(zip("abc", goal.tolist(), strict=True)))
    got = fit.members.select("n_tokens", "p", fit.rates()["rate"].alias("r")).toPandas()
    totals = (got.n_tokens.to_numpy()[:, None] * np.stack(got.p) * got.r.to_numpy()[:, None]).sum(axis=0) / n.sum()
    assert (np.abs(totals - goal) <= 1.01e-4 * goal).all()


def hard(spark, seed):
    """Soft posteriors and a few very long documents, so that many rates sit on a bound."""
    r = np.random.default_rng(seed)
    n = np.maximum(1, np.minimum(r.pareto(1.0, 3000) * 20, 50000)).astype(int)
    p = r.dirichlet([1.2, 0.6, 0.25], 3000)
    return n, p, spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)], "n_tokens long, p array<double>")


def test_targets_are_met_where_rates_sit_on_bounds(spark):
    for seed in range(3):
        n, p, members = hard(spark, seed)
        low = (p[:, 0] >= 0.5).astype(float)
        totals = (n[:, None] * p * np.where(p[:, 0] >= 0.5, 1.0, np.where(p[:, 0] > p[:, 2] * 4, 1.5, 0.0))[:, None]).sum(axis=0)
        fit = mixing.fit_rates(members, ["a", "b", "c"], dict(zip("abc", totals.tolist(), strict=True)), total=float(totals.sum()), hold="a")
        got = fit.members.select("n_tokens", "p", fit.rates()["rate"].alias("r")).toPandas()
        q = np.stack(got.p)
        reached = (got.n_tokens.to_numpy()[:, None] * q * got.r.to_numpy()[:, None]).sum(axis=0)
        assert (np.abs(reached - totals) <= 1.01e-4 * totals).all() and fit.met
        assert (got.r >= (q[:, 0] >= 0.5)).all() and (got.r <= 8).all() and ((got.r == 0) | (got.r == 8) | (got.r == 1)).sum() > low.sum() / 4


def test_residual_is_told_and_least_where_targets_cannot_be_met(spark):
    n, p, members = hard(spark, 9)
    goal = np.array([0.9, 0.08, 0.02]) * (n * p[:, 0]).sum() / 0.9
    fit = mixing.fit_rates(members, ["a", "b", "c"], {"a": 0.9, "b": 0.08, "c": 0.02}, hold="a")
    got = fit.members.select("n_tokens", "p", fit.rates()["rate"].alias("r")).toPandas()
    off = (got.n_tokens.to_numpy()[:, None] * np.stack(got.p) * got.r.to_numpy()[:, None]).sum(axis=0) - goal
    assert not fit.met and np.allclose([fit.residual[k] for k in "abc"], off, atol=1e-3)
    q = np.stack(got.p)
    A = got.n_tokens.to_numpy()[:, None] * q
    pull = A @ np.linalg.solve(A.T @ A, off)
    gap = (pull * got.r).sum() - (pull * np.where(pull > 0, (q[:, 0] >= 0.5).astype(float), 8.0)).sum()
    assert gap <= 0.01 * off @ np.linalg.solve(A.T @ A, off)  # within a hundredth of the least distance


def test_held_domain_keeps_its_documents(spark):
    rows, docs, tags = corpus(spark)
    got = mixing.rated(docs.where("doc_id < 600"), tags, TARGETS, hold="clean").toPandas()
    likely = got[got.p_clean >= 0.5]
    assert len(likely) > 300 and (likely.rate >= 1).all() and (likely.copies >= 1).all()
    assert (got[got.p_junk > 0.9].rate < 1).all()
    kept = (got.n_tokens * got.p_clean * got.rate).sum() / (got.n_tokens * got.p_clean).sum()
    assert 0.97 < kept < 1.06


def test_unreachable_targets_stay_in_bounds(spark):
    members = spark.createDataFrame([(10, [1.0, 0.0])] * 5 + [(1, [0.0, 1.0])], "n_tokens long, p array<double>")
    fit = mixing.fit_rates(members, ["a", "b"], {"b": 1.0}, cap=3.0)
    rates = {x.n_tokens: x.r for x in fit.members.select("n_tokens", fit.rates()["rate"].alias("r")).collect()}
    assert rates == {10: 0.0, 1: 3.0}


def test_mixed_rows_and_edges(spark):
    _, docs, tags = corpus(spark, 200)
    more = docs.union(docs.where("doc_id < 3")).union(spark.createDataFrame([(None, "x y", 5)], docs.schema))
    rated = {r.doc_id: r.copies for r in mixing.rated(more, tags, TARGETS).collect()}
    out = mixing.mixed(more, tags, TARGETS)
    assert out.columns == docs.columns
    got = out.groupBy("doc_id").count().collect()
    for g in got:
        twice = 2 if g.doc_id is not None and g.doc_id < 3 else 1
        assert g["count"] == (1 if g.doc_id is None else rated[g.doc_id] * twice)
    assert sum(v > 0 for k, v in rated.items() if k is not None) + 1 == len(got)
    none = docs.limit(0)
    assert mixing.mixed(none, tags, TARGETS).count() == 0
    assert {r.rate for r in mixing.rated(docs, tags.limit(0), TARGETS).collect()} == {1.0}


def independent(n, p, low, want, cap):
    """The nearest rates to 1 of given shares, by cyclic projections with Dykstra's corrections."""
    A = n[:, None] * p / n.sum()
    C = A - A.sum(axis=1, keepdims=True) * want
    back = np.linalg.pinv(C.T @ C)
    r, box, line = np.ones(len(n)), np.zeros(len(n)), np.zeros(len(n))
    for _ in range(20000):
        y = r + line
        x = y - C @ (back @ (C.T @ y))
        line = y - x
        r = np.clip(x + box, low, cap)
        box = x + box - r
    return r


def test_stretched_rates_against_an_independent_solver(spark):
    r = np.random.default_rng(11)
    n, p = r.integers(5, 60, 300), r.dirichlet([8, 1, 0.6], 300)
    members = spark.createDataFrame([(i, int(a), [float(x) for x in b]) for i, (a, b) in enumerate(zip(n, p, strict=True))], "doc_id long, n_tokens long, p array<double>")
    want = np.array([0.9, 0.07, 0.03])
    plain = mixing.fit_rates(members, list("abc"), dict(zip("abc", want.tolist(), strict=True)), hold="a")
    fit = mixing.fit_rates(members, list("abc"), dict(zip("abc", want.tolist(), strict=True)), hold="a", stretch=True)
    got = fit.members.select("doc_id", fit.rates()["rate"].alias("r")).toPandas().sort_values("doc_id").r.to_numpy()
    totals = (n[:, None] * p * got[:, None]).sum(axis=0)
    low = (p[:, 0] >= 0.5).astype(float)
    assert not plain.met and fit.met and (got >= low).all() and (got <= 8).all()
    assert (np.abs(totals / totals.sum() - want) <= 1.01e-4 * want).all() and abs(fit.total - totals.sum()) < 1e-3 * fit.total
    assert np.abs(got - independent(n, p, low, want, 8.0)).max() < 0.02
    hopeless = mixing.fit_rates(members, list("abc"), {"c": 1.0}, hold="a", stretch=True)
    assert not hopeless.met and hopeless.residual["a"] > 0


def test_gradient_steps_alone_meet_targets_where_rates_sit_on_bounds(spark):
    for seed in (1, 2):
        n, p, members = hard(spark, seed)
        low = (p[:, 0] >= 0.5).astype(float)
        totals = (n[:, None] * p * np.where(low > 0, 1.0, np.where(p[:, 0] > p[:, 2] * 4, 1.5, 0.0))[:, None]).sum(axis=0)
        fit = mixing.fit_rates(members, ["a", "b", "c"], dict(zip("abc", totals.tolist(), strict=True)), total=float(totals.sum()), hold="a", nearest=False)
        A = n[:, None] * p / n.sum()
        rate = ahead = np.ones(len(n))
        for u, push in fit.steps:
            new = np.clip(ahead - A @ u, low, 8)
            rate, ahead = new, new + push * (new - rate)
        assert fit.met and fit.total == fit.asked and (np.abs(A.T @ rate * n.sum() - totals) <= 1.01e-4 * totals).all()
        got = [x.r for x in fit.members.select(fit.rates()["rate"].alias("r")).collect()]
        assert np.allclose(sorted(got), sorted(rate))


def test_gradient_steps_reach_least_squares_and_shares(spark):
    n, p, members = hard(spark, 9)
    names, shares = ["a", "b", "c"], np.array([0.9, 0.08, 0.02])
    low = (p[:, 0] >= 0.5).astype(float)
    A = n[:, None] * p
    goal = shares * A[:, 0].sum() / 0.9
    fit = mixing.fit_rates(members, names, dict(zip(names, shares.tolist(), strict=True)), hold="a", nearest=False)
    got = fit.members.select("n_tokens", "p", fit.rates()["rate"].alias("r")).toPandas()
    B, rate = got.n_tokens.to_numpy()[:, None] * np.stack(got.p), got.r.to_numpy()
    off = B.T @ rate - goal
    assert not fit.met and np.allclose([fit.residual[k] for k in names], off, atol=1e-2)
    pull = B @ np.linalg.solve(B.T @ B, off)
    floor = (np.stack(got.p)[:, 0] >= 0.5).astype(float)
    assert (pull * rate).sum() - (pull * np.where(pull > 0, floor, 8.0)).sum() <= 1e-3 * off @ np.linalg.solve(B.T @ B, off)
    r = np.random.default_rng(11)
    n, p = r.integers(5, 60, 300), r.dirichlet([8, 1, 0.6], 300)
    members = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)], "n_tokens long, p array<double>")
    want = np.array([0.9, 0.07, 0.03])
    fit = mixing.fit_rates(members, names, dict(zip(names, want.tolist(), strict=True)), hold="a", stretch=True, nearest=False)
    got = fit.members.select("n_tokens", "p", fit.rates()["rate"].alias("r")).toPandas()
    totals = (got.n_tokens.to_numpy()[:, None] * np.stack(got.p) * got.r.to_numpy()[:, None]).sum(axis=0)
    assert fit.met and fit.total > fit.asked and abs(fit.total - totals.sum()) < 1e-6 * fit.total
    assert (np.abs(totals / totals.sum() - want) <= 1.01e-4 * want).all()
    hopeless = mixing.fit_rates(members, names, {"c": 1.0}, hold="a", stretch=True, nearest=False)
    assert not hopeless.met and hopeless.residual["a"] > 0
