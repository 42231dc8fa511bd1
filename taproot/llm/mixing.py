"""Mixing to target weights: soft domain membership and least squares for document rates."""

from __future__ import annotations

import math
import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from taproot.llm.common import F, hash_sample, vectors_of, written
from taproot.llm.langid import calibrate, fit_ftrl, softmax

BITS = 15
_OTHER = bytes(c for c in range(128) if not bytes([c]).isalnum())
_SHAPE = bytes(ord("X") if 65 <= c <= 90 else ord("9") if 48 <= c <= 57 else ord("x") if 97 <= c <= 122 or c >= 128 else c for c in range(256))
_REPEATS = re.compile(rb"(.)\1+", re.S).sub


class Buckets(dict):
    """Word -> two buckets, of its bare lower-case letters and of its shape, in one number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        bare = word.translate(None, _OTHER).lower()
        shape = _REPEATS(rb"\1+", word.translate(_SHAPE))
        one = xxhash.xxh32_intdigest(bare) >> (33 - BITS)
        two = (1 << (BITS - 1)) + (xxhash.xxh32_intdigest(shape, 1) >> (33 - BITS))
        self[word] = both = one | two << 32
        return both


def features(text: str | None, known: Buckets) -> tuple[int, np.ndarray]:
    """Words of the whole text, and the buckets present in it."""
    words = (text or "").encode("utf-8").split()
    both = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    seen = np.zeros(1 << BITS, bool)
    seen[both & 0xFFFFFFFF] = True
    seen[both >> 32] = True
    return len(words), np.flatnonzero(seen).astype(np.int32)


@dataclass
class Domains:
    names: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def posterior(self, found: np.ndarray) -> np.ndarray:
        if not self.names:
            return np.empty(0)
        return softmax((self.weights[found].sum(axis=0) + self.bias) / self.temperature)


def train(docs: DataFrame, labelled: DataFrame, *, max_rows: int = 4000, key: str = "doc_id", text: str = "text", domain: str = "domain") -> Domains:
    """Fits domain posteriors on about ``max_rows`` labelled rows, chosen by a hash of ``key``.

    The sample is a documented bound on training alone.  Presence of words and word shapes is the
    input; a fifth of the rows calibrates the temperature.  Rows of null domain teach nothing.
    """
    tags = labelled.where(F.col(domain).isNotNull()).select(F.col(key).alias("k_"), F.col(domain).cast("string").alias("d_"))
    tags = hash_sample(tags, ["k_"], max_rows)
    # the sample is bounded by max_rows, so the documents stay where they are
    rows = docs.select(F.col(key).alias("k_"), F.col(text).alias("t_")).join(F.broadcast(tags), "k_")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets()
        for batch in batches:
            found = [features(x.as_py(), known)[1] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.int32()))], names=["h", "d", "f"])

    picked = rows.select(F.xxhash64("k_").alias("h"), "t_", "d_").mapInArrow(look, "h bigint, d string, f array<int>").toArrow()
    sample = sorted(
        zip(picked.column(0).to_pylist(), picked.column(1).to_pylist(), vectors_of(picked.column(2)), strict=True),
        key=lambda r: (r[0], r[1], len(r[2]), int(r[2].sum(dtype=np.int64))),
    )
    names = sorted({r[1] for r in sample})
    x = [(r[2], np.full(len(r[2]), 0.25, np.float32)) for r in sample]
    y = [names.index(r[1]) for r in sample]
    held = [i for i, r in enumerate(sample) if (r[0] >> 40) % 5 == 0] if len(sample) >= 50 else []
    rest = sorted(set(range(len(sample))) - set(held))
    w, bias = fit_ftrl([x[i] for i in rest], [y[i] for i in rest], len(names), 1 << BITS, alpha=0.5, l1=1.0, l2=1e-3, epochs=5)
    model = Domains(names, (0.25 * w).astype(np.float32), bias.astype(np.float32))
    if held:
        logits = np.array([model.weights[x[i][0]].sum(axis=0) + model.bias for i in held]).astype(float)
        model.temperature = calibrate(logits, np.array([y[i] for i in held]))
    return model


def memberships(docs: DataFrame, model: Domains, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, p``: words of each whole text and its domain posteriors, in ``model.names`` order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets()
        for batch in batches:
            n, p = [], []
            for x in batch.column(1):
                words, found = features(x.as_py(), known)
                n.append(words)
                p.append(np.round(model.posterior(found).astype(float), 9))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(p, pa.list_(pa.float64()))], names=[key, "n_tokens", "p"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint, p array<double>")


def stepped(steps: list[tuple[np.ndarray, float]], scale: float, cap: float, held: int | None = None, start=None):
    """``rate`` and ``ahead`` after the given steps from ``start`` (from 1), as one expression over ``n_tokens, p``.

    A step ``(u, push)`` moves from the point ahead against the gradient, clips to [0, cap], and
    looks ahead by ``push`` times the change made.  Documents that more likely than not are of domain
    ``held`` don't go below 1.
    """
    floor = F.lit(0.0) if held is None else F.when(F.col("p")[held] >= 0.5, 1.0).otherwise(0.0)
    if start is None:
        start = F.struct(F.lit(1.0).alias("rate"), F.lit(1.0).alias("ahead"))
    if not steps:
        return start
    table = F.array(*[F.array(*[F.lit(float(v)) for v in (*u, push)]) for u, push in steps])
    K = len(steps[0][0])

    def step(at, u):
        move = sum(F.col("p")[k] * u[k] for k in range(K)) * F.col("n_tokens") / F.lit(scale)
        new = F.least(F.lit(float(cap)), F.greatest(floor, at["ahead"] - move))
        return F.struct(new.alias("rate"), (new + u[K] * (new - at["rate"])).alias("ahead"))

    return F.aggregate(table, start, step)


@dataclass
class Fit:
    """Steps from rate 1 on, and a table that has taken all but the last ``tail`` of them.

    ``residual`` has the tokens of each domain above its target, ``met`` whether all are within tolerance.
    """

    members: DataFrame
    steps: list[tuple[np.ndarray, float]]
    tail: list[tuple[np.ndarray, float]]
    scale: float
    cap: float
    held: int | None
    residual: dict[str, float] = field(default_factory=dict)
    met: bool = True
    total: float = 0.0
    asked: float = 0.0

    def take(self, u: np.ndarray, push: float = 0.0) -> None:
        """One step more; every ``STRIDE`` steps the state is written beside the posteriors."""
        self.steps.append((u, push))
        self.tail.append((u, push))
        if len(self.tail) > STRIDE:
            state = self.rates()
            self.members, self.tail = written(self.members.withColumn("state_", state)), []

    def rates(self):
        """The fitted state as an expression over ``members``."""
        start = F.col("state_") if "state_" in self.members.columns else None
        return stepped(self.tail, self.scale, self.cap, self.held, start)


#: Steps that are taken by one expression before the state is written; each pass repeats them.
STRIDE = 6

#: Damping of Newton steps that are tried in one pass, in units of the Gram matrix.  At 1 the step never overshoots.
DAMPING = (1e-9, 1e-6, 1e-4, 1e-2, 0.1, 1.0)

#: Damping of scaled gradients that are tried in one pass, in the same units.
DECADES = tuple(10.0**k for k in range(-9, 2))

#: Weight on the rates' distance where no rates meet the targets, in the same units.
CLOSEST = 1e-7


@dataclass
class Trial:
    """What the rates clip(start - p * n_tokens / scale * u) give: sums over all documents."""

    u: np.ndarray
    totals: np.ndarray  # per domain, over scale
    gram: np.ndarray  # of the documents whose rate is on no bound
    height: float  # half the squared distance of the rates from the start, plus u times totals
    least: float  # the least that u times totals can be with rates in their bounds


def tried(at: DataFrame, us: list[np.ndarray], scale: float, cap: float, held: int | None) -> list[Trial]:
    """One pass over ``at(n_tokens, p, start)`` for several ``us``.  Totals are sums of whole millionths,
    so that they don't depend on how rows are dealt."""
    K, J = len(us[0]), len(us)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, gram, height, least = [0] * (J * K), np.zeros((J, K, K)), np.zeros(J), np.zeros(J)
        for batch in batches:
            n = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
            p = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(n), K)
            start = batch.column(2).to_numpy(zero_copy_only=False)
            low = np.zeros(len(n)) if held is None else np.minimum(p[:, held] >= 0.5, cap)
            a = p * n[:, None] / scale
            for j, u in enumerate(us):
                move = a @ u
                raw = start - move
                r = np.clip(raw, low, cap)
                whole = np.rint(p * (n * r)[:, None] * 1e6).astype(np.int64).sum(axis=0).tolist()
                totals[j * K : j * K + K] = [x + y for x, y in zip(totals[j * K : j * K + K], whole, strict=True)]
                free = a[(raw > low) & (raw < cap)]
                gram[j] += free.T @ free
                height[j] += 0.5 * ((r - start) ** 2).sum() + (r * move).sum()
                least[j] += (np.where(move > 0, low, cap) * move).sum()
        floats = np.concatenate([gram.ravel(), height, least]).tolist()
        yield pa.RecordBatch.from_arrays([pa.array([[str(x) for x in totals]]), pa.array([floats])], names=["t", "f"])

    rows = at.select("n_tokens", "p", "start").mapInArrow(run, "t array<string>, f array<double>").collect()
    totals = np.array([sum(int(r.t[k]) for r in rows) / 1e6 / scale for k in range(J * K)]).reshape(J, K)
    floats = np.array([math.fsum(r.f[k] for r in rows) for k in range(J * K * K + 2 * J)])
    gram, height, least = floats[: J * K * K].reshape(J, K, K), floats[J * K * K : -J], floats[-J:]
    short = np.vectorize(lambda x: float(f"{x:.9g}"))
    return [Trial(u, totals[j], short(gram[j]), float(height[j]), float(least[j])) for j, u in enumerate(us)]


def descended(
    fit: Fit, goal: np.ndarray, gram: np.ndarray, tolerance: float, *, total_free: bool = False, prove: bool = False, most: int = 1000
) -> tuple[np.ndarray, bool]:
    """Projected gradient steps from the state of ``fit`` on, until the targets are met or no rates in
    bounds come nearer; the totals then, over scale, and whether they are met.

    The misfit is what the totals lack to ``goal`` or, with ``total_free``, to its nearest multiple, and is
    measured by the inverse Gram matrix of all documents.  A step goes against its gradient and is clipped.
    One pass tries the gradient as it is, which always lowers the misfit, and scaled by the Gram matrix of
    the documents on no bound, more or less damped; the lowest is taken.  The gap between the misfit's
    linear model and its least value in bounds limits what is left to gain: with a hundredth of a per cent of
    the misfit left, the rates are the least squares solution.  With ``prove`` it ends as soon as that gap proves
    that no rates in bounds meet the targets.
    """
    unit = np.where(goal > 0, goal, goal.max())
    inverse = np.linalg.inv(gram)

    def misfit(totals: np.ndarray, metric: np.ndarray = inverse) -> np.ndarray:
        return totals - goal * ((goal @ metric @ totals) / (goal @ metric @ goal) if total_free else 1.0)

    def met(totals: np.ndarray) -> bool:
        share = totals.sum() / goal.sum() if total_free else 1.0
        return bool((np.abs(totals - goal * share) <= tolerance * unit * share).all())

    def trials(us: list[np.ndarray]) -> list[Trial]:
        at = fit.members.withColumn("start", fit.rates()["rate"])
        return tried(at, us, fit.scale, fit.cap, fit.held)

    size = lambda totals: float(misfit(totals) @ inverse @ misfit(totals))
    here = trials([np.zeros(len(goal))])[0]
    for _ in range(most):
        if met(here.totals):
            return here.totals, True
        us = [inverse @ misfit(here.totals)]
        for d in DECADES:
            metric = np.linalg.inv(here.gram + d * gram)
            us.append(metric @ misfit(here.totals, metric))
        found = trials(us)
        gap = float(us[0] @ here.totals) - found[0].least
        proof = found[0].least - float(us[0] @ goal) > tolerance * float(np.abs(us[0]) @ unit)
        if gap <= 1e-4 * size(here.totals) or prove and proof and not total_free:
            return here.totals, False
        best = min(found, key=lambda x: (not met(x.totals), size(x.totals)))
        if not met(best.totals) and size(best.totals) >= size(here.totals):
            return here.totals, False
        fit.take(best.u)
        here = best
    raise RuntimeError("rates did not settle")


def shared_out(
    at: DataFrame, want: np.ndarray, gram: np.ndarray, tolerance: float, scale: float, cap: float, held: int | None, most: int = 1000
) -> Trial | None:
    """The step from ``start`` to the nearest rates in bounds whose totals stand to one another as ``want``,
    whatever their sum; None where there are none, or rounding ends the ascent.

    ``projected`` with one condition less: the multipliers are those that are square to ``want``.
    """
    K = len(want)
    square = np.linalg.svd(want[None, :])[2][1:].T  # K by K - 1
    unit = np.where(want > 0, want, want.max())
    ready = lambda x: (np.abs(x.totals - want * x.totals.sum()) <= tolerance * unit * x.totals.sum()).all()
    here = tried(at, [np.zeros(K)], scale, cap, held)[0]
    for _ in range(most):
        if ready(here):
            return here
        us = [here.u + square @ np.linalg.solve(square.T @ (here.gram + d * gram) @ square, square.T @ here.totals) for d in DAMPING]
        trials = tried(at, us, scale, cap, held)
        for x in trials:
            if ready(x):
                return x
        if any(x.least > tolerance * float(np.abs(x.u) @ unit) * cap for x in trials):
            return None
        best = max(trials, key=lambda x: x.height)
        if best.height <= here.height:
            return None
        here = best
    raise RuntimeError("rates did not settle")


def projected(
    at: DataFrame, goal: np.ndarray, gram: np.ndarray, allowed: np.ndarray, scale: float, cap: float, held: int | None, most: int = 1000, nearest: bool = True
) -> tuple[Trial, bool]:
    """The step ``u`` from ``start`` to the nearest rates in bounds whose totals are ``goal``, and whether
    there are any within ``allowed``.

    Newton steps on the dual, a concave function of one multiplier per domain.  Each pass tries one step
    per damping; that of damping 1 always ascends, as no Gram matrix of free documents exceeds ``gram``.
    A ``u`` for which even the least ``u`` times totals is above all that ``allowed`` leaves proves that
    the targets can't be met; then the nearest totals in units of ``gram`` are sought, if ``nearest``.
    """
    near, met = 0.0, True
    here = tried(at, [np.zeros(len(goal))], scale, cap, held)[0]
    slope = lambda x: x.totals - goal - near * (gram @ x.u)
    height = lambda x: x.height - float(x.u @ goal) - near / 2 * float(x.u @ gram @ x.u)
    for _ in range(most):
        if (np.abs(slope(here)) <= allowed).all():
            return here, met
        us = [here.u + np.linalg.solve(here.gram + (near + d) * gram, slope(here)) for d in DAMPING]
        trials = tried(at, us, scale, cap, held)
        for x in trials:
            if (np.abs(x.totals - goal) <= allowed).all():
                return x, True
        if met and any(x.least - float(x.u @ goal) > float(np.abs(x.u) @ allowed) for x in trials):
            if not nearest:
                return here, False
            near, met = CLOSEST, False
            continue
        best = max(trials, key=height)
        if height(best) <= height(here):
            return here, False
        here = best
    raise RuntimeError("rates did not settle")


def fit_rates(
    members: DataFrame, names: list[str], targets: dict[str, float], *, total: float | None = None, hold: str | None = None,
    cap: float = 8.0, rounds: int = 40, tolerance: float = 1e-4, stretch: bool = False, nearest: bool = True,
) -> Fit:
    """Rates r in [0, cap] with sum(n_tokens * p * r) = total * targets.

    ``members`` should be a written table.  Projected gradient comes first: every round is one pass that
    returns a sum per domain; rates follow from the list of steps, and every ``STRIDE`` steps the state is
    written beside the posteriors.  Gradients are scaled by the inverse Gram matrix of the domains over
    all documents, which makes a unit step exact as long as no rate meets a bound; steps are accelerated
    by Nesterov's rule.  When ``STRIDE`` rounds have not brought the residual to a tenth, or after
    ``rounds``, momentum ends and gradients are scaled by the documents that are on no bound
    (``descended``).  With ``nearest`` the multipliers of one last step are solved for instead
    (``projected``), so that the rates are the nearest to those before it.

    It ends when every domain is within ``tolerance`` of its own target (of the largest, where its own is
    0); ``residual`` has the distances, and ``met`` is false where no rates in bounds come so near (or where
    rounding ends the ascent first).  Those returned are then the nearest found.  With ``stretch`` the total
    gives way first: the nearest rates to 1 are taken whose totals stand to one another as the targets do
    (``shared_out``), so that a held domain whose own documents carry too much of another one is repeated
    where it carries least; ``total`` of the fit tells what came of it.  ``total`` defaults to the tokens there are, or, with
    ``hold``, to what keeps that domain's own total; its likely members keep rate 1 at least.
    """
    K = len(names)
    held = names.index(hold) if hold in names else None
    want = np.array([max(0.0, float(targets.get(x, 0.0))) for x in names])
    exact = lambda c: F.sum(c.cast("decimal(38,6)"))
    fit = Fit(members, [], [], 1.0, cap, held)
    weight = lambda: F.col("n_tokens").cast("double")
    pairs = [(i, j) for i in range(K) for j in range(i, K)]
    first = members.agg(
        F.sum("n_tokens").alias("n"),
        *[exact(F.col("n_tokens") * F.col("p")[k]).alias(f"s{k}") for k in range(K)],
        *[F.sum(weight() * weight() * F.col("p")[i] * F.col("p")[j]).alias(f"g{i}_{j}") for i, j in pairs],
    ).first()
    scale = float(first.n or 0)
    if not K or not scale or not want.sum():
        return fit
    fit.scale = fit.total = scale
    want /= want.sum()
    sums = np.array([float(first[f"s{k}"]) for k in range(K)]) / scale
    if total is None:
        total = sums[held] / want[held] * scale if held is not None and want[held] else scale
    goal, fit.total = want * total / scale, float(total)
    fit.asked = fit.total
    gram = np.zeros((K, K))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = float(f"{first[f'g{i}_{j}'] / scale**2:.9g}")
    gram += np.eye(K) * np.trace(gram) * 1e-9
    whiten = np.linalg.pinv(gram)
    ahead, t = sums, 1.0
    unit = np.where(goal > 0, goal, goal.max())
    off = [sums - goal]
    size = lambda x: float((np.abs(x) / unit).max())

    while len(fit.steps) < rounds and size(off[-1]) > tolerance:
        if len(off) > STRIDE and size(off[-1]) > 0.1 * size(off[-1 - STRIDE]):
            break
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        fit.take(whiten @ (ahead - goal), (t - 1) / after)
        t = after
        row = (
            fit.members.withColumn("r", fit.rates())
            .agg(*[exact(F.col("n_tokens") * F.col("p")[k] * F.col("r")[x]).alias(f"{x}{k}") for k in range(K) for x in ("rate", "ahead")])
            .first()
        )
        at, ahead = (np.array([float(row[f"{x}{k}"]) for k in range(K)]) / scale for x in ("rate", "ahead"))
        off.append(at - goal)
    if size(off[-1]) > tolerance and not nearest:
        fit.take(np.zeros(K))  # momentum ends, and the point ahead comes back into bounds
        totals, fit.met = descended(fit, goal, gram, tolerance, prove=stretch)
        if stretch and not fit.met:
            other = replace(fit, steps=list(fit.steps), tail=list(fit.tail))
            freed, other.met = descended(other, goal, gram, tolerance, total_free=True)
            if other.met:
                fit, totals = other, freed
                fit.total = float(totals.sum() * scale)
            else:
                totals, fit.met = descended(fit, goal, gram, tolerance)
        fit.residual = dict(zip(names, (totals * scale - want * fit.total).tolist(), strict=True))
        return fit
    if size(off[-1]) > tolerance:
        if fit.tail:
            state = fit.rates()
            fit.members, fit.tail = written(fit.members.withColumn("state_", state)), []
        start = F.col("state_.ahead") if fit.steps else F.lit(1.0)
        last, fit.met = projected(fit.members.withColumn("start", start), goal, gram, tolerance * unit, scale, cap, held, nearest=not stretch)
        if stretch and not fit.met:
            free = shared_out(members.withColumn("start", F.lit(1.0)), want, gram, tolerance, scale, cap, held)
            if free is not None:
                fit.members, fit.steps, fit.met = members, [(free.u, 0.0)], True
                fit.tail = list(fit.steps)
                fit.total = float(free.totals.sum() * scale)
                fit.residual = dict(zip(names, ((free.totals - want * free.totals.sum()) * scale).tolist(), strict=True))
                return fit
            last, fit.met = projected(fit.members.withColumn("start", start), goal, gram, tolerance * unit, scale, cap, held)
        fit.steps.append((last.u, 0.0))
        fit.tail.append((last.u, 0.0))
        off.append(last.totals - goal)
    best = min(range(len(off)), key=lambda x: size(off[x]))
    if best < len(fit.steps):
        fit.steps = fit.steps[:best]
        fit.members, fit.tail = members, list(fit.steps)
    fit.residual = dict(zip(names, (off[best] * scale).tolist(), strict=True))
    return fit


def labelled_domains(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Domain of each labelled document: toxic, else clean or junk by quality; null if not labelled."""
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").when(F.col("quality") == 0, "junk")
    return labels.select(key, kind.alias("domain"))


def copies(key: str = "doc_id"):
    """Whole copies of a row at ``rate``: the fraction is decided by a hash of ``key``."""
    u = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return F.floor(F.col("rate") + u).cast("int")


def rated(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float], *, hold: str | None = None, total: float | None = None,
    cap: float = 8.0, max_rows: int = 4000, key: str = "doc_id", text: str = "text", stretch: bool = False, nearest: bool = False,
) -> DataFrame:
    """``key, n_tokens, p_<domain>.., rate, asked, total, copies`` of every document; one row per row.

    ``labelled`` has ``key, domain``.  Null and empty texts have no tokens and keep rate 1.  Without
    labelled rows or tokens all rates are 1.  Rows that repeat are rated alike.  Targets of domains
    that were never seen are left out and the rest is scaled up.  With ``stretch`` the total gives way
    where the targets can't be met at it.  ``asked`` is the total that was set and ``total`` the one that the
    targets are shares of in the end; a warning tells when they differ.  Where no rates in bounds meet the
    targets, a warning gives each domain's tokens above its target.  Rates come from the gradient iteration;
    with ``nearest`` its last step is solved for (``fit_rates``).
    """
    model = train(docs, labelled, max_rows=max_rows, key=key, text=text)
    members = written(memberships(docs, model, key, text))
    fit = fit_rates(members, model.names, targets, total=total, hold=hold, cap=cap, stretch=stretch, nearest=nearest)
    if fit.total != fit.asked:
        warnings.warn(f"targets can't be met at {fit.asked:.0f} tokens; they are at {fit.total:.0f}", stacklevel=2)
    if not fit.met:
        warnings.warn(f"no rates in bounds meet the targets; tokens above them: {fit.residual}", stacklevel=2)
    out = fit.members.select(
        key, "n_tokens", *[F.col("p")[k].alias(f"p_{x}") for k, x in enumerate(model.names)], F.round(fit.rates()["rate"], 9).alias("rate"),
        F.lit(float(fit.asked)).alias("asked"), F.lit(float(fit.total)).alias("total"),
    )
    return out.withColumn("copies", copies(key))


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], *, key: str = "doc_id", **more) -> DataFrame:
    """The rows of ``docs``, each as often as its rate says; the columns are those of ``docs``.

    Rows that share an id share its rate.  A row whose id is null stays once.
    """
    rates = rated(docs, labelled, targets, key=key, **more).where(F.col(key).isNotNull())
    n = rates.groupBy(F.col(key).alias("key")).agg(F.max("copies").alias("n"))
    found = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("key")).join(n, "key", "left")
    again = F.explode(F.sequence(F.lit(1), F.coalesce("n", F.lit(1))))
    return found.where("n is null or n > 0").select("row", again.alias("copy")).select("row.*")
