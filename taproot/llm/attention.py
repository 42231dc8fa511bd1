"""A small causal self-attention language model over subword ids, in numpy: forward, gradients, Adam, scoring.

One layer: embeddings and places, one attention head, a tanh layer.  The id that follows is told in
digits of its corpus rank: ``a`` and ``b`` are softmaxes over the layer (``b`` gated by ``a``), the rest is its
share among the ids of one ``a, b`` by corpus counts.  Output biases begin as the logarithms of corpus
counts, so an untrained model is the corpus' unigram model, and probabilities sum to one by construction.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Positions of a window, and how many new ones each window scores; the others are its context.
WINDOW, STRIDE = 48, 32
DIM, HIDDEN, BASE = 16, 32, 40
#: Ids beyond this rank share an embedding with others of their residue.
OWN, SHARED = 4000, 96
LN10 = float(np.log(10.0))
#: Where the numbers of an embedding row lie among all.
SPOTS = np.arange((OWN + SHARED) * DIM).reshape(-1, DIM)


@dataclass(frozen=True)
class Codes:
    """What follows from corpus counts of ids: digits, embedding rows and fixed shares."""

    a: np.ndarray
    b: np.ndarray
    rest: np.ndarray
    row: np.ndarray
    bias_a: np.ndarray
    bias_b: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> Codes:
        """From the count of each id, with one added so that no id is impossible."""
        rank = np.empty(len(counts), np.int64)
        rank[np.lexsort((np.arange(len(counts)), -counts))] = np.arange(len(counts))
        a, b = rank % BASE, rank // BASE % BASE
        n = counts.astype(float) + 1
        cell = np.bincount(a * BASE + b, n, BASE * BASE).reshape(BASE, BASE)
        log = lambda x: np.log(np.maximum(x, 1e-30)).astype(np.float32)
        row = np.where(rank < OWN, rank, OWN + rank % SHARED)
        total = cell.sum(axis=1)
        return Codes(a, b, np.log(n / cell[a, b]), row, log(total / total.sum()), log(cell / np.maximum(total, 1e-30)[:, None]))


def initial(codes: Codes, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights before training; heads are zero, so that only the biases speak."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
    return {
        "embed": (rng.normal(size=(OWN + SHARED, DIM)) * 0.5).astype(np.float32), "place": (rng.normal(size=(WINDOW, DIM)) * 0.1).astype(np.float32),
        "query": draw(DIM, DIM), "key": draw(DIM, DIM), "value": draw(DIM, DIM), "out": draw(DIM, DIM), "layer": draw(DIM, HIDDEN), "shift": np.zeros(HIDDEN, np.float32),
        "head_a": np.zeros((HIDDEN, BASE), np.float32), "bias_a": codes.bias_a.copy(),
        "gate": np.ones((BASE, HIDDEN), np.float32), "head_b": np.zeros((HIDDEN, BASE), np.float32), "bias_b": codes.bias_b.copy(),
    }


def flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in sorted(weights)])


def shaped(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = values[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


#: Attention logits are kept within this bound, so that their exponentials need no shift.
CLIP = np.float32(60)


def projections(w: dict[str, np.ndarray]) -> np.ndarray:
    """Weights of query, key and value side by side, so that one product gives all three; queries are scaled."""
    return np.concatenate([w["query"] * np.float32(1 / np.sqrt(DIM)), w["key"], w["value"]], axis=1)


@lru_cache(maxsize=8)
def causal(rows: int, columns: int, kind: np.dtype) -> np.ndarray:
    """One where the column is not later than the row, both counted from their ends."""
    return np.tri(rows, columns, columns - rows, dtype=kind)


def attended(q: np.ndarray, k: np.ndarray, seen: np.ndarray | None, small: bool = False) -> np.ndarray:
    """Shares of the positions ``k`` in each of ``q``, the last of them, of each window; ``seen`` masks padding.

    A position attends to itself and to earlier ones that are there.  ``small`` promises logits within ``CLIP``.
    """
    att = q @ k.transpose(0, 2, 1)
    if not small:
        np.clip(att, -CLIP, CLIP, out=att)
    np.exp(att, out=att)
    att *= causal(q.shape[1], k.shape[1], att.dtype)
    if seen is not None:
        att *= seen[:, None, :]
    return att


def totals(att: np.ndarray) -> np.ndarray:
    """Sums of the last axis, kept, and never zero."""
    return (att.reshape(-1, att.shape[2]) @ np.ones(att.shape[2], att.dtype)).reshape(*att.shape[:2], 1) + np.float32(1e-30)


def by_row(w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of every embedding and of every place: itself, query, key and value, the last on its way out.

    All four are linear, so those of a position are the sum of two rows, and no window needs products for them.
    """
    some = projections(w)
    some[:, 2 * DIM :] = some[:, 2 * DIM :] @ w["out"]
    return tuple(np.concatenate([t, t @ some], axis=1) for t in (w["embed"], w["place"]))


def hidden(w: dict[str, np.ndarray], tables: tuple[np.ndarray, np.ndarray], rows: np.ndarray, opening: np.ndarray, first: int, small: bool = False) -> np.ndarray:
    """The layer at positions ``first ..`` of windows of embedding ``rows``; ``tables`` are those of ``by_row``.

    Windows ``opening`` begin a document at ``first``, with nothing before it.  ``small`` promises logits within ``CLIP``.
    """
    each = tables[0].take(rows, axis=0)
    each += tables[1][: rows.shape[1]]
    x, q, k, v = (each[:, :, i * DIM : (i + 1) * DIM] for i in range(4))
    att = attended(q[:, first:], k, None, small)
    att[opening, :, :first] = 0
    mid = att @ v
    mid /= totals(att)
    mid += x[:, first:]
    z = mid.reshape(-1, DIM) @ (w["layer"] * np.float32(-2))
    z -= 2 * w["shift"]
    return bent(z)


def is_near(tables: tuple[np.ndarray, np.ndarray]) -> bool:
    """Whether no attention logit can pass ``CLIP``: lengths of queries and keys bound their products."""
    long = lambda i: sum(float(np.sqrt(np.square(t[:, i * DIM : (i + 1) * DIM]).sum(axis=1).max())) for t in tables)
    return long(1) * long(2) < CLIP


def within(total: np.ndarray) -> bool:
    """Whether sums of exponentials that were taken without a shift are exact enough, or there are none."""
    return len(total) == 0 or bool(total.min() > 1e-30 and total.max() < 1e30)


@np.errstate(over="ignore")
def log_probs(w: dict[str, np.ndarray], h: np.ndarray, codes: Codes, target: np.ndarray) -> np.ndarray:
    """Natural log-probability of each target id, given the layer before it."""
    a, b = codes.a[target], codes.b[target]
    out = codes.rest[target]

    def logits() -> tuple[np.ndarray, np.ndarray]:
        left = h @ w["head_a"]
        left += w["bias_a"]
        right = w["gate"].take(a, axis=0)
        right *= h
        right = right @ w["head_b"]
        right += w["bias_b"].take(a, axis=0)
        return left, right

    for i, (z, digit) in enumerate(zip(logits(), (a, b), strict=True)):
        at = np.arange(0, z.size, BASE) + digit
        picked = z.reshape(-1).take(at)
        np.exp(z, out=z)
        total = z @ np.ones(BASE, z.dtype)
        if not within(total):
            z = logits()[i]
            z -= z.max(axis=1, keepdims=True)
            picked = z.reshape(-1).take(at)
            total = np.exp(z) @ np.ones(BASE, z.dtype)
        out += picked
        out -= np.log(total)
    return out


def joint(*parts: np.ndarray) -> np.ndarray:
    """Weights of a layer over its bias, for inputs whose last column is one."""
    return np.concatenate([x.reshape(-1, parts[0].shape[1]) for x in parts])


def bent(z: np.ndarray) -> np.ndarray:
    """tanh, given -2 times its argument, in place; one exponential is faster than numpy's tanh."""
    np.exp(z, out=z)
    z += 1
    np.divide(2, z, out=z)
    z -= 1
    return z


def errors(z: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the mean loss by the logits ``z``, in place, and the share of the target ``at``, a place in all of ``z``, of each row.

    Exponentials are taken without a shift; where that goes too far, ``FloatingPointError`` is raised.
    """
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], z.dtype)
    if not within(total):
        raise FloatingPointError
    share = z.reshape(-1).take(at)
    share /= total
    one = z.dtype.type(1 / max(len(z), 1))
    np.divide(one, total, out=total)
    z *= total[:, None]
    z.reshape(-1)[at] = (share - 1) * one
    return z, share


@np.errstate(over="ignore")
def gradients(w: dict[str, np.ndarray], codes: Codes, ids: np.ndarray, seen: np.ndarray) -> tuple[float, int, dict[str, np.ndarray]]:
    """Sum of losses, number of targets and mean gradients over windows of ids; column ``i + 1`` is the target of ``i``.

    ``seen`` says which ids are there; a target counts if it is.
    """
    rows, target, on = codes.row[ids[:, :-1]], ids[:, 1:].ravel(), seen[:, 1:].ravel()
    many, width = rows.shape
    kind = w["embed"].dtype
    n = int(np.count_nonzero(on))
    # targets that count, those of one first digit together: their gates and biases repeat, their gradients are sums of runs
    order = np.where(on, codes.a[target], BASE).astype(np.uint8).argsort(kind="stable")[:n]
    target = target[order]
    a, b = codes.a[target], codes.b[target]
    many_a = np.bincount(a, minlength=BASE)
    x = w["embed"].take(rows, axis=0)
    x += w["place"][:width]
    flat_x = x.reshape(-1, DIM)
    # queries meet keys and values go out by one product each, so that positions themselves are the keys
    scale = kind.type(1 / np.sqrt(DIM))
    some = np.concatenate([w["query"] @ w["key"].T * scale, w["value"] @ w["out"]], axis=1)
    each = (flat_x @ some).reshape(many, width, 2 * DIM)
    q, v = each[:, :, :DIM], each[:, :, DIM:]
    # what is not there hides itself where it only follows what is
    att = attended(q, x, None if (seen[:, 1:] <= seen[:, :-1]).all() else seen[:, :-1])
    # rows of att aren't divided by their totals, what comes out of them and goes in again is
    total = totals(att)
    mix = att @ v
    mix /= total
    mix = mix.reshape(-1, DIM)
    mid = np.ones((many * width, DIM + 1), kind)
    np.add(mix, flat_x, out=mid[:, :DIM])
    mid = mid.take(order, axis=0)
    h = bent(mid @ (joint(w["layer"], w["shift"]) * kind.type(-2)))
    h_one = np.ones((n, HIDDEN + 1), kind)
    h_one[:, :HIDDEN] = h
    gate = w["gate"].repeat(many_a, axis=0)
    gated = h * gate
    z = h_one @ joint(w["head_a"], w["bias_a"])
    y = gated @ w["head_b"]
    y += w["bias_b"].repeat(many_a, axis=0)
    at = np.arange(0, n * BASE, BASE)
    at_a, at_b = at + a, at + b
    try:
        (pa, left), (pb, right) = errors(z, at_a), errors(y, at_b)
    except FloatingPointError:
        z, y = h_one @ joint(w["head_a"], w["bias_a"]), gated @ w["head_b"] + w["bias_b"][a]
        (pa, left), (pb, right) = (errors(x - x.max(axis=1, keepdims=True), i) for x, i in ((z, at_a), (y, at_b)))
    left *= right
    loss = -float((np.log(np.maximum(left, np.finfo(kind).tiny)) + codes.rest[target]).sum())
    both = h_one.T @ pa
    g = {"head_a": both[:HIDDEN], "bias_a": both[HIDDEN]}
    # the second digit's gradients all follow from products of the layer and errors, summed for each first digit
    sums, end = np.zeros((BASE, HIDDEN + 1, BASE), kind), 0
    for i, some_a in enumerate(many_a.tolist()):
        if some_a:
            np.matmul(h_one[end : end + some_a].T, pb[end : end + some_a], out=sums[i])
            end += some_a
    g["bias_b"] = sums[:, HIDDEN]
    g["gate"] = np.einsum("ajk,jk->aj", sums[:, :HIDDEN], w["head_b"])
    g["head_b"] = np.einsum("aj,ajk->jk", w["gate"], sums[:, :HIDDEN])
    d_gated = pb @ w["head_b"].T
    d_gated *= gate
    dz = pa @ w["head_a"].T
    dz += d_gated
    np.multiply(h, h, out=gated)
    np.subtract(1, gated, out=gated)
    dz *= gated
    both = mid.T @ dz
    g |= {"layer": both[:DIM], "shift": both[DIM]}
    found = np.zeros((n + 1, DIM), kind)
    np.matmul(dz, w["layer"].T, out=found[:n])
    back = np.full(many * width, n)
    back[order] = np.arange(n)
    d_mid = found.take(back, axis=0)
    # the sum of a row's shares times their gradients is that of its mix times the mix's
    own = np.einsum("ij,ij->i", d_mid, mix).reshape(many, width, 1)
    own /= total
    d_mix = d_mid.reshape(many, width, DIM) / total
    ds = d_mix @ v.transpose(0, 2, 1)
    ds -= own
    ds *= att
    d = np.empty((many, width, 2 * DIM), kind)
    np.matmul(ds, x, out=d[:, :, :DIM])
    np.matmul(att.transpose(0, 2, 1), d_mix, out=d[:, :, DIM:])
    d_mid += (ds.transpose(0, 2, 1) @ q).reshape(-1, DIM)
    d = d.reshape(-1, 2 * DIM)
    by_q, by_v = np.split(flat_x.T @ d, 2, axis=1)
    by_q *= scale
    g |= {"query": by_q @ w["key"], "key": by_q.T @ w["query"], "value": by_v @ w["out"].T, "out": w["value"].T @ by_v}
    dx = d @ some.T
    dx += d_mid
    g["place"] = np.zeros_like(w["place"])
    g["place"][:width] = dx.reshape(many, width, DIM).sum(axis=0)
    g["embed"] = np.zeros_like(w["embed"])
    np.add.at(g["embed"].reshape(-1), SPOTS.take(rows, axis=0).reshape(-1), dx.reshape(-1))
    return loss, n, g


def fitted(w: dict[str, np.ndarray], codes: Codes, ids: np.ndarray, seen: np.ndarray, rate: float = 0.01, batch: int = 48) -> tuple[dict[str, np.ndarray], float, int]:
    """One pass of Adam over windows, in a fixed random order; the rate falls to a tenth towards the end.

    All weights lie in one array, so that a step is a few passes over it.
    """
    values = flat(w)
    w = shaped(values, w)
    g, first, second, rest = (np.zeros_like(values) for _ in range(4))
    parts = shaped(g, w)
    order = np.random.default_rng(len(ids)).permutation(len(ids))
    steps, loss, tokens = -(-len(ids) // batch), 0.0, 0
    # pieces that stay in the cache through a step's passes
    pieces = [tuple(x[i : i + 8192] for x in (values, g, first, second, rest)) for i in range(0, len(values), 8192)]
    for t in range(steps):
        some = order[t * batch : (t + 1) * batch]
        lost, n, found = gradients(w, codes, ids[some], seen[some])
        loss, tokens = loss + lost, tokens + n
        for k, x in found.items():
            parts[k][...] = x
        now = np.float32(rate * (1 - 0.9 * t / steps) / (1 - 0.9 ** (t + 1)))
        long = np.float32(1 / np.sqrt(1 - 0.98 ** (t + 1)))
        for v, d, m, s, r in pieces:
            np.subtract(d, m, out=r)
            r *= np.float32(0.1)
            m += r
            d *= d
            d -= s
            d *= np.float32(0.02)
            s += d
            np.sqrt(s, out=r)
            r *= long
            r += np.float32(1e-8)
            np.divide(m, r, out=r)
            r *= now
            v -= r
    return w, loss, tokens


def scores(w: dict[str, np.ndarray], codes: Codes, ids: np.ndarray, sizes: np.ndarray, end: int, chunk: int = 48) -> np.ndarray:
    """Log10 probability of each document; ``ids`` are those of all, ``sizes`` their numbers, each closed by ``end``.

    Windows of ``WINDOW`` positions follow each other by ``STRIDE``; each scores its last ``STRIDE`` positions, so that
    every id is scored once, with the ids before it in its window, a document's first after ``end``.
    """
    starts = np.cumsum(sizes) - sizes
    windows = -(-sizes // STRIDE)
    owner = np.repeat(np.arange(len(sizes)), windows)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    low = starts[owner] + nth * STRIDE
    many = np.minimum(sizes[owner] - nth * STRIDE, STRIDE)  # positions that a window scores; those of all follow each other
    context = WINDOW - STRIDE
    # the input at a position is the id before it, a document's first ``end``; what follows a document is later than all that is scored
    row = np.full(len(ids) + WINDOW, codes.row[end])
    row[context + 1 : context + len(ids)] = codes.row[ids[:-1]]
    row[context + starts] = codes.row[end]
    around = np.lib.stride_tricks.sliding_window_view(row, WINDOW)
    tables = by_row(w)
    near = is_near(tables)
    out, reach = np.empty(len(ids)), np.arange(STRIDE)
    for s in range(0, len(owner), chunk):
        cut = slice(s, s + chunk)
        h = hidden(w, tables, around[low[cut]], np.flatnonzero(nth[cut] == 0), context, near)
        begin, close = low[cut][0], low[cut][-1] + many[cut][-1]
        if close - begin < len(h):
            h = h[(reach < many[cut, None]).ravel()]
        out[begin:close] = log_probs(w, h, codes, ids[begin:close])
    return np.add.reduceat(out, starts) / LN10 if len(ids) else np.zeros(len(sizes))
