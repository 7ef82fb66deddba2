"""A small causal self-attention model in numpy: which component the next subword comes from.

A table S holds the weight of every index in each of K components: a subword id inside a word in the
lower half, one that opens a word in the upper half. Its columns, normalised within a half, are the
components' distributions; its rows, normalised, are the features of the indices met so far.
One masked attention head reads the features of a window and, with the last id's own features, gives
the chance of each component; the last component is a memory of what followed the word so far (see
subword_memory). An id's chance is the mixture, so every step is a true distribution.

Training takes every scored place once: a place's posterior over components adds to S by stepwise
expectation maximisation with a shrinking step, and the attention and gate matrices follow the exact
gradient of the log-likelihood by Adam. Windows overlap: each has CONTEXT places, and only the last
STRIDE of them are scored. Places before a text hold nothing: zero keys and zero values.
"""

from __future__ import annotations

import math

import numpy as np

K, HEAD, CONTEXT, STRIDE = 16, 8, 32, 24
SHAPES = {"W1": (K, K + 1), "W2": (HEAD, K + 1), "b": (K + 1,), "Q": (K, HEAD), "Kk": (K, HEAD), "V": (K, HEAD), "near": (CONTEXT,), "own": (2,)}


def windows(ids: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs [n, CONTEXT], targets [n, STRIDE], scored [n, STRIDE]) of one text's ids, the last of which is `end`.

    -1 stands for the places before the text, and targets after its end are 0 and not scored.
    """
    n = len(ids)
    count = -(-n // STRIDE)
    lead = CONTEXT - STRIDE
    seq = np.full(lead + count * STRIDE + 1, -1, np.int32)
    seq[lead] = end
    seq[lead + 1 : lead + 1 + n] = ids
    inputs = np.lib.stride_tricks.as_strided(seq, (count, CONTEXT), (STRIDE * 4, 4))
    targets = seq[lead + 1 :].reshape(count, STRIDE)
    return inputs, np.maximum(targets, 0), targets >= 0


def many_windows(ids: list[np.ndarray], end: int):
    return tuple(np.concatenate(x) for x in zip(*(windows(i, end) for i in ids)))


REACH = np.arange(CONTEXT - STRIDE, CONTEXT)[:, None] - np.arange(CONTEXT)[None, :]
BLOCKED = np.where(REACH >= 0, 0, -1e9).astype(np.float32)
REACH = np.maximum(REACH, 0)
ROW, ONES = np.arange(STRIDE), np.ones(K + 1, np.float32)  # sums over short last axes are faster as products with ones


def start(share: np.ndarray, seed: int = 7) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(S, parameters) before training; `share` is each id's share of training subwords."""
    rng = np.random.default_rng(seed)
    noise = rng.gamma(1.0, 1.0, (len(share), K)) + 0.05
    s = share[:, None] * noise / noise.sum(1, keepdims=True)
    w = {k: rng.normal(0, 0.3, n).astype(np.float32) for k, n in SHAPES.items()}
    w["b"][:] = 0
    w["b"][K] = math.log(K)
    w["near"][:] = 0
    w["own"][:] = 1, -1
    w["W1"][:, :K] += np.eye(K, dtype=np.float32)
    return (s / s.sum()).astype(np.float32), w


def of_kind(y: np.ndarray, n: int) -> np.ndarray:
    """1 for indices of the upper half of the table, which open words, else 0."""
    return (y >= n // 2).astype(np.int64)


def kinds(s: np.ndarray) -> np.ndarray:
    """Sums of each component over the indices of each kind; what follows is known to be of one kind."""
    return np.stack([s[: len(s) // 2].sum(0), s[len(s) // 2 :].sum(0)])


def features(rows: np.ndarray) -> np.ndarray:
    f = rows * (np.float32(math.sqrt(K)) / (rows.reshape(-1, K) @ ONES[:K])).reshape(*rows.shape[:-1], 1)
    f -= np.float32(1.0 / math.sqrt(K))
    return f


def raised(a: np.ndarray, some: np.ndarray) -> np.ndarray:
    """exp(a) in place, up to a factor for each row; `some` is one entry of every row.

    Sums of exponentials need no shift while the largest exponent of each row is between -40 and 40.
    """
    if a.max() > 40 or some.min() < -40:
        most = a.max(-1, keepdims=True)
        if max(most.max(), -most.min()) > 40:
            a -= most
    return np.exp(a, out=a)


def attend(w, last, q, k, v1, kind):
    """(component weights, their sums, attention weights, their sums, what is read); `last` is the gate's part from the last id.

    What follows is known to open a word (`kind` 1) or not, and the memory's weight depends on that.

    `v1` is the values and a column of ones, so that one product gives the reading and its sum.
    """
    n = len(k)
    a = np.matmul(q, k.transpose(0, 2, 1))
    a += w["near"][REACH] + BLOCKED
    raised(a, a[:, ROW, ROW + CONTEXT - STRIDE])
    read = np.matmul(a, v1)
    norm = read[..., HEAD:]
    c = read[..., :HEAD] / norm
    z = (c.reshape(-1, HEAD) @ w["W2"]).reshape(n, STRIDE, K + 1)
    z += last
    z[..., K] += w["own"][kind]
    raised(z, z[..., K])
    return z, (z.reshape(-1, K + 1) @ ONES).reshape(n, STRIDE), a, norm, c


class Scorer:
    """Chances under fixed weights: each id's query, key, value and gate part are computed once."""

    def __init__(self, s, w):
        f = features(s)
        none = lambda m: np.concatenate([m, np.zeros((1, m.shape[1]), np.float32)])  # noqa: E731  row -1: no id
        self.w = w
        self.q = none(f @ w["Q"])
        self.kv = np.concatenate([none(f @ np.concatenate([w["Kk"], w["V"]], 1)), np.ones((len(f) + 1, 1), np.float32)], 1)
        self.last = none(f @ w["W1"]) + w["b"]
        self.table = s / kinds(s)[of_kind(np.arange(len(s)), len(s))]

    def chances(self, x, y, known) -> np.ndarray:
        """Chance of each target; `known` is the memory's chance of it."""
        now = x[:, CONTEXT - STRIDE :]
        kv = self.kv.take(x, 0)
        z, norm, *_ = attend(self.w, self.last.take(now, 0), self.q.take(now, 0), kv[..., :HEAD], kv[..., HEAD:], of_kind(y, len(self.table)))
        p = np.einsum("nik,nik->ni", z[..., :K], self.table.take(y, 0))
        return (p + z[..., K] * known) / norm


def gradients(s, w, x, y, known, mask, total):
    """(mean log-likelihood's gradients, posteriors [scored, K], their ids)."""
    n = len(x)
    # The targets but the last are the inputs after the first scored place; those that are not scored do not count.
    rows = s.take(np.concatenate([x, y[:, -1:]], 1), 0)
    f = features(rows[:, :CONTEXT])
    f[x < 0] = 0
    last = f[:, CONTEXT - STRIDE :].reshape(-1, K)
    wide = f.reshape(-1, K)
    kv = (wide @ np.concatenate([w["Kk"], w["V"]], 1)).reshape(n, CONTEXT, 2 * HEAD)
    q = (last @ w["Q"]).reshape(n, STRIDE, HEAD)
    k, v = kv[..., :HEAD], kv[..., HEAD:]
    kind = of_kind(y, len(s))
    v1 = np.concatenate([v, np.ones((n, CONTEXT, 1), np.float32)], 2)
    z, sums, a, norm, c = attend(w, (last @ w["W1"] + w["b"]).reshape(n, STRIDE, K + 1), q, k, v1, kind)
    z /= sums[..., None]
    r = np.empty_like(z)
    np.multiply(z[..., :K], rows[:, CONTEXT - STRIDE + 1 :], out=r[..., :K])
    r[..., :K] *= (1 / total).take(kind, 0)
    np.multiply(z[..., K], known, out=r[..., K])
    r *= (1 / (r.reshape(-1, K + 1) @ ONES)).reshape(n, STRIDE, 1)
    d = (r - z).reshape(-1, K + 1)
    d *= mask.reshape(-1, 1) / np.float32(max(1, mask.sum()))
    own = np.bincount(kind.ravel(), d[:, K], 2).astype(np.float32)
    g = {"own": own, "W1": last.T @ d, "W2": c.reshape(-1, HEAD).T @ d, "b": d.sum(0)}
    dc = (d @ w["W2"].T).reshape(n, STRIDE, HEAD)
    ds = np.matmul(dc, v.transpose(0, 2, 1))
    ds -= np.einsum("nih,nih->ni", dc, c)[..., None]
    a /= norm
    ds *= a
    g["near"] = np.bincount(REACH.ravel(), ds.sum(0).ravel(), CONTEXT).astype(np.float32)
    g["Q"] = last.T @ np.matmul(ds, k).reshape(-1, HEAD)
    g["Kk"] = wide.T @ np.matmul(ds.transpose(0, 2, 1), q).reshape(-1, HEAD)
    g["V"] = wide.T @ np.matmul(a.transpose(0, 2, 1), dc).reshape(-1, HEAD)
    scored = np.flatnonzero(mask)
    return g, r.reshape(-1, K + 1).take(scored, 0)[:, :K], y.ravel().take(scored)


def train_unit(s0, w0, ids: list[np.ndarray], end: int, memory, at: float = 0.0, batch: int = 128, rate: float = 0.05):
    """Train on all windows of some texts; (rows of S touched, their new weights, factor of all other rows, parameters, places).

    `memory` gives the chances of the texts' ids; `at` is the number of batches before, from which steps go on shrinking.
    """
    x, y, mask = many_windows(ids, end)
    known = np.zeros(mask.shape, np.float32)
    known[mask] = memory(ids)
    s, flat = s0.copy(), np.concatenate([v.ravel() for v in w0.values()])  # all parameters in one array
    ends = np.cumsum([v.size for v in w0.values()])
    w = {k: part.reshape(v.shape) for (k, v), part in zip(w0.items(), np.split(flat, ends[:-1]))}
    m, u = np.zeros_like(flat), np.zeros_like(flat)
    total, scale = kinds(s), 1.0
    touched = np.zeros(len(s), bool)
    # Neighbouring windows are alike: a fixed shuffle mixes them.
    order = np.random.default_rng(len(x)).permutation(len(x))
    for t, i in enumerate(range(0, len(x), batch), 1):
        o = order[i : i + batch]
        g, r, ys = gradients(s, w, x[o], y[o], known[o], mask[o], total)
        # S <- (1 - step) S + step * posteriors, kept as a growing scale so that only touched rows change.
        step = 0.5 * (t + at + 2) ** -0.6
        scale /= 1 - step
        places = (len(ys) - 1).bit_length()
        ys = np.sort((ys.astype(np.int64) << places) | np.arange(len(ys)))
        by = ys & ((1 << places) - 1)
        ys >>= places
        first = np.flatnonzero(np.append(True, ys[1:] != ys[:-1]))
        add = np.add.reduceat(r.take(by, 0), first, axis=0) * np.float32(step * scale / len(ys))
        s[ys[first]] += add
        touched[ys[first]] = True
        cut = int(np.searchsorted(ys[first], len(s) // 2))
        total = total + np.stack([add[:cut].sum(0), add[cut:].sum(0)])
        lr = rate / math.sqrt(1 + (t + at) / 50)
        slope = np.concatenate([g[k].ravel() for k in w])
        m = 0.9 * m + 0.1 * slope
        u = 0.99 * u + 0.01 * slope**2
        flat += lr * (m / (1 - 0.9**t)) / (np.sqrt(u / (1 - 0.99**t)) + 1e-8)
        if scale > 1e6:
            s /= np.float32(scale)
            total = total / np.float32(scale)
            scale = 1.0
    rows = np.flatnonzero(touched)
    whole = float(s.sum(dtype=np.float64))
    others = float(s0[~touched].sum(dtype=np.float64))
    rest = float(s[~touched].sum(dtype=np.float64)) / others / whole if others else 0.0
    return rows, s[rows] / np.float32(whole), rest, w, int(mask.sum())
