"""Character tagger: a bidirectional LSTM whose emissions are decoded by a CRF, in numpy.

Characters index the input weights directly, so a step costs one small matrix product. Many windows advance side by
side. The same forward pass serves training and tagging.
"""

from __future__ import annotations

import numpy as np

from tidewell.llm.pii_labels import KINDS

TAGS = ["O", *[f"{x}-{k}" for k in KINDS for x in "BI"]]
K = len(TAGS)
#: Character classes: code points below LIMIT have one each, the rest share a few.
LIMIT = 384
VOCAB = LIMIT + 6
HIDDEN = 40


def _rest() -> np.ndarray:
    table = np.full(0x3000, LIMIT, dtype=np.int16)
    table[:LIMIT] = np.arange(LIMIT)
    table[[0x2010, 0x2011, 0x2012, 0x2013, 0x2014, 0x00AC, 0x00AD]] = LIMIT + 1
    table[[0x2018, 0x2019, 0x201A, 0x201C, 0x201D, 0x201E]] = LIMIT + 2
    table[[0x2002, 0x2003, 0x2009, 0x202F, 0x00A0]] = LIMIT + 3
    table[0x20AC] = LIMIT + 4
    return table


_TABLE = _rest()


def codes(text: str) -> np.ndarray:
    """Class of every code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return _TABLE[np.minimum(points, len(_TABLE) - 1)]


def new_weights(seed: int = 0, hidden: int = HIDDEN) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    w: dict[str, np.ndarray] = {}
    for d in "fb":
        w[f"x{d}"] = r.normal(0, 0.1, (VOCAB, 4 * hidden))
        w[f"x{d}"][:, hidden : 2 * hidden] += 1.0  # forget gates start open
        w[f"h{d}"] = r.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
    w["o"] = r.normal(0, 0.1, (2 * hidden, K))
    w["c"] = np.zeros(K)
    w["t"] = np.zeros((K, K))
    return {k: v.astype(np.float32) for k, v in w.items()}


def forbidden() -> np.ndarray:
    """Transition scores that exclude an I without its B or I before it."""
    bad = np.zeros((K, K), dtype=np.float32)
    for j, t in enumerate(TAGS):
        if t[0] == "I":
            bad[[i for i in range(K) if TAGS[i] not in (t, "B" + t[1:])], j] = -1e4
    return bad


def _gates(z: np.ndarray, h: int) -> None:
    """In place: sigmoid of the first three quarters (as a tanh, which is faster), tanh of the last."""
    z[:, : 3 * h] *= 0.5
    np.tanh(z, out=z)
    z[:, : 3 * h] *= 0.5
    z[:, : 3 * h] += 0.5


def doubled(w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Weights for ``run_doubled``, whose states and gates are twice those of ``run``: the halves are taken once, here."""
    h = w["hf"].shape[0]
    out = dict(w)
    for d in "fb":
        x, r = w["x" + d].copy(), w["h" + d] * np.float32(0.5)
        x[:, : 3 * h] *= 0.5
        r[:, : 3 * h] *= 0.5
        out["x" + d], out["h" + d] = x, np.ascontiguousarray(r)
    out["o"] = w["o"] * np.float32(0.5)
    out["doubled"] = np.bool_(True)
    return out


def run_doubled(x: np.ndarray, wx: np.ndarray, wh: np.ndarray) -> np.ndarray:
    """As ``run`` without what training needs, with ``doubled`` weights: a sigmoid is then a tanh plus one."""
    steps, batch = x.shape
    h = wh.shape[0]
    out = np.empty((steps, batch, h), dtype=np.float32)
    s, c = np.zeros((batch, h), dtype=np.float32), np.zeros((batch, h), dtype=np.float32)
    z, given, th = np.empty((batch, 4 * h), dtype=np.float32), np.empty((batch, 4 * h), dtype=np.float32), np.empty((batch, h), dtype=np.float32)
    enter, keep, leave, new, three = z[:, :h], z[:, h : 2 * h], z[:, 2 * h : 3 * h], z[:, 3 * h :], z[:, : 3 * h]
    half = np.float32(0.5)
    for t in range(steps):
        np.matmul(s, wh, out=z)
        np.take(wx, x[t], axis=0, out=given, mode="clip")
        z += given
        np.tanh(z, out=z)
        three += 1
        c *= keep
        c *= half
        np.multiply(enter, new, out=th)
        c += th
        np.multiply(c, half, out=th)
        np.tanh(th, out=th)
        s = out[t]
        np.multiply(leave, th, out=s)
    return out


def run(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, keep: list | None = None) -> np.ndarray:
    """One direction over windows x (time, batch) of classes; returns hidden states (time, batch, hidden)."""
    steps, batch = x.shape
    h = wh.shape[0]
    out = np.empty((steps, batch, h), dtype=np.float32)
    s, c = np.zeros((batch, h), dtype=np.float32), np.zeros((batch, h), dtype=np.float32)
    z, given, added, th = np.empty((batch, 4 * h), dtype=np.float32), np.empty((batch, 4 * h), dtype=np.float32), np.empty((batch, h), dtype=np.float32), np.empty((batch, h), dtype=np.float32)
    for t in range(steps):
        np.matmul(s, wh, out=z)
        np.take(wx, x[t], axis=0, out=given, mode="clip")
        z += given
        _gates(z, h)
        before = c.copy() if keep is not None else None
        c *= z[:, h : 2 * h]
        np.multiply(z[:, :h], z[:, 3 * h :], out=added)
        c += added
        np.tanh(c, out=th)
        s = out[t]
        np.multiply(z[:, 2 * h : 3 * h], th, out=s)
        if keep is not None:
            keep.append((z.copy(), before, th.copy()))
    return out


def emissions(x: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """Tag scores (time, batch, tag) of windows x (time, batch)."""
    one = run_doubled if "doubled" in w else run
    f = one(x, w["xf"], w["hf"])
    b = one(x[::-1], w["xb"], w["hb"])[::-1]
    h = f.shape[2]
    return f @ w["o"][:h] + b @ w["o"][h:] + w["c"]


def viterbi(e: np.ndarray, n: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best tags (time, batch) of emissions (time, batch, tag); sequences have n valid steps, the rest is 0.

    The way forward keeps scores only; which tag a best one came from is worked out on the way back, along the best path.
    """
    steps, batch, _ = e.shape
    e = np.ascontiguousarray(e.transpose(0, 2, 1))
    score = np.empty((steps, K, batch), dtype=np.float32)
    score[0] = e[0] + np.where([t[0] == "I" for t in TAGS], np.float32(-1e4), np.float32(0))[:, None]
    wide, both = trans.astype(np.float32)[:, :, None], np.empty((K, K, batch), dtype=np.float32)
    for t in range(1, steps):
        np.add(score[t - 1][:, None, :], wide, out=both)
        np.max(both, axis=0, out=score[t])
        score[t] += e[t]
    tags = np.zeros((steps, batch), dtype=np.int8)
    rows, back = np.arange(batch), np.ascontiguousarray(trans.astype(np.float32).T)
    now = score[n - 1, :, rows].argmax(axis=1)
    tags[n - 1, rows] = now
    for t in range(steps - 1, 0, -1):
        inside = t < n
        now = np.where(inside, (score[t - 1].T + back[now]).argmax(axis=1), now)
        tags[t - 1, inside] = now[inside]
    return tags


# --- training ----------------------------------------------------------------------------------------------------------


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - m).sum(axis=axis, keepdims=True)) + m).squeeze(axis)


def loss_and_gradient(x: np.ndarray, y: np.ndarray, w: dict[str, np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
    """CRF negative log-likelihood per character of windows x with tags y (time, batch), and its gradient."""
    steps, batch = x.shape
    kf: list = []
    kb: list = []
    f, b = run(x, w["xf"], w["hf"], kf), run(x[::-1], w["xb"], w["hb"], kb)
    h = f.shape[2]
    hidden = np.concatenate([f, b[::-1]], axis=2)
    e = hidden @ w["o"] + w["c"]
    trans = w["t"] + forbidden()
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0]
    for t in range(1, steps):
        alpha[t] = _lse(alpha[t - 1][:, :, None] + trans, 1) + e[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = _lse(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    z = _lse(alpha[-1], 1)
    de = np.exp(alpha + beta - z[None, :, None])
    pair = alpha[:-1, :, :, None] + trans + (e[1:] + beta[1:])[:, :, None, :] - z[None, :, None, None]
    dt = np.exp(pair).sum(axis=(0, 1))
    ti, bi = np.meshgrid(np.arange(steps), np.arange(batch), indexing="ij")
    gold = e[ti, bi, y].sum() + trans[y[:-1], y[1:]].sum()
    de[ti, bi, y] -= 1
    np.add.at(dt, (y[:-1].ravel(), y[1:].ravel()), -1)
    scale = 1.0 / (steps * batch)
    loss = (z.sum() - gold) * scale
    de = (de * scale).astype(np.float32)
    g = {"t": (dt * scale).astype(np.float32), "c": de.sum(axis=(0, 1)), "o": hidden.reshape(-1, 2 * h).T @ de.reshape(-1, K)}
    dh = de @ w["o"].T
    for d, keep, xs, out, grad in (("f", kf, x, f, dh[:, :, :h]), ("b", kb, x[::-1], b, dh[::-1, :, h:])):
        wh = w[f"h{d}"]
        ds, dc = np.zeros((batch, h), dtype=np.float32), np.zeros((batch, h), dtype=np.float32)
        dz_all = np.empty((steps, batch, 4 * h), dtype=np.float32)
        for t in range(steps - 1, -1, -1):
            gate, before, th = keep[t]
            i, fo, o, c = gate[:, :h], gate[:, h : 2 * h], gate[:, 2 * h : 3 * h], gate[:, 3 * h :]
            ds = ds + grad[t]
            dc = dc + ds * o * (1 - th * th)
            dz = dz_all[t]
            dz[:, :h] = dc * c * i * (1 - i)
            dz[:, h : 2 * h] = dc * before * fo * (1 - fo)
            dz[:, 2 * h : 3 * h] = ds * th * o * (1 - o)
            dz[:, 3 * h :] = dc * i * (1 - c * c)
            dc = dc * fo
            ds = dz @ wh.T
        prev = np.concatenate([np.zeros((1, batch, h), dtype=np.float32), out[:-1]])
        g[f"h{d}"] = prev.reshape(-1, h).T @ dz_all.reshape(-1, 4 * h)
        flat = xs.reshape(-1)
        order = np.argsort(flat, kind="stable")
        used, first = np.unique(flat[order], return_index=True)
        gx = np.zeros((VOCAB, 4 * h), dtype=np.float32)
        gx[used] = np.add.reduceat(dz_all.reshape(-1, 4 * h)[order], first, axis=0)
        g[f"x{d}"] = gx
    return float(loss), g
