"""Gated recurrent language model in numpy with a class-factored softmax.

Word ids are ranks by frequency; word i is member ``i % width`` of class ``i // width``, and its probability is that
of the class times that of the member in its class. Training is truncated backpropagation: lanes of a long id stream
are cut into windows, gradients stop at a window's start and the state is carried on. The state is cleared wherever
the input is the end id, so a text's score does not depend on what was before it.
"""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]


def shapes(classes: int, width: int, embed: int, hidden: int) -> dict[str, tuple[int, ...]]:
    return {"emb": (classes * width, embed), "wx": (embed, 3 * hidden), "bx": (3 * hidden,), "u": (hidden, 3 * hidden), "bn": (hidden,), "wc": (hidden, classes), "bc": (classes,), "wo": (classes, hidden, width), "bo": (classes, width)}


def start(counts: np.ndarray, width: int, embed: int = 16, hidden: int = 24, seed: int = 1) -> Params:
    """Small random weights; the output biases give the words' shares of ``counts``."""
    classes = len(counts) // width
    rng = np.random.default_rng(seed)
    p = {k: (rng.standard_normal(s) * (0.3 if k == "emb" else 0.15)).astype(np.float32) for k, s in shapes(classes, width, embed, hidden).items()}
    share = (counts + 0.5).reshape(classes, width) / (counts + 0.5).sum()
    p["bc"] = np.log(share.sum(axis=1)).astype(np.float32)
    p["bo"] = np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32)
    for k in ("bx", "bn"):
        p[k][:] = 0
    for k in ("wc", "wo"):
        p[k] *= 0.3
    return p


def pack(p: Params) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def unpack(flat: np.ndarray, classes: int, width: int, embed: int, hidden: int) -> Params:
    out, at = {}, 0
    for k, s in sorted(shapes(classes, width, embed, hidden).items()):
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def _softmax_at(x: np.ndarray, at: np.ndarray, grad: bool) -> np.ndarray:
    """Scores (words x rows) to ln p of the words ``at``; with ``grad``, ``x`` becomes p minus the words' indicator."""
    x -= x.max(axis=0)
    rows = np.arange(x.shape[1])
    picked = x[at, rows].astype(np.float64)
    np.exp(x, out=x)
    total = x.sum(axis=0)
    if grad:
        x /= total
        x[at, rows] -= 1
    return picked - np.log(total)


def log_probs(p: Params, h: np.ndarray, y: np.ndarray, grads: Params | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """ln p of the words ``y`` after the states ``h`` (hidden x rows); with ``grads``, adds gradients of the mean loss
    to it and returns the gradient of the states as well."""
    width, n = p["bo"].shape[1], len(y)
    of, member = y // width, y % width
    x = p["wc"].T @ h + p["bc"][:, None]
    out = _softmax_at(x, of, grads is not None)
    dh = None
    if grads is not None:
        x /= n
        grads["wc"] += h @ x.T
        grads["bc"] += x.sum(axis=1)
        dh = (p["wc"] @ x).T.copy()
    rows = np.ascontiguousarray(h.T)
    order = np.argsort(of.astype(np.uint16), kind="stable")
    ends = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=p["bc"].size))))
    for c in np.flatnonzero(np.diff(ends)):
        idx = order[ends[c] : ends[c + 1]]
        hc = rows[idx]
        x = p["wo"][c].T @ hc.T + p["bo"][c][:, None]
        out[idx] += _softmax_at(x, member[idx], grads is not None)
        if grads is not None:
            x /= n
            grads["wo"][c] += hc.T @ x.T
            grads["bo"][c] += x.sum(axis=1)
            dh[idx] += (p["wo"][c] @ x).T
    return out, None if dh is None else dh.T


def window(p: Params, x: np.ndarray, y: np.ndarray, h: np.ndarray, end: int) -> tuple[float, np.ndarray, Params]:
    """One window of inputs and targets (steps x lanes) from state ``h`` (hidden x lanes): mean loss, last state,
    gradients. Arrays are feature-major, so that every operation runs along the lanes."""
    steps, lanes = x.shape
    hid = h.shape[0]
    kind = h.dtype
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    xe = p["emb"][x.ravel()]
    xp = (p["wx"].T @ xe.T + p["bx"][:, None]).reshape(3 * hid, steps, lanes)
    keep = (x != end).astype(kind)
    prev, cand, inner, hs = (np.empty((hid, steps, lanes), kind) for _ in range(4))
    zr = np.empty((2 * hid, steps, lanes), kind)
    ut = np.ascontiguousarray(p["u"].T)
    for t in range(steps):
        hp = h * keep[t]
        prev[:, t] = hp
        hu = ut @ hp
        hu[2 * hid :] += p["bn"][:, None]
        gate = _sigmoid(hu[: 2 * hid] + xp[: 2 * hid, t])
        zr[:, t], inner[:, t] = gate, hu[2 * hid :]
        n = gate[hid:] * hu[2 * hid :]
        n += xp[2 * hid :, t]
        np.tanh(n, out=n)
        cand[:, t] = n
        hp -= n
        hp *= gate[:hid]
        hp += n
        h = hp
        hs[:, t] = h
    logs, dhs = log_probs(p, hs.reshape(hid, -1), y.ravel(), grads)
    dhs = np.ascontiguousarray(dhs).reshape(hid, steps, lanes)
    # what does not depend on the way back is done for all steps at once
    z, r = zr[:hid], zr[hid:]
    to_n = (1 - z) * (1 - cand * cand)
    to_z = (prev - cand) * z * (1 - z)
    to_r = inner * r * (1 - r)
    dall = np.empty((4 * hid, steps, lanes), kind)  # z, r, candidate; last: the candidate's state part
    back = np.zeros((hid, lanes), kind)
    u = p["u"]
    for t in range(steps - 1, -1, -1):
        dh = dhs[:, t] + back
        dn = dh * to_n[:, t]
        d = np.empty((3 * hid, lanes), kind)
        np.multiply(dh, to_z[:, t], out=d[:hid])
        np.multiply(dn, to_r[:, t], out=d[hid : 2 * hid])
        np.multiply(dn, r[:, t], out=d[2 * hid :])
        dall[: 2 * hid, t], dall[2 * hid : 3 * hid, t], dall[3 * hid :, t] = d[: 2 * hid], dn, d[2 * hid :]
        dh *= z[:, t]
        dh += u @ d
        dh *= keep[t]
        back = dh
    flat = dall.reshape(4 * hid, -1)
    before = prev.reshape(hid, -1)
    grads["u"][:, : 2 * hid] += before @ flat[: 2 * hid].T
    grads["u"][:, 2 * hid :] += before @ flat[3 * hid :].T
    grads["bn"] += flat[3 * hid :].sum(axis=1)
    grads["wx"] += (flat[: 3 * hid] @ xe).T
    grads["bx"] += flat[: 3 * hid].sum(axis=1)
    dx = (p["wx"] @ flat[: 3 * hid]).T
    order = np.argsort(x.ravel().astype(np.uint16) if p["emb"].shape[0] <= 65536 else x.ravel(), kind="stable")
    words, first = np.unique(x.ravel()[order], return_index=True)
    grads["emb"][words] += np.add.reduceat(dx[order], first, axis=0)
    return -logs.mean(), h, grads


def train(p: Params, ids: np.ndarray, end: int, lanes: int = 256, steps: int = 32, rate: float = 0.015, clip: float = 1.0) -> Params:
    """One pass over a stream of ids (texts, each closed by ``end``) with Adam; returns new parameters."""
    p = {k: v.copy() for k, v in p.items()}
    lanes = max(1, min(lanes, len(ids) // (8 * steps)))
    per = len(ids) // lanes
    if per < 1:
        return p
    y = ids[: per * lanes].reshape(lanes, per).T.astype(np.int64)
    before = np.concatenate(([end], ids[per - 1 : per * lanes - 1 : per])) if lanes > 1 else np.array([end])
    x = np.concatenate((before[None, :], y[:-1])).astype(np.int64)
    h = np.zeros((p["u"].shape[0], lanes), np.float32)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    for step, at in enumerate(range(0, per, steps), 1):
        _, h, g = window(p, x[at : at + steps], y[at : at + steps], h, end)
        norm = float(np.sqrt(sum(float((a * a).sum()) for a in g.values())))
        scale = min(1.0, clip / max(norm, 1e-12))
        now = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step) * max(0.1, 1 - at / per)
        for k, a in g.items():
            a *= scale
            m[k] += 0.1 * (a - m[k])
            v[k] += 0.001 * (a * a - v[k])
            p[k] -= now * m[k] / (np.sqrt(v[k]) + 1e-8)
    return p


def score(p: Params, texts: list[np.ndarray], end: int, lanes: int = 512, steps: int = 64) -> np.ndarray:
    """ln p of complete texts (each closed by ``end``). Texts of like length run side by side, the state goes from
    window to window, and finished texts leave their lanes."""
    hid = p["u"].shape[0]
    table = np.ascontiguousarray((p["emb"] @ p["wx"] + p["bx"]).T)
    ut, bn = np.ascontiguousarray(p["u"].T), p["bn"][:, None]
    out = np.zeros(len(texts))
    order = np.argsort([-len(t) for t in texts], kind="stable")
    for k in range(0, len(order), lanes):
        group = order[k : k + lanes]
        size = np.array([len(texts[i]) for i in group])
        h = np.zeros((hid, len(group)), np.float32)
        last = np.full(len(group), end)
        for at in range(0, int(size[0]), steps):
            live = int((size > at).sum())
            wide = min(steps, int(size[0]) - at)
            y = np.full((wide, live), -1, np.int64)
            for lane in range(live):
                part = texts[group[lane]][at : at + wide]
                y[: len(part), lane] = part
            x = np.concatenate((last[None, :live], y[:-1]))
            last[:live] = y[-1]
            xp = table.take(x.ravel(), axis=1).reshape(3 * hid, wide, live)  # -1 is never used: its lane has ended
            h = np.ascontiguousarray(h[:, :live])
            hs = np.zeros((hid, wide, live), np.float32)
            for t in range(wide):
                n = int((size > at + t).sum())
                if n < h.shape[1]:
                    h = np.ascontiguousarray(h[:, :n])
                hu = ut @ h
                gate = hu[: 2 * hid]
                gate += xp[: 2 * hid, t, :n]
                _sigmoid(gate)
                new = hu[2 * hid :]
                new += bn
                new *= gate[hid:]
                new += xp[2 * hid :, t, :n]
                np.tanh(new, out=new)
                h -= new
                h *= gate[:hid]
                h += new
                hs[:, t, :n] = h
            here = (y >= 0).ravel()
            logs, _ = log_probs(p, hs.reshape(hid, -1)[:, here], y.ravel()[here])
            sums = np.zeros(y.size)
            sums[here] = logs
            out[group[:live]] += sums.reshape(y.shape).sum(axis=0)
    return out
