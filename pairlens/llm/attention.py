"""A small causal self-attention model in numpy.

One block: token and place embeddings, one masked attention head, a two-layer perceptron, both with
residuals. The next token's share is that of its group, by one softmax over the groups, times its share
within the group, by a softmax over the group's members. All work is on batches of windows; gradients
are written out by hand.

Symbols are numbered so that each group is a range; ``edges`` holds the ranges' ends.
"""

from __future__ import annotations

import math

import numpy as np

#: Window length, and how far windows are apart: each later window only scores what is new in it.
WINDOW, STRIDE = 24, 20
WIDTH, HIDDEN = 16, 32


def new_model(share: np.ndarray, edges: np.ndarray, seed: int = 1) -> dict[str, np.ndarray]:
    """Random weights, and biases that give the symbols' shares; inputs have a start, the last row."""
    rng = np.random.default_rng(seed)
    w = lambda *s: (rng.standard_normal(s) / math.sqrt(s[0])).astype(np.float32)
    group = np.add.reduceat(share, edges[:-1])
    return {
        "emb": (rng.standard_normal((len(share) + 1, WIDTH)) * 0.5).astype(np.float32), "pos": (rng.standard_normal((WINDOW, WIDTH)) * 0.1).astype(np.float32),
        "q": w(WIDTH, WIDTH), "k": w(WIDTH, WIDTH), "v": w(WIDTH, WIDTH), "o": w(WIDTH, WIDTH),
        "w1": w(WIDTH, HIDDEN), "b1": np.zeros(HIDDEN, np.float32), "w2": w(HIDDEN, WIDTH) * 0.5,
        "ug": w(WIDTH, len(group)) * 0.3, "bg": np.log(group).astype(np.float32),
        "u": (rng.standard_normal((len(share), WIDTH)) * 0.1).astype(np.float32), "b": np.log(share / np.repeat(group, np.diff(edges))).astype(np.float32),
    }


def groups(profiles: np.ndarray, share: np.ndarray, count: int) -> list[np.ndarray]:
    """Splits rows into at most so many sets of about equal share and like profiles.

    The set with the greatest share of those with more than one row is halved (by share) along its
    profiles' main direction, again and again.
    """
    sets = [np.arange(len(share))]
    while len(sets) < count:
        sizes = [share[s].sum() if len(s) > 1 else -1.0 for s in sets]
        i = int(np.argmax(sizes))
        if sizes[i] < 0:
            break
        s = sets.pop(i)
        x = profiles[s] - np.average(profiles[s], 0, share[s])
        way = np.random.default_rng(len(sets)).standard_normal(x.shape[1])
        for _ in range(12):
            way = x.T @ (share[s] * (x @ way))
            way /= np.linalg.norm(way) + 1e-30
        order = np.argsort(x @ way, kind="stable")
        cut = int(np.clip(np.searchsorted(np.cumsum(share[s][order]), share[s].sum() / 2), 1, len(s) - 1))
        sets += [s[order[:cut]], s[order[cut:]]]
    return sets


#: Places that a place can look at, as attention has them: keys down, queries across, which makes sums over keys fast.
_SEEN = np.triu(np.ones((WINDOW, WINDOW), np.float32))
#: Logits no further from 0 than this are raised as they are; else each place's greatest is taken off before.
PLAIN = 60.0


def _joint(m: dict) -> np.ndarray:
    """Weights of queries, keys and values side by side."""
    return np.concatenate([m["q"] * m["q"].dtype.type(1 / math.sqrt(WIDTH)), m["k"], m["v"]], 1)


def _attended(m: dict, ids: np.ndarray, joint: np.ndarray) -> dict:
    """The attention's values; those without pairs of places have one row for each place."""
    size, n = ids.shape
    x = m["emb"][ids]
    x += m["pos"][:n]
    x = x.reshape(-1, WIDTH)
    three = (x @ joint).reshape(size, n, 3 * WIDTH)
    q, k, v = three[..., :WIDTH], three[..., WIDTH : 2 * WIDTH], three[..., 2 * WIDTH :]
    s = k @ q.transpose(0, 2, 1)
    if max(-s.min(initial=0), s.max(initial=0)) > PLAIN:
        s[:, _SEEN[:n, :n] == 0] = -np.inf
        s -= s.max(1, keepdims=True)
    np.exp(s, out=s)
    s *= _SEEN[:n, :n]
    s /= np.ones((1, n), s.dtype) @ s
    c = (s.transpose(0, 2, 1) @ v).reshape(-1, WIDTH)
    h = c @ m["o"]
    h += x
    return {"x": x, "q": q, "k": k, "v": v, "a": s, "c": c, "h": h}


def _perceived(m: dict, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The perceptron's hidden layer and what comes out, of any rows."""
    g = h @ m["w1"]
    g += m["b1"]
    np.maximum(g, 0, out=g)
    z = g @ m["w2"]
    z += h
    return g, z


def _states(m: dict, ids: np.ndarray, joint: np.ndarray | None = None) -> dict:
    """All layers' values at all places."""
    f = _attended(m, ids, _joint(m) if joint is None else joint)
    g, z = _perceived(m, f["h"])
    return f | {"g": g, "z": z.reshape(*ids.shape, WIDTH)}


def _with_bias(z: np.ndarray) -> np.ndarray:
    """Rows with a 1 behind, which meets the bias in a matrix's last column."""
    out = np.empty((len(z), WIDTH + 1), z.dtype)
    out[:, :WIDTH], out[:, WIDTH] = z, 1
    return out


def _beside(u: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.concatenate([u, b[:, None]], 1)


def _keep_heap() -> None:
    """Lets the process keep the memory of arrays that come and go: malloc's limits grow with the largest array freed so far.
    Else each batch's arrays are mapped anew, which takes as long as the work on them."""
    np.empty(30 << 20, np.uint8)


class Windows:
    """Windows over sequences of targets, each target scored in exactly one.

    seqs holds all sequences of targets one after another; the input of a target is the one before it,
    the first one's is ``start``.
    """

    def __init__(self, seqs: np.ndarray, lens: np.ndarray, start: int):
        n = np.where(lens > WINDOW, 1 + -(-(lens - WINDOW) // STRIDE), (lens > 0).astype(np.int64))
        self.of = np.repeat(np.arange(len(lens)), n)
        self.turn = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        self.first = (np.cumsum(lens) - lens)[self.of]
        self.seqs, self.lens, self.start = seqs, lens, start

    def __len__(self):
        return len(self.of)

    def take(self, some) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs, targets and which targets to score of these windows, one row each."""
        turn, first = self.turn[some], self.first[some]
        at = (turn * STRIDE)[:, None] + np.arange(WINDOW)
        inside = at < self.lens[self.of[some]][:, None]
        spot = np.where(inside, first[:, None] + at, 0)
        targets = self.seqs[spot]
        inputs = np.concatenate([np.where(at[:, :1] > 0, self.seqs[np.maximum(spot[:, :1] - 1, 0)], self.start), targets[:, :-1]], 1)
        inputs[~inside] = self.start
        return inputs, targets, inside & ((turn == 0)[:, None] | (np.arange(WINDOW) >= WINDOW - STRIDE))


def log_probs(m: dict, edges: np.ndarray, seqs: np.ndarray, lens: np.ndarray, word_groups: np.ndarray, chunk: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """ln of each target's share, and of the share of all groups that start a word, in the order of seqs."""
    _keep_heap()
    windows = Windows(seqs, lens, len(m["b"]))
    own, word = np.empty(len(seqs), np.float32), np.empty(len(seqs), np.float32)
    ug, u, joint, of = _beside(m["ug"].T, m["bg"]), _beside(m["u"], m["b"]), _joint(m), _group_of(edges)
    sums, at = np.stack([word_groups, np.ones_like(word_groups)]).astype(np.float32), 0
    for i in range(0, len(windows), chunk):
        inputs, targets, some = windows.take(slice(i, i + chunk))
        t = targets[some]
        order = np.argsort(of[t], kind="stable")
        t = t[order]
        g = of[t]
        _, z = _perceived(m, _attended(m, inputs, joint)["h"][np.flatnonzero(some)[order]])
        z = _with_bias(z)
        logits, row = ug @ z.T, np.arange(len(z))
        logits -= logits.max(0)
        mine = logits[g, row]
        np.exp(logits, out=logits)
        total = sums @ logits
        mine -= np.log(total[1])
        ends = np.searchsorted(g, np.arange(len(edges)))
        for k in np.flatnonzero(np.diff(ends)).tolist():
            if edges[k + 1] - edges[k] > 1:
                rows = slice(ends[k], ends[k + 1])
                part = u[edges[k] : edges[k + 1]] @ z[rows].T
                part -= part.max(0)
                mine[rows] += part[t[rows] - edges[k], row[: ends[k + 1] - ends[k]]]
                np.exp(part, out=part)
                mine[rows] -= np.log(part.sum(0))
        here = at + order
        own[here], word[here] = mine, np.log(np.minimum(total[0] / total[1], 1) + 1e-30)
        at += len(z)
    return own, word


def _group_of(edges: np.ndarray) -> np.ndarray:
    """Each symbol's group, as small numbers, which sort faster."""
    return np.repeat(np.arange(len(edges) - 1, dtype=np.uint16), np.diff(edges))


def _softmax_loss(p: np.ndarray, target: np.ndarray, row: np.ndarray) -> float:
    """The loss of columns of logits, which become its gradients."""
    p -= p.max(0)
    mine = p[target, row]
    np.exp(p, out=p)
    total = p.sum(0)
    p *= 1 / total
    p[target, row] -= 1
    return float(np.log(total).sum() - mine.sum())


def gradients(m: dict, edges: np.ndarray, ids: np.ndarray, targets: np.ndarray, scored: np.ndarray) -> tuple[float, dict]:
    """Mean loss of the scored targets and its gradients."""
    size, n = ids.shape
    joint, of, t = _joint(m), _group_of(edges), targets[scored]
    f, count = _attended(m, ids, joint), max(1, len(t))
    # rows of one group lie together
    order = np.argsort(of[t], kind="stable")
    t, spot = t[order], np.flatnonzero(scored)[order]
    g, h = of[t], f["h"][spot]
    hidden, z = _perceived(m, h)
    z, row = _with_bias(z), np.arange(len(z))
    ug, u = _beside(m["ug"].T, m["bg"]), _beside(m["u"], m["b"])
    p = ug @ z.T
    loss = _softmax_loss(p, g, row)
    dug, du, dz = p @ z, np.zeros_like(u), p.T @ ug[:, :WIDTH]
    ends = np.searchsorted(g, np.arange(len(edges)))
    for k in np.flatnonzero(np.diff(ends)).tolist():
        if edges[k + 1] - edges[k] > 1:
            rows, span = slice(ends[k], ends[k + 1]), slice(edges[k], edges[k + 1])
            p = u[span] @ z[rows].T
            loss += _softmax_loss(p, t[rows] - edges[k], row[: ends[k + 1] - ends[k]])
            du[span] = p @ z[rows]
            dz[rows] += p.T @ u[span, :WIDTH]
    dz /= count
    dug /= count
    du /= count
    d = {"ug": dug[:, :WIDTH].T, "bg": dug[:, WIDTH], "u": du[:, :WIDTH], "b": du[:, WIDTH]}
    dg = dz @ m["w2"].T
    dg *= hidden > 0
    d["w2"], d["w1"], d["b1"] = hidden.T @ dz, h.T @ dg, dg.sum(0)
    dz += dg @ m["w1"].T
    dh = np.zeros_like(f["h"])
    dh[spot] = dz
    d["o"] = f["c"].T @ dh
    dc = (dh @ m["o"].T).reshape(size, n, WIDTH)
    da = f["v"] @ dc.transpose(0, 2, 1)
    three = np.empty((size, n, 3 * WIDTH), dz.dtype)
    three[..., 2 * WIDTH :] = f["a"] @ dc
    da *= f["a"]
    da -= f["a"] * (np.ones((1, n), da.dtype) @ da)
    three[..., :WIDTH], three[..., WIDTH : 2 * WIDTH] = da.transpose(0, 2, 1) @ f["k"], da @ f["q"]
    three = three.reshape(-1, 3 * WIDTH)
    whole = f["x"].T @ three
    d["q"], d["k"], d["v"] = whole[:, :WIDTH] * whole.dtype.type(1 / math.sqrt(WIDTH)), whole[:, WIDTH : 2 * WIDTH], whole[:, 2 * WIDTH :]
    dh += three @ joint.T
    d["pos"] = np.zeros_like(m["pos"])
    d["pos"][:n] = dh.reshape(size, n, WIDTH).sum(0)
    d["emb"] = np.zeros_like(m["emb"])
    inputs = ids.ravel().astype(np.min_scalar_type(len(m["emb"])))
    order = np.argsort(inputs, kind="stable")
    inputs = inputs[order]
    first = np.flatnonzero(np.concatenate([[True], inputs[1:] != inputs[:-1]]))
    d["emb"][inputs[first]] = np.add.reduceat(dh[order], first)
    return loss / count, d


def train(m: dict, edges: np.ndarray, windows: Windows, least_steps: int, rate: float, seed: int = 3) -> tuple[dict, int]:
    """Adam over all windows, again and again until at least so many steps are made.

    Batches are as large (64 to 512 windows) as leaves 400 steps for a pass.
    """
    _keep_heap()
    batch = min(512, max(64, len(windows) // 400))
    m = {k: v.copy() for k, v in m.items()}
    one, two, step, rng = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}, 0, np.random.default_rng(seed)
    rounds = max(1, -(-least_steps // max(1, -(-len(windows) // batch))))
    total = rounds * -(-len(windows) // batch)
    for _ in range(rounds):
        order = rng.permutation(len(windows))
        for i in range(0, len(order), batch):
            _, d = gradients(m, edges, *windows.take(order[i : i + batch]))
            step += 1
            r = rate * (1 - 0.9 * step / total) * math.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in d.items():
                one[k] += np.float32(0.1) * (g - one[k])
                two[k] += np.float32(0.001) * (g * g - two[k])
                m[k] -= np.float32(r) * one[k] / (np.sqrt(two[k]) + np.float32(1e-8))
    return m, step
