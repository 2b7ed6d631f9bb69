"""A gated recurrent network with a class-factored softmax, in numpy.

Symbols 0..heads-1 stand for single words and symbols above for bands of rare words.
The output first picks a class; a class is either a group of ``GROUP`` single words,
within which a second softmax picks the word, or one band.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

GROUP = 32
HIDDEN = 16
WINDOW = 16


def _softmax(logits: np.ndarray, bias: np.ndarray, rows: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits of the targets, exponentials (in place) and their sums; logits stop at 60, so nothing overflows."""
    logits += bias
    np.minimum(logits, 60, out=logits)
    picked = logits[rows, target]
    e = np.exp(logits, out=logits)
    return picked, e, e @ np.ones(e.shape[1], e.dtype)


class Gru:
    """Parameters as one flat float32 vector with named views."""

    def __init__(self, heads: int, bands: int, flat: np.ndarray | None = None):
        self.heads, self.bands = heads, bands
        self.groups = heads // GROUP
        self.classes = self.groups + bands
        h, s = HIDDEN, heads + bands
        shapes = {"x": (s + 1, 3 * h), "u": (h, 3 * h), "wc": (h, self.classes), "bc": (self.classes,), "wh": (self.groups, h, GROUP), "bh": (self.groups, GROUP)}
        self.flat = np.zeros(sum(int(np.prod(v)) for v in shapes.values()), np.float32) if flat is None else flat
        at = 0
        self.p: dict[str, np.ndarray] = {}
        for k, v in shapes.items():
            n = int(np.prod(v))
            self.p[k] = self.flat[at : at + n].reshape(v)
            at += n

    @classmethod
    def initial(cls, counts: np.ndarray, heads: int, bands: int, seed: int = 3) -> Gru:
        """Small random weights; output biases that give the symbols' relative counts."""
        net, rng = cls(heads, bands), np.random.default_rng(seed)
        for k, scale in (("x", 0.3), ("u", 0.25), ("wc", 0.05), ("wh", 0.05)):
            net.p[k][...] = rng.normal(0, scale, net.p[k].shape)
        c = counts.astype(np.float64) + 0.5
        grouped = c[:heads].reshape(net.groups, GROUP)
        net.p["bh"][...] = np.log(grouped / grouped.sum(1, keepdims=True))
        per_class = np.concatenate([grouped.sum(1), c[heads:]])
        net.p["bc"][...] = np.log(per_class / per_class.sum())
        return net

    def steps(self, h: np.ndarray, inputs: np.ndarray, keep: list | None = None) -> Iterator[np.ndarray]:
        """States after each row of ``inputs``; only the first len(row) sequences go on."""
        x, u = self.p["x"], self.p["u"]
        k = HIDDEN
        for row in inputs:
            h = h[: len(row)]
            a = x[row]
            g = 1 / (1 + np.exp(-(a[:, : 2 * k] + h @ u[:, : 2 * k])))
            r, z = g[:, :k], g[:, k:]
            rh = r * h
            c = np.tanh(a[:, 2 * k :] + rh @ u[:, 2 * k :])
            new = h + z * (c - h)
            if keep is not None:
                keep.append((row, h, r, z, rh, c))
            h = new
            yield h

    def outputs(self, h: np.ndarray, target: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probability of each target, and with ``grads`` the gradient of the mean loss for ``h``."""
        p, n = self.p, len(target)
        single = target < self.heads
        cls = np.where(single, target // GROUP, target - self.heads + self.groups)
        rows = np.arange(n)
        picked, e, total = _softmax(h @ p["wc"], p["bc"], rows, cls)
        out = picked - np.log(total)
        dh = None
        if grads is not None:
            d = e
            d *= (1 / (total * n))[:, None]
            d[rows, cls] -= 1 / n
            grads["wc"] += h.T @ d
            grads["bc"] += d.sum(0)
            dh = d @ p["wc"].T
        order = np.flatnonzero(single)
        order = order[np.argsort(cls[order], kind="stable")]
        cuts = np.searchsorted(cls[order], np.arange(self.groups + 1))
        for g in range(self.groups):
            at = order[cuts[g] : cuts[g + 1]]
            if not len(at):
                continue
            hs, slot = h[at], target[at] % GROUP
            own = rows[: len(at)]
            picked, ei, ti = _softmax(hs @ p["wh"][g], p["bh"][g], own, slot)
            out[at] += picked - np.log(ti)
            if grads is not None:
                d = ei
                d *= (1 / (ti * n))[:, None]
                d[own, slot] -= 1 / n
                grads["wh"][g] += hs.T @ d
                grads["bh"][g] += d.sum(0)
                dh[at] += d @ p["wh"][g].T
        return out, dh

    def back(self, kept: list, dhs: list[np.ndarray], grads: dict) -> None:
        """Gradients of one window; ``dhs`` are those from the outputs, step by step."""
        u, k = self.p["u"], HIDDEN
        carry = np.zeros((0, k), np.float32)
        rows, das = [], []
        for (row, h, r, z, rh, c), dh in zip(reversed(kept), reversed(dhs), strict=True):
            d = dh.copy()
            d[: len(carry)] += carry
            dc = d * z * (1 - c * c)
            dz = d * (c - h) * z * (1 - z)
            drh = dc @ u[:, 2 * k :].T
            dr = drh * h * r * (1 - r)
            dg = np.concatenate([dr, dz], 1)
            carry = d * (1 - z) + drh * r + dg @ u[:, : 2 * k].T
            grads["u"][:, : 2 * k] += h.T @ dg
            grads["u"][:, 2 * k :] += rh.T @ dc
            rows.append(row)
            das.append(np.concatenate([dg, dc], 1))
        rows, das = np.concatenate(rows), np.concatenate(das)
        order = np.argsort(rows, kind="stable")
        rows, das = rows[order], das[order]
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        grads["x"][rows[first]] += np.add.reduceat(das, first, axis=0)


class Adam:
    """Adam over the flat parameter vector."""

    def __init__(self, net: Gru, rate: float = 0.004):
        self.net, self.rate, self.t = net, rate, 0
        self.m, self.v = np.zeros_like(net.flat), np.zeros_like(net.flat)
        self.grad = Gru(net.heads, net.bands)

    def update(self) -> None:
        g = self.grad.flat
        norm = float(np.sqrt(g @ g))
        if norm > 1:
            g *= 1 / norm
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.001 * (g * g - self.v)
        step = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        self.net.flat -= step * self.m / (np.sqrt(self.v) + 1e-8)
        g[:] = 0


class Steps:
    """Sequences in descending length, read step by step; ``start`` stands in front of each."""

    def __init__(self, docs: list[np.ndarray], start: int):
        self.order = np.array(sorted(range(len(docs)), key=lambda i: (-len(docs[i]), i)), np.int64)
        lengths = np.array([len(docs[i]) for i in self.order])
        self.flat = np.concatenate([docs[i] for i in self.order]).astype(np.int64)
        self.begin = np.cumsum(lengths) - lengths
        self.active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), "right")
        self.start = start

    def windows(self, width: int) -> Iterator[tuple[list[np.ndarray], list[np.ndarray]]]:
        """Inputs and targets of ``width`` steps at a time; sequences that have ended drop out at the end."""
        for a in range(0, len(self.active), width):
            steps = range(a, min(a + width, len(self.active)))
            at = [self.begin[: self.active[t]] + t for t in steps]
            inputs = [self.flat[x - 1] if t else np.full(len(x), self.start) for t, x in zip(steps, at, strict=True)]
            yield inputs, [self.flat[x] for x in at]


def train(net: Gru, docs: list[np.ndarray], adam: Adam, batch: int = 256, segment: int = 512) -> int:
    """Truncated backpropagation through windows; the state is carried from window to window of a segment.

    Texts longer than ``segment`` are cut into segments, all of which are used.  Returns the symbols seen.
    """
    parts = [d[i : i + segment] for d in docs for i in range(0, len(d), segment)]
    parts.sort(key=len)
    groups = [parts[i : i + batch] for i in range(0, len(parts), batch)]
    seen = 0
    for g in np.random.default_rng(len(groups)).permutation(len(groups)):
        h = np.zeros((len(groups[g]), HIDDEN), np.float32)
        for inputs, targets in Steps(groups[g], net.heads + net.bands).windows(WINDOW):
            kept: list = []
            hs = list(net.steps(h, inputs, kept))
            target = np.concatenate(targets)
            _, dh = net.outputs(np.concatenate(hs), target, adam.grad.p)
            cuts = np.cumsum([len(t) for t in targets])[:-1]
            net.back(kept, np.split(dh, cuts), adam.grad.p)
            adam.update()
            h = hs[-1]
            seen += len(target)
    return seen


def score(net: Gru, docs: list[np.ndarray], window: int = 64) -> np.ndarray:
    """Log10 probability of each whole sequence; the state runs from its first symbol to its last."""
    out = np.zeros(len(docs))
    if not docs:
        return out
    steps = Steps(docs, net.heads + net.bands)
    total = np.zeros(len(docs))
    h = np.zeros((len(docs), HIDDEN), np.float32)
    for inputs, targets in steps.windows(window):
        hs = list(net.steps(h, inputs))
        logp, _ = net.outputs(np.concatenate(hs), np.concatenate(targets))
        at = np.concatenate([np.arange(len(t)) for t in targets])
        total += np.bincount(at, logp, len(total))
        h = hs[-1]
    out[steps.order] = total / np.log(10)
    return out
