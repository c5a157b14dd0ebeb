"""A bidirectional LSTM over character classes with CRF transitions, trained and run in numpy."""

from __future__ import annotations

import numpy as np

HIDDEN = 16
EPOCHS, BATCH, RATE = 14, 48, 0.02
#: Steps that a small sample is passed again for.
LEAST_STEPS = 300
#: Rows that are decoded together.
TOGETHER = 750


def _classes() -> np.ndarray:
    """Class of each code below 128: one for digits, two for small letters (hexadecimal or not), one for capitals, each other printable its own."""
    out = np.zeros(128, np.uint8)
    of: dict[object, int] = {}
    for code in range(128):
        c = chr(code)
        key = "digit" if c.isdigit() else "hex" if c in "abcdef" else "small" if c.islower() else "capital" if c.isupper() else "gap" if code < 32 or code == 127 else c
        out[code] = of.setdefault(key, len(of))
    return out


_TABLE = _classes()
OTHER = int(_TABLE.max()) + 1
PAD = OTHER + 1
N_CLASSES = PAD + 1


def encode(text: str) -> np.ndarray:
    """Class of every code point."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 128, _TABLE[np.minimum(codes, 127)], OTHER).astype(np.uint8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Tagger:
    """``tags`` labels of one character each; label 0 is outside."""

    def __init__(self, tags: int, hidden: int = HIDDEN, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.hidden, self.tags = hidden, tags
        self.p = {"xf": draw(N_CLASSES, 4 * hidden), "xb": draw(N_CLASSES, 4 * hidden), "uf": draw(hidden, 4 * hidden), "ub": draw(hidden, 4 * hidden), "w": draw(2 * hidden, tags), "b": np.zeros(tags, np.float32), "a": np.zeros((tags, tags), np.float32)}
        for k in ("xf", "xb"):
            self.p[k][:, hidden : 2 * hidden] += 1  # forget gates start open

    def _run(self, x: np.ndarray, side: str, keep: bool) -> tuple[np.ndarray, list]:
        h, table, u = self.hidden, self.p["x" + side], self.p["u" + side]
        rows, steps = x.shape
        out, trace = np.empty((steps, rows, h), np.float32), []
        state, cell = np.zeros((rows, h), np.float32), np.zeros((rows, h), np.float32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = table[x[:, t]] + state @ u
            gates, fresh = _sigmoid(z[:, : 3 * h]), np.tanh(z[:, 3 * h :])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            before, prior = cell, state
            cell = f * cell + i * fresh
            squash = np.tanh(cell)
            state = o * squash
            out[t] = state
            if keep:
                trace.append((t, i, f, o, fresh, before, prior, squash))
        return out, trace

    def emissions(self, x: np.ndarray, keep: bool = False):
        (f, tf), (b, tb) = self._run(x, "f", keep), self._run(x, "b", keep)
        both = np.concatenate([f, b], axis=2)
        return both @ self.p["w"] + self.p["b"], both, tf, tb

    def _states(self, x: np.ndarray) -> np.ndarray:
        """Twice what ``_run`` gives for both sides, without a trace, to the last bit: (step, row, unit forward and backward).

        A sigmoid is half of one more than the tanh of half its argument, so one call takes all gates; halves are exact and go into
        the weights. Each gate of a side lies in one piece.
        """
        h, (rows, steps) = self.hidden, x.shape
        half = np.array([0.5, 0.5, 0.5, 1], np.float32)
        sides = lambda k, n: np.stack([self.p[k + "f"], self.p[k + "b"]]).reshape(2, n, 4, h).transpose(0, 2, 1, 3)
        table = np.ascontiguousarray(sides("x", N_CLASSES) * half[:, None, None]).reshape(8 * N_CLASSES, h)
        u = np.ascontiguousarray(sides("u", h) * (half / 2)[:, None, None])
        places, first = np.stack([x.T, x.T[::-1]], axis=1).astype(np.intp), (np.arange(8) * N_CLASSES).reshape(2, 4, 1)
        out, z, fed = np.empty((steps, rows, 2 * h), np.float32), np.empty((2, 4, rows, h), np.float32), np.empty((2, 4, rows, h), np.float32)
        state, cell, squash = (np.zeros((2, rows, h), np.float32) for _ in range(3))
        gates, i, f, o, fresh = z[:, :3], *(z[:, k] for k in range(4))
        for t in range(steps):
            np.matmul(state[:, None], u, out=z)
            np.take(table, places[t][:, None] + first, axis=0, out=fed, mode="clip")
            z += fed
            np.tanh(z, out=z)
            gates += 1
            cell *= f
            i *= fresh
            cell += i
            cell *= 0.5
            np.tanh(cell, out=squash)
            np.multiply(o, squash, out=state)
            out[t, :, :h], out[steps - 1 - t, :, h:] = state
        return out

    def _open(self, e: np.ndarray) -> np.ndarray:
        """Which rows of emissions (step, tag, row) may have another best sequence than label 0 throughout.

        The best sum over a stretch of steps of what their best other label adds to label 0, with the most that transitions
        into, within and out of such a stretch add, bounds what any sequence adds. A margin covers rounding.
        """
        gain = e[:, 1:].max(axis=1) - e[:, 0]
        a = self.p["a"] - self.p["a"][0, 0]
        into, within, out = a[0, 1:].max(), a[1:, 1:].max(), a[1:, 0].max()
        now, best = gain[0], np.full_like(gain[0], -np.inf)
        for g in gain[1:]:
            np.maximum(best, now + out, out=best)
            now = np.maximum(now + within, into) + g
        return np.maximum(best, now) > -0.01

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tag sequence of each row of character classes, by Viterbi where label 0 throughout isn't surely the best.

        Rows pass the network in parts of about ``TOGETHER``, and so do those of all parts that Viterbi takes.
        """
        out, held, at = np.zeros(x.shape, np.int8), [], 0
        w, b = self.p["w"].T / 2, self.p["b"][:, None]

        def search() -> None:
            rows = np.concatenate([r for r, _ in held])
            out[rows] = self._viterbi(np.concatenate([e for _, e in held], axis=2))
            held.clear()

        for part in np.array_split(x, max(1, round(len(x) / TOGETHER))) if x.size else ():
            e = np.matmul(w, self._states(part).transpose(0, 2, 1)) + b  # step, tag, row
            if len(rows := np.flatnonzero(self._open(e))):
                held.append((at + rows, e[:, :, rows]))
            at += len(part)
            if sum(len(r) for r, _ in held) >= TOGETHER:
                search()
        if held:
            search()
        return out

    def _viterbi(self, e: np.ndarray) -> np.ndarray:
        a, best = self.p["a"], e[0]
        back = np.empty(e.shape, np.int8)
        for t in range(1, len(e)):
            top, of = best[0] + a[0][:, None], back[t]
            of[:] = 0
            for p in range(1, self.tags):
                step = best[p] + a[p][:, None]
                of[step > top] = p
                np.maximum(top, step, out=top)
            best = top + e[t]
        out = np.empty((e.shape[2], len(e)), np.int8)
        out[:, -1] = best.argmax(axis=0)
        rows = np.arange(len(out))
        for t in range(len(e) - 1, 0, -1):
            out[:, t - 1] = back[t][out[:, t], rows]
        return out

    def _crf(self, e: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Negative log-likelihood of the tags, and its gradients by emissions and transitions."""
        a = self.p["a"]
        lse = lambda z, axis: (m := z.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(z - m).sum(axis=axis))
        steps, rows, _ = e.shape
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, steps):
            alpha[t] = lse(alpha[t - 1][:, :, None] + a, 1) + e[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = lse(a + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        de = np.exp(alpha + beta - z[:, None])
        da = np.zeros_like(a)
        for t in range(1, steps):
            da += np.exp(alpha[t - 1][:, :, None] + a + (e[t] + beta[t])[:, None, :] - z[:, None, None]).sum(axis=0)
        at_t, at_r = np.arange(steps)[:, None], np.arange(rows)[None, :]
        yt = y.T.astype(int)
        gold = e[at_t, at_r, yt].sum() + a[yt[:-1], yt[1:]].sum()
        de[at_t, at_r, yt] -= 1
        np.subtract.at(da, (yt[:-1], yt[1:]), 1)
        return float(z.sum() - gold), de / rows, da / rows

    def _back(self, x: np.ndarray, side: str, trace: list, dout: np.ndarray, grads: dict) -> None:
        h, u = self.hidden, self.p["u" + side]
        gx, gu = np.zeros_like(self.p["x" + side]), np.zeros_like(u)
        dstate = dcell = np.zeros((x.shape[0], h), np.float32)
        for t, i, f, o, fresh, before, prior, squash in reversed(trace):
            d = dout[t] + dstate
            dc = dcell + d * o * (1 - squash * squash)
            dz = np.hstack([dc * fresh * i * (1 - i), dc * before * f * (1 - f), d * squash * o * (1 - o), dc * i * (1 - fresh * fresh)])
            np.add.at(gx, x[:, t], dz)
            gu += prior.T @ dz
            dstate, dcell = dz @ u.T, dc * f
        grads["x" + side], grads["u" + side] = gx, gu

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> "Tagger":
        """Adam on the CRF likelihood; rows of equal length, padded with class PAD and tag 0. Deterministic."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        epochs = max(epochs, -(-LEAST_STEPS // -(-len(x) // BATCH)))
        step, total = 0, epochs * -(-len(x) // BATCH)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), BATCH):
                part = order[lo : lo + BATCH]
                e, both, tf, tb = self.emissions(x[part], keep=True)
                _, de, da = self._crf(e, y[part])
                flat, d = both.reshape(-1, both.shape[2]), de.reshape(-1, self.tags)
                grads = {"w": flat.T @ d, "b": d.sum(axis=0), "a": da}
                dboth = de @ self.p["w"].T
                self._back(x[part], "f", tf, dboth[:, :, : self.hidden], grads)
                self._back(x[part], "b", tb, dboth[:, :, self.hidden :], grads)
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                step += 1
                rate = RATE * min(1.0, 2 * (1 - step / (total + 1)))
                for k, g in grads.items():
                    g = g * min(1.0, 5 / (norm + 1e-9))
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self
