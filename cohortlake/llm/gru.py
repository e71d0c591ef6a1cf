"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation, whole-document scoring."""

from __future__ import annotations

import heapq

import numpy as np

LANES = 512
WINDOW = 32
START, END, OTHER = -1, 0, 1  # START is the last row of the input table


class Gru:
    """Tokens are 0 (end), 1 (any word outside the vocabulary) and the vocabulary by rank. Classes are runs of ``group``
    ids; p(token) = p(class) * p(token in its class), so that a token costs classes + group instead of all tokens."""

    NAMES = ("x", "u", "b", "c", "o")

    def __init__(self, size: int, hidden: int = 32, group: int = 64, params: dict | None = None):
        self.size, self.hidden, self.group = size, hidden, group
        self.classes = -(-size // group)
        if params is None:
            rng = np.random.default_rng(0)
            normal = lambda *shape: (0.1 * rng.standard_normal(shape)).astype(np.float32)
            params = {"x": normal(size + 1, 3 * hidden), "u": normal(hidden, 3 * hidden), "b": np.zeros(3 * hidden, np.float32),
                      # the last column is the bias
                      "c": normal(self.classes, hidden + 1), "o": normal(self.classes, group, hidden + 1)}
            params["o"].reshape(-1, hidden + 1)[size:] = 0
            params["o"].reshape(-1, hidden + 1)[size:, -1] = -1e9  # places of the last class that no token has
        self.p = params

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[n].ravel() for n in self.NAMES])

    def of(self, flat: np.ndarray) -> Gru:
        out, at = {}, 0
        for n in self.NAMES:
            out[n] = flat[at:at + self.p[n].size].reshape(self.p[n].shape).astype(np.float32)
            at += self.p[n].size
        return Gru(self.size, self.hidden, self.group, out)

    # -- one window --------------------------------------------------------------------------------------------------

    def forward(self, tokens: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States after reading each row of ``tokens`` [steps, lanes], and the last; ``fresh`` marks starts of documents,
        where the state is zero. ``keep`` collects what the way back needs."""
        u, n = self.p["u"], self.hidden
        x = self.p["x"] + self.p["b"]
        out = np.empty((*tokens.shape, n), x.dtype)
        for t in range(tokens.shape[0]):
            if fresh[t].any():
                h = np.where(fresh[t][:, None], x.dtype.type(0), h)
            hu = h @ u
            a = x[tokens[t]]
            gates = a[:, :2 * n] + hu[:, :2 * n]
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            z, r, hn = gates[:, :n], gates[:, n:], hu[:, 2 * n:]
            new = r * hn
            new += a[:, 2 * n:]
            np.tanh(new, out=new)
            if keep is not None:
                keep.append((h, z, r, new, hn))
            h = h - new
            h *= z
            h += new
            out[t] = h
        return out, h

    @staticmethod
    def softmax(states: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unnormalised probabilities and their sums."""
        e = states @ w.T
        np.exp(e, out=e)
        total = e @ np.ones(e.shape[1], np.float32)
        if not (np.isfinite(total).all() and total.min() > 0):  # out of range without the usual shift by the maximum
            e = states @ w.T
            e -= e.max(axis=1, keepdims=True)
            np.exp(e, out=e)
            total = e.sum(axis=1)
        return e, total

    def log_probs(self, states: np.ndarray, targets: np.ndarray, grads: dict | None = None) -> np.ndarray:
        """Natural log probability of each target after its state. With ``grads``, adds gradients of the mean loss to it,
        and under "states" those with respect to the states."""
        m, tiny = targets.size, np.float32(1e-38)
        states = np.concatenate([states, np.ones((m, 1), np.float32)], axis=1)
        cls = targets // self.group
        order = np.argsort(cls.astype(np.int16), kind="stable")
        states, cls, within = states[order], cls[order], (targets - cls * self.group)[order]
        rows = np.arange(m)
        e, total = self.softmax(states, self.p["c"])
        own = np.log(np.maximum(e[rows, cls] / total, tiny))
        if grads is not None:
            e *= (1 / (m * total))[:, None]
            e[rows, cls] -= np.float32(1 / m)
            grads["c"], back, grads["o"] = e.T @ states, e @ self.p["c"][:, :-1], {}
        cuts = np.searchsorted(cls, np.arange(self.classes + 1))
        for k in np.flatnonzero(np.diff(cuts)):
            a, b = cuts[k], cuts[k + 1]
            s, w, r = states[a:b], within[a:b], rows[:b - a]
            e, total = self.softmax(s, self.p["o"][k])
            own[a:b] += np.log(np.maximum(e[r, w] / total, tiny))
            if grads is not None:
                e *= (1 / (m * total))[:, None]
                e[r, w] -= np.float32(1 / m)
                grads["o"][int(k)] = e.T @ s
                back[a:b] += e @ self.p["o"][k][:, :-1]
        lp = np.empty(m, own.dtype)
        lp[order] = own
        if grads is not None:
            grads["states"] = np.empty_like(back)
            grads["states"][order] = back
        return lp

    def backward(self, tokens: np.ndarray, fresh: np.ndarray, keep: list, back: np.ndarray, grads: dict) -> None:
        """Gradients of the inputs and the recurrence, over this window and no further."""
        n, u = self.hidden, self.p["u"]
        steps, lanes = tokens.shape
        dx, dhu, before = (np.empty((steps, lanes, k), np.float32) for k in (3 * n, 3 * n, n))
        dh = np.zeros((lanes, n), np.float32)
        for t in range(steps - 1, -1, -1):
            h, z, r, new, hn = keep[t]
            dh = dh + back[t]
            rest = 1 - z
            dnew = dh * rest
            dnew *= 1 - new * new
            dz, dr = dx[t, :, :n], dx[t, :, n:2 * n]
            np.multiply(dh, h - new, out=dz)
            dz *= z
            dz *= rest
            np.multiply(dnew, r, out=dhu[t, :, 2 * n:])
            np.multiply(dhu[t, :, 2 * n:], hn, out=dr)
            dr *= 1 - r
            dx[t, :, 2 * n:] = dnew
            dhu[t, :, :2 * n] = dx[t, :, :2 * n]
            before[t] = h
            dh *= z
            dh += dhu[t] @ u.T
            if fresh[t].any():
                dh[fresh[t]] = 0
        grads["u"] = before.reshape(-1, n).T @ dhu.reshape(-1, 3 * n)
        dx = dx.reshape(-1, 3 * n)
        grads["b"] = dx.sum(axis=0)
        flat = np.where(tokens == START, self.size, tokens).ravel()
        order = np.argsort(flat, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], np.diff(flat[order]) != 0]))
        grads["x"] = flat[order[starts]], np.add.reduceat(dx[order], starts, axis=0)

    # -- training ----------------------------------------------------------------------------------------------------

    def train(self, docs: list[np.ndarray], rate: float, squares: dict) -> int:
        """One pass over documents (token ids, each with its end), side by side in lanes; the number of targets."""
        stream = np.concatenate(docs)
        before = np.concatenate([np.concatenate([[START], d[:-1]]) for d in docs])
        lanes = int(np.clip(stream.size // (4 * WINDOW), 1, LANES))
        steps = -(-stream.size // lanes)
        # places after the last token are starts without a target
        shape = lambda a, fill: np.ascontiguousarray(np.append(a, np.full(steps * lanes - a.size, fill, a.dtype)).reshape(lanes, steps).T)
        targets, tokens, used = shape(stream, END), shape(before, START), shape(np.ones(stream.size, bool), False)
        h = np.zeros((lanes, self.hidden), np.float32)
        for a in range(0, steps, WINDOW):
            t, y = tokens[a:a + WINDOW], targets[a:a + WINDOW]
            fresh, keep, grads = t == START, [], {}
            states, h = self.forward(t, fresh, h, keep)
            own = used[a:a + WINDOW]
            self.log_probs(states[own], y[own], grads)
            back = np.zeros_like(states)
            back[own] = grads.pop("states")
            self.backward(t, fresh, keep, back, grads)
            self.update(grads, rate, squares)
        return stream.size

    def update(self, grads: dict, rate: float, squares: dict) -> None:
        """Adagrad; rows and classes without a gradient stay untouched."""
        def move(p, s, g):
            s += g * g
            p -= rate * g / (np.sqrt(s) + np.float32(1e-6))
        for n in self.NAMES:
            p, s, g = self.p[n], squares.setdefault(n, np.zeros_like(self.p[n])), grads[n]
            if n == "x":
                rows, g = g
                own = s[rows] + g * g
                s[rows] = own
                p[rows] -= rate * g / (np.sqrt(own) + np.float32(1e-6))
            elif isinstance(g, dict):
                for k, part in g.items():
                    move(p[k], s[k], part)
            else:
                move(p, s, g)

    # -- scoring -----------------------------------------------------------------------------------------------------

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """Each whole document's natural log probability. Documents follow each other in lanes of like length; a lane's state
        goes on from window to window until its document ends."""
        sizes = np.array([d.size for d in docs])
        lanes = max(1, min(LANES, len(docs)))
        load, member = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
        for d in np.argsort(-sizes, kind="stable").tolist():
            n, k = load[0]
            heapq.heapreplace(load, (n + int(sizes[d]), k))
            member[k].append(d)
        length = np.array([sum(int(sizes[d]) for d in m) for m in member])
        rank = np.argsort(-length, kind="stable")
        member, length = [member[k] for k in rank], length[rank]
        steps = int(length[0]) if lanes else 0
        streams = [np.concatenate([docs[d] for d in m]) if m else np.zeros(0, np.int32) for m in member]
        befores = [np.concatenate([np.concatenate([np.array([START], np.int32), docs[d][:-1]]) for d in m]) if m else np.zeros(0, np.int32) for m in member]
        owners = [np.repeat(np.array(m, np.int32), sizes[m]) if m else np.zeros(0, np.int32) for m in member]
        total, h = np.zeros(len(docs)), np.zeros((lanes, self.hidden), np.float32)
        for a in range(0, steps, WINDOW):
            live = int((length > a).sum())
            k = min(WINDOW, steps - a)
            tokens, targets, owner = (np.full((k, live), fill, np.int64) for fill in (START, END, -1))
            for j in range(live):
                part = slice(a, a + k)
                n = min(k, int(length[j]) - a)
                tokens[:n, j], targets[:n, j], owner[:n, j] = befores[j][part], streams[j][part], owners[j][part]
            states, h = self.forward(tokens, tokens == START, h[:live])
            used = owner.ravel() >= 0
            lp = self.log_probs(states.reshape(-1, self.hidden)[used], targets.ravel()[used])
            total += np.bincount(owner.ravel()[used], lp.astype(np.float64), len(docs))
        return total
