"""Character-level bidirectional LSTM with CRF transitions, in numpy.

A batch is an array of character codes (rows of equal length). Tags are begin and inside tags of
the span kinds and one outside tag; transitions to an inside tag are only allowed from its own
kind.
"""

from __future__ import annotations

import numpy as np

CODES = 130  # ASCII, one code for all other characters, one for padding
OTHER, PAD = 128, 129
NEVER = -1e4


def encode(text: str, length: int) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-32-le"), "<u4")
    out = np.full(length, PAD, np.int64)
    out[: len(raw)] = np.minimum(raw, OTHER)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    def __init__(self, kinds: int, width: int = 10, hidden: int = 14, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.kinds, self.hidden, self.tags = kinds, hidden, 2 * kinds + 1
        n = lambda *s: rng.normal(0, 0.3 / np.sqrt(s[0]) + 0.05, s)
        self.p = {"emb": rng.normal(0, 0.5, (CODES, width)), "out": n(2 * hidden, self.tags), "ob": np.zeros(self.tags), "tr": np.zeros((self.tags, self.tags))}
        for way in "fb":
            self.p |= {f"x{way}": n(width, 4 * hidden), f"h{way}": n(hidden, 4 * hidden), f"b{way}": np.concatenate([np.ones(hidden), np.zeros(3 * hidden)])}
        # tag 0 is outside; 1 + 2k begins kind k, 2 + 2k is inside it
        self.allowed = np.ones((self.tags, self.tags), bool)
        for k in range(kinds):
            self.allowed[:, 2 + 2 * k] = False
            self.allowed[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
        self.start = np.array([NEVER if t and t % 2 == 0 else 0.0 for t in range(self.tags)])

    def transitions(self) -> np.ndarray:
        return np.where(self.allowed, self.p["tr"], NEVER)

    def _lstm(self, x: np.ndarray, way: str, keep: list | None):
        """Hidden states of one direction; x: (rows, steps, width)."""
        p, h = self.p, self.hidden
        steps = range(x.shape[1]) if way == "f" else range(x.shape[1] - 1, -1, -1)
        out = np.zeros((x.shape[0], x.shape[1], h))
        s, c = np.zeros((x.shape[0], h)), np.zeros((x.shape[0], h))
        given = x @ p[f"x{way}"] + p[f"b{way}"]
        for t in steps:
            z = given[:, t] + s @ p[f"h{way}"]
            g = _sigmoid(z[:, : 3 * h])
            f, i, o, a = g[:, :h], g[:, h:2 * h], g[:, 2 * h:], np.tanh(z[:, 3 * h:])
            before, was = c, s
            c = f * c + i * a
            tc = np.tanh(c)
            s = o * tc
            out[:, t] = s
            if keep is not None:
                keep.append((t, f, i, o, a, before, tc, was))
        return out

    def emissions(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        e = self.p["emb"][x]
        kept = {w: [] if keep is not None else None for w in "fb"}
        both = np.concatenate([self._lstm(e, w, kept[w]) for w in "fb"], axis=2)
        if keep is not None:
            keep.update(e=e, both=both, kept=kept)
        return both @ self.p["out"] + self.p["ob"]

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """Best tags of a batch of emissions (rows, steps, tags)."""
        path = Path(self, len(scores))
        path.add(scores)
        return path.tags()

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tags y, and its gradients."""
        keep: dict = {}
        em, tr = self.emissions(x, keep), self.transitions()
        rows, steps, n = em.shape
        at = np.arange(rows)
        lse = lambda v, axis: (m := v.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis=axis))
        a, b = np.zeros(em.shape), np.zeros(em.shape)
        a[:, 0] = em[:, 0] + self.start
        for t in range(1, steps):
            a[:, t] = em[:, t] + lse(a[:, t - 1, :, None] + tr[None], 1)
        for t in range(steps - 2, -1, -1):
            b[:, t] = lse(tr[None] + (em[:, t + 1] + b[:, t + 1])[:, None, :], 2)
        z = lse(a[:, -1], 1)
        gold = em[at[:, None], np.arange(steps), y].sum(axis=1) + tr[y[:, :-1], y[:, 1:]].sum(axis=1)
        g_em = np.exp(a + b - z[:, None, None])
        g_em[at[:, None], np.arange(steps), y] -= 1
        g_tr = np.zeros((n, n))
        for t in range(1, steps):
            g_tr += np.exp(a[:, t - 1, :, None] + tr[None] + (em[:, t] + b[:, t])[:, None, :] - z[:, None, None]).sum(axis=0)
        np.add.at(g_tr, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1.0)
        g = {"tr": np.where(self.allowed, g_tr, 0.0), "ob": g_em.sum((0, 1)), "out": np.tensordot(keep["both"], g_em, ((0, 1), (0, 1)))}
        d_both = g_em @ self.p["out"].T
        d_e = np.zeros(keep["e"].shape)
        h = self.hidden
        for w, part in (("f", d_both[:, :, :h]), ("b", d_both[:, :, h:])):
            gx, gh, gb = np.zeros_like(self.p[f"x{w}"]), np.zeros_like(self.p[f"h{w}"]), np.zeros_like(self.p[f"b{w}"])
            ds, dc = np.zeros((rows, h)), np.zeros((rows, h))
            for t, f, i, o, c_in, before, tc, was in reversed(keep["kept"][w]):
                ds = ds + part[:, t]
                dc = dc + ds * o * (1 - tc * tc)
                dz = np.concatenate([dc * before * f * (1 - f), dc * c_in * i * (1 - i), ds * tc * o * (1 - o), dc * i * (1 - c_in * c_in)], axis=1)
                gx += keep["e"][:, t].T @ dz
                gh += was.T @ dz
                gb += dz.sum(axis=0)
                d_e[:, t] += dz @ self.p[f"x{w}"].T
                ds, dc = dz @ self.p[f"h{w}"].T, dc * f
            g |= {f"x{w}": gx, f"h{w}": gh, f"b{w}": gb}
        g["emb"] = np.zeros_like(self.p["emb"])
        np.add.at(g["emb"], x, d_e)
        return float((z - gold).mean()), {k: v / rows for k, v in g.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 16, batch: int = 64, rate: float = 0.01, seed: int = 5) -> list[float]:
        """Adam over shuffled batches; the mean loss of every epoch."""
        rng = np.random.default_rng(seed)
        m1, m2 = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        k, losses = 0, []
        for _ in range(epochs):
            order, total = rng.permutation(len(x)), 0.0
            for s in range(0, len(x), batch):
                pick = order[s:s + batch]
                value, g = self.loss(x[pick], y[pick])
                total += value * len(pick)
                k += 1
                size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
                for name, v in g.items():
                    v = v * min(1.0, 5.0 / max(size, 1e-9))
                    m1[name] = 0.9 * m1[name] + 0.1 * v
                    m2[name] = 0.999 * m2[name] + 0.001 * v * v
                    self.p[name] -= rate * (m1[name] / (1 - 0.9 ** k)) / (np.sqrt(m2[name] / (1 - 0.999 ** k)) + 1e-8)
            losses.append(total / max(len(x), 1))
        return losses


class Path:
    """Best tags of emissions that come block by block: forward scores and back pointers are carried on."""

    def __init__(self, model: Tagger, rows: int):
        self.tr, self.start, self.rows = model.transitions(), model.start, rows
        self.best: np.ndarray | None = None
        self.back: list[np.ndarray] = []

    def add(self, scores: np.ndarray) -> None:
        """The next steps of all rows: (rows, steps, tags)."""
        back = np.zeros(scores.shape, np.int8)
        for t in range(scores.shape[1]):
            if self.best is None:
                self.best = scores[:, t] + self.start
                continue
            all_ways = self.best[:, :, None] + self.tr[None]
            back[:, t] = all_ways.argmax(axis=1)
            self.best = all_ways.max(axis=1) + scores[:, t]
        self.back.append(back)

    def tags(self) -> np.ndarray:
        back, at = np.concatenate(self.back, axis=1), np.arange(self.rows)
        tags = np.zeros(back.shape[:2], np.int8)
        tags[:, -1] = self.best.argmax(axis=1)
        for t in range(back.shape[1] - 1, 0, -1):
            tags[:, t - 1] = back[at, t, tags[:, t]]
        return tags
