"""A character-level bidirectional LSTM with a conditional random field, in numpy."""

from __future__ import annotations

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: Tag 0 is outside; 2k + 1 begins a span of kind k and 2k + 2 goes on with it.
TAGS = 2 * len(KINDS) + 1
WINDOW = 96
STRIDE = 48
EMBED, HIDDEN = 10, 14
SYMBOLS = 98  # 0 past the end, printable ASCII, line ends and tabs, all else


def symbols(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    printable = (c >= 32) & (c < 127)
    return np.where(printable, c - 31, np.where(c < 32, 96, 97)).astype(np.int64)


def _allowed() -> np.ndarray:
    """0 where a tag may follow another, else a large loss."""
    out = np.zeros((TAGS, TAGS))
    for a in range(TAGS):
        for b in range(2, TAGS, 2):  # going on needs a begin or a going on of its kind
            if a not in (b - 1, b):
                out[a, b] = -1e4
    return out


RULE = _allowed()
START = np.array([-1e4 if b and b % 2 == 0 else 0.0 for b in range(TAGS)])


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    def __init__(self, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        normal = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[-2]), shape)
        self.p = {
            "embed": rng.normal(0, 0.5, (SYMBOLS, EMBED)), "wx": normal(2, EMBED, 4 * HIDDEN), "wh": normal(2, HIDDEN, 4 * HIDDEN),
            "b": np.zeros((2, 1, 4 * HIDDEN)), "u": normal(2 * HIDDEN, TAGS), "c": np.zeros(TAGS), "t": np.zeros((TAGS, TAGS)),
        }
        self.p["b"][:, :, HIDDEN : 2 * HIDDEN] = 1.0  # remember at first
        self.p["c"][0] = 2.0

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Emissions (length, batch, tags) of symbols (batch, length); both directions run as
        one, the second on the reversed text."""
        p, (n, length), h4 = self.p, x.shape, HIDDEN
        both = np.stack([x.T, x.T[::-1]])
        emb = p["embed"][both]
        pre = emb @ p["wx"][:, None] + p["b"][:, None]
        h = np.zeros((2, n, h4), dtype=pre.dtype)
        c = np.zeros_like(h)
        gates, cells, hs = np.empty_like(pre), np.empty((2, length, n, h4), pre.dtype), np.empty((2, length, n, h4), pre.dtype)
        for t in range(length):
            z = pre[:, t] + h @ p["wh"]
            z[..., : 3 * h4] = 0.5 * np.tanh(0.5 * z[..., : 3 * h4]) + 0.5
            z[..., 3 * h4 :] = np.tanh(z[..., 3 * h4 :])
            c = z[..., h4 : 2 * h4] * c + z[..., :h4] * z[..., 3 * h4 :]
            h = z[..., 2 * h4 : 3 * h4] * np.tanh(c)
            gates[:, t], cells[:, t], hs[:, t] = z, c, h
        joined = np.concatenate([hs[0], hs[1][::-1]], axis=-1)
        return joined @ p["u"] + p["c"], (both, emb, gates, cells, hs, joined)

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of tags (batch, length), and its gradients."""
        em, saved = self.forward(x)
        length, n, _ = em.shape
        t = self.p["t"] + RULE
        alpha, beta = np.empty_like(em), np.zeros_like(em)
        alpha[0] = em[0] + START
        for i in range(1, length):
            alpha[i] = em[i] + _logsum(alpha[i - 1][:, :, None] + t, 1)
        for i in range(length - 2, -1, -1):
            beta[i] = _logsum(t + (em[i + 1] + beta[i + 1])[:, None, :], 2)
        norm = _logsum(alpha[-1], 1)
        ys, rows = y.T, np.arange(n)
        gold = em[np.arange(length)[:, None], rows, ys].sum(0) + t[ys[:-1], ys[1:]].sum(0)
        dem = np.exp(alpha + beta - norm[None, :, None])
        dem[np.arange(length)[:, None], rows, ys] -= 1
        pair = np.exp(alpha[:-1, :, :, None] + t + (em[1:] + beta[1:])[:, :, None, :] - norm[None, :, None, None]).sum((0, 1))
        np.add.at(pair, (ys[:-1].ravel(), ys[1:].ravel()), -1)
        grads = self._backward(dem / n, saved)
        grads["t"] = np.where(RULE < 0, 0, pair) / n
        return float((norm - gold).mean()), grads

    def _backward(self, dem: np.ndarray, saved: tuple) -> dict[str, np.ndarray]:
        p, k = self.p, HIDDEN
        both, emb, gates, cells, hs, joined = saved
        flat = lambda a: a.reshape(-1, a.shape[-1])
        g = {"u": flat(joined).T @ flat(dem), "c": dem.sum((0, 1))}
        dj = dem @ p["u"].T
        dhs = np.stack([dj[..., :k], dj[::-1, :, k:]])
        dz = np.empty_like(gates)
        dh, dc = np.zeros_like(hs[:, 0]), np.zeros_like(hs[:, 0])
        for t in range(hs.shape[1] - 1, -1, -1):
            z, c = gates[:, t], np.tanh(cells[:, t])
            i, f, o, a = z[..., :k], z[..., k : 2 * k], z[..., 2 * k : 3 * k], z[..., 3 * k :]
            dh = dh + dhs[:, t]
            dc = dc + dh * o * (1 - c * c)
            before = cells[:, t - 1] if t else 0.0
            dz[:, t, :, :k] = dc * a * i * (1 - i)
            dz[:, t, :, k : 2 * k] = dc * before * f * (1 - f)
            dz[:, t, :, 2 * k : 3 * k] = dh * c * o * (1 - o)
            dz[:, t, :, 3 * k :] = dc * i * (1 - a * a)
            dc = dc * f
            dh = dz[:, t] @ p["wh"].transpose(0, 2, 1)
        last = np.concatenate([np.zeros_like(hs[:, :1]), hs[:, :-1]], axis=1)
        each = lambda a: a.reshape(2, -1, a.shape[-1])
        g["wh"] = each(last).transpose(0, 2, 1) @ each(dz)
        g["wx"] = each(emb).transpose(0, 2, 1) @ each(dz)
        g["b"] = each(dz).sum(1, keepdims=True)
        g["embed"] = np.zeros_like(p["embed"])
        np.add.at(g["embed"], both.ravel(), flat(dz @ p["wx"][:, None].transpose(0, 1, 3, 2)))
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 10, batch: int = 48, rate: float = 0.02, seed: int = 0) -> list[float]:
        """Adam over shuffled batches; the same rows give the same model. Returns the losses."""
        rng, losses, step = np.random.default_rng(seed), [], 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(v) for k, v in self.p.items()}
        steps = max(1, epochs * -(-len(x) // batch))
        for _ in range(epochs):
            order, total = rng.permutation(len(x)), 0.0
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                loss, grads = self.loss(x[rows], y[rows])
                total += loss * len(rows)
                step += 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                scale = min(1.0, 5.0 / (norm + 1e-9))
                now = rate * (1 - 0.9 * step / steps)
                for k, g in grads.items():
                    g = g * scale
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
            losses.append(total / max(1, len(x)))
        return losses

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Most likely tags (batch, length), and how much each one's emission exceeds that of
        tag 0."""
        em, _ = self.forward(x)
        length, n, _ = em.shape
        t = self.p["t"] + RULE
        best, came = em[0] + START, np.empty((length, n, TAGS), dtype=np.int8)
        for i in range(1, length):
            ways = best[:, :, None] + t
            came[i] = ways.argmax(1)
            best = ways.max(1) + em[i]
        tags = np.empty((length, n), dtype=np.int64)
        tags[-1], rows = best.argmax(1), np.arange(n)
        for i in range(length - 1, 0, -1):
            tags[i - 1] = came[i][rows, tags[i]]
        gain = np.take_along_axis(em, tags[:, :, None], 2)[:, :, 0] - em[:, :, 0]
        return tags.T, gain.T


def tag_row(length: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Tags of a window by its spans (start, kind, end)."""
    out = np.zeros(length, dtype=np.int64)
    for start, k, end in spans:
        out[start:end] = 2 * k + 2
        out[start] = 2 * k + 1
    return out


def spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) of one row of tags."""
    out, at = [], np.flatnonzero(tags)
    for i in at:
        if tags[i] % 2:
            out.append([int(i), int(tags[i] - 1) // 2, int(i) + 1])
        else:
            out[-1][2] = int(i) + 1
    return [tuple(x) for x in out]
