"""A causal self-attention model over subword ids, in numpy.

One layer: embeddings of ids and places, masked attention, and a rectified layer. An id is
predicted in two steps. The first picks a cluster of ids: its logits are those that the
counts of the corpus give after the id before it, plus what attention adds. The second picks
the id of the cluster by the counts of the corpus. Ids that begin a word have clusters of
their own, so the probability that a word ends is a sum over these. Texts are cut into
windows that overlap, so each id is scored once and has the ids before it in its window as
context.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WINDOW, STRIDE, CLUSTER = 24, 18, 16
WIDTH, HIDDEN = 16, 32
#: Occurrences that the smoothing of the corpus tables stands for.
SMOOTH = 2.0


@dataclass
class Shape:
    """ids: the size of the vocabulary, of which the first ``starts`` begin a word. The id before a text is ids."""

    ids: int
    starts: int

    @property
    def start_clusters(self) -> int:
        return -(-self.starts // CLUSTER)

    @property
    def clusters(self) -> int:
        return self.start_clusters - (-(self.ids - self.starts) // CLUSTER)

    def cluster_of(self) -> np.ndarray:
        i = np.arange(self.ids)
        return np.where(i < self.starts, i // CLUSTER, self.start_clusters + (i - self.starts) // CLUSTER)


def corpus_tables(shape: Shape, follows: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log P(cluster | id before) and log P(id | cluster, id before) from counts within words.

    follows[p, i] counts id i after id p, or as a word's first id where p is shape.ids; ends
    counts the last ids of words. A word's first id doesn't depend on the id before it here.
    """
    v, k, s = shape.ids, shape.clusters, shape.start_clusters
    cluster = shape.cluster_of()
    bounds = np.searchsorted(cluster, np.arange(k))
    by_cluster = lambda x: np.add.reduceat(x, bounds, axis=-1)
    unigram = follows.sum(0) + 0.5
    own = unigram / by_cluster(unigram)[cluster]
    of_cluster = by_cluster(follows)
    within = (follows + SMOOTH * own) / (of_cluster[:, cluster] + SMOOTH)
    within[:, : shape.starts] = within[v, : shape.starts]
    usual = by_cluster(unigram)
    first = (of_cluster[v, :s] + SMOOTH * usual[:s] / usual[:s].sum()) / (of_cluster[v, :s].sum() + SMOOTH)
    total = of_cluster[:v, s:].sum(1) + ends
    share = usual[s:].sum() / usual.sum()
    base = np.empty((v + 1, k))
    base[:v, s:] = (of_cluster[:v, s:] + SMOOTH * share * usual[s:] / usual[s:].sum()) / (total + SMOOTH)[:, None]
    base[:v, :s] = ((ends + SMOOTH * (1 - share)) / (total + SMOOTH))[:, None] * first
    base[v, :s], base[v, s:] = first * (1 - 1e-6), 1e-6 / max(1, k - s)
    return np.log(base).astype(np.float32), np.log(within).astype(np.float32)


def start_weights(shape: Shape, seed: int = 0) -> dict[str, np.ndarray]:
    """Small random weights, with which the model is nearly that of the corpus tables."""
    rng = np.random.default_rng(seed)
    d, h = WIDTH, HIDDEN
    normal = lambda *s, by: (rng.standard_normal(s) * by).astype(np.float32)
    return {
        "embed": normal(shape.ids + 1, d, by=0.3), "place": normal(WINDOW, d, by=0.1),
        "q": normal(d, d, by=d**-0.5), "k": normal(d, d, by=d**-0.5), "v": normal(d, d, by=d**-0.5), "o": normal(d, d, by=0.5 * d**-0.5),
        "w1": normal(d, h, by=d**-0.5), "b1": np.zeros(h, np.float32), "w2": normal(h, d, by=0.5 * h**-0.5), "b2": np.zeros(d, np.float32),
        "cw": normal(d, shape.clusters, by=0.02),
    }


_LATER = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)
_SEEN = (_LATER == 0).astype(np.float32)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    x /= x.sum(-1, keepdims=True)
    return x


def _body(w: dict, ids: np.ndarray) -> tuple:
    """Hidden states (windows, places, width) and what the backward pass needs."""
    x = w["embed"][ids] + w["place"][: ids.shape[1]]
    q, k, v = x @ w["q"], x @ w["k"], x @ w["v"]
    n = ids.shape[1]
    a = _softmax(q @ k.transpose(0, 2, 1) * np.float32(WIDTH**-0.5) + _LATER[:n, :n])
    m = a @ v
    y = x + m @ w["o"]
    h = np.maximum(y @ w["w1"] + w["b1"], 0)
    z = y + h @ w["w2"] + w["b2"]
    return z, (x, q, k, v, a, m, y, h)


def _states(w: dict, ids: np.ndarray, back: int) -> np.ndarray:
    """The hidden states of the places from back on, as rows. As _body has them, with fewer passes."""
    b, n = ids.shape
    d = WIDTH
    x = w["embed"][ids]
    x += w["place"][:n]
    # the last column is one for each place, so that sums of weights come with the weighed values
    mixed = np.concatenate([w["q"] * np.float32(d**-0.5), w["k"], w["v"], np.zeros((d, 1), np.float32)], 1)
    qkv = (x.reshape(b * n, d) @ mixed).reshape(b, n, 3 * d + 1)
    qkv[:, :, 3 * d] = 1
    a = np.matmul(qkv[:, back:, :d], qkv[:, :, d : 2 * d].transpose(0, 2, 1))
    if a.max(initial=0) > 60:
        np.minimum(a, 60, out=a)
    np.exp(a, out=a)
    a *= _SEEN[back:n, :n]
    m = np.matmul(a, qkv[:, :, 2 * d :]).reshape(b * (n - back), d + 1)
    y = (m[:, :d] / m[:, d:]) @ w["o"]
    y += x[:, back:].reshape(-1, d)
    h = y @ w["w1"]
    h += w["b1"]
    np.maximum(h, 0, out=h)
    z = h @ w["w2"]
    z += y
    z += w["b2"]
    return z


@dataclass
class Model:
    shape: Shape
    base: np.ndarray
    within: np.ndarray
    weights: dict[str, np.ndarray]

    def __post_init__(self):
        self.cluster = self.shape.cluster_of()
        self.sides = np.ones((self.shape.clusters, 2), np.float32)
        self.sides[self.shape.start_clusters :, 0] = 0

    def log_probabilities(self, z: np.ndarray, before: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log P of each id from its hidden state (rows, width) and the id before it, and log P that a word begins.

        That of an id that begins a word is given that a word begins.
        """
        x = z @ self.weights["cw"]
        x += self.base[before]
        if x.max(initial=0) > 60:
            np.minimum(x, 60, out=x)
        chosen = x[np.arange(len(x)), self.cluster[ids]]
        np.exp(x, out=x)
        sums = np.log(x @ self.sides)  # of the clusters that begin a word, and of all
        first = ids < self.shape.starts
        return chosen - np.where(first, sums[:, 0], sums[:, 1]) + self.within[before, ids], sums[:, 0] - sums[:, 1]

    def score(self, ids: np.ndarray, lengths: np.ndarray, batch: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """For ids, the concatenation of texts of these lengths, what log_probabilities has, each scored once.

        Window number j of a text scores its ids from j * STRIDE on and has the WINDOW - STRIDE
        ids before them as context; each text is preceded by the start id.
        """
        start_id, back = self.shape.ids, WINDOW - STRIDE
        own, begins = np.zeros(len(ids), np.float32), np.zeros(len(ids), np.float32)
        per_text = -(-lengths // STRIDE)
        first = np.cumsum(lengths) - lengths
        text = np.repeat(np.arange(len(lengths)), per_text)
        j = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        padded = np.concatenate([np.full(1, start_id, ids.dtype), ids])
        for at in range(0, len(text), batch):
            t, s = text[at : at + batch], j[at : at + batch] * STRIDE
            place = s[:, None] - back + np.arange(WINDOW)  # the place in its text of what is predicted
            inside = (place >= 0) & (place < lengths[t][:, None])
            source = first[t][:, None] + place
            before = np.where(inside & (place > 0), padded[np.clip(source, 0, len(ids))], start_id)
            scored = inside[:, back:]
            where = source[:, back:][scored]
            states = _states(self.weights, before, back)
            own[where], begins[where] = self.log_probabilities(states[scored.ravel()], before[:, back:][scored], ids[where])
        return own, begins


def gradients(w: dict, base: np.ndarray, before: np.ndarray, cluster: np.ndarray, used: np.ndarray) -> tuple[float, dict]:
    """Mean loss of the clusters at the used places, and the gradients of all weights."""
    z, (x, q, k, v, a, m, y, h) = _body(w, before)
    g = {n: np.zeros_like(p) for n, p in w.items()}
    rows, t = z[used], cluster[used]
    n = max(1, len(t))
    p = _softmax(base[before[used]] + rows @ w["cw"])
    loss = -np.log(p[np.arange(len(t)), t] + 1e-30).sum() / n
    p[np.arange(len(t)), t] -= 1
    p /= np.float32(n)
    g["cw"] = rows.T @ p
    dz = np.zeros_like(z)
    dz[used] = p @ w["cw"].T
    flat = lambda u: u.reshape(-1, u.shape[-1])
    g["w2"], g["b2"] = flat(h).T @ flat(dz), flat(dz).sum(0)
    dh = (dz @ w["w2"].T) * (h > 0)
    g["w1"], g["b1"] = flat(y).T @ flat(dh), flat(dh).sum(0)
    dy = dz + dh @ w["w1"].T
    g["o"] = flat(m).T @ flat(dy)
    dm = dy @ w["o"].T
    da, dv = dm @ v.transpose(0, 2, 1), a.transpose(0, 2, 1) @ dm
    ds = a * (da - (da * a).sum(-1, keepdims=True)) * np.float32(WIDTH**-0.5)
    dq, dk = ds @ k, ds.transpose(0, 2, 1) @ q
    dqkv = np.concatenate([dq, dk, dv], 2)
    g["q"], g["k"], g["v"] = np.split(flat(x).T @ flat(dqkv), 3, axis=1)
    dx = dy + (flat(dqkv) @ np.concatenate([w["q"], w["k"], w["v"]], 1).T).reshape(dy.shape)
    g["place"][: before.shape[1]] = dx.sum(0)
    order = np.argsort(before, axis=None, kind="stable")
    own = before.ravel()[order]
    start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    g["embed"][own[start]] = np.add.reduceat(flat(dx)[order], start)
    return float(loss), g


def descend(w: dict, base: np.ndarray, shape: Shape, windows: np.ndarray, rate: float, batch: int = 64) -> dict[str, np.ndarray]:
    """Weights after one pass of Adam over windows (rows of WINDOW + 1 ids; -1 where a text has ended)."""
    cluster = np.r_[shape.cluster_of(), 0]
    m, s = ({n: np.zeros_like(p) for n, p in w.items()} for _ in range(2))
    steps = -(-len(windows) // batch)
    for step in range(1, steps + 1):
        part = windows[(step - 1) * batch : step * batch].astype(np.int64)
        before, targets = part[:, :-1], part[:, 1:]
        used = targets >= 0
        _, g = gradients(w, base, np.where(before < 0, shape.ids, before), cluster[np.where(used, targets, 0)], used)
        now = rate * min(1.0, step / 20) * (1 - 0.8 * step / steps) * (1 - 0.99**step) ** 0.5 / (1 - 0.9**step)
        for n in w:
            m[n] += np.float32(0.1) * (g[n] - m[n])
            s[n] += np.float32(0.01) * (g[n] * g[n] - s[n])
            w[n] = w[n] - np.float32(now) * m[n] / (np.sqrt(s[n]) + np.float32(1e-8))
    return w
