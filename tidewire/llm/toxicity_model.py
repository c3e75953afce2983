"""The numpy side of the toxicity model: n-grams, their vectors, the softmax, and the fit."""

from __future__ import annotations

import numpy as np

#: Lengths of n-grams in characters, a word's edges included; rows of the table of vectors; their length.
SIZES, BUCKETS, DIM = (4, 5, 6, 7), 1 << 20, 8
#: The average is multiplied by this before the softmax; so many neutral n-grams are part of each average.
SCALE, NEUTRAL = 100.0, 300.0
#: The model is fitted on this many labelled documents at most (a bounded sample: the first by a hash of the id), with so
#: many characters together at most: the sample ends before the document that would pass it, whatever comes later.
TRAIN_ROWS, TRAIN_CHARS = 6_000, 24_000_000
EPOCHS, BATCH, RATE, SEED = 12, 96, 2.0, 11
#: A gradient longer than this is shortened to it.
CLIP = 0.25
#: With few documents the epochs are as many as it takes to make so many steps.
LEAST_STEPS = 500
#: Label 1 is rarer and counts so many times in the fit.
POSITIVE = np.float32(2.0)
#: An n-gram that fewer training documents hold keeps a vector of zeros; of fewer than 100 times as many documents, one
#: that fewer than a hundredth of them hold.
MIN_DOCS = 5
_PRIMES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xB5297A4D, 0x68E31DA5], np.uint32)


def subwords(text: str) -> np.ndarray:
    """Rows of the table for every n-gram of a whole text, in lower case. No n-gram reaches over white space."""
    a = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    gap = (a == 32) | (a - np.uint32(9) < 5) | (a == 0xA0)
    c = np.where(gap, np.uint32(32), a)
    inner, out = ~gap, []
    h = c[:-1] * _PRIMES[0] + c[1:] * _PRIMES[1]
    ok = np.ones(len(a) - 1, bool)
    for n in range(3, max(SIZES) + 1):
        if len(a) < n:
            break
        h = h[:-1] + c[n - 1 :] * _PRIMES[n - 1]
        ok = ok[:-1] & inner[n - 2 : len(a) - 1]
        if n in SIZES:
            x = h[ok]
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(n)
            out.append((x ^ (x >> np.uint32(13))) & np.uint32(BUCKETS - 1))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def tallied(text: str) -> tuple[np.ndarray, np.ndarray, np.float32]:
    """The rows of a whole text's n-grams, each once, how often it has each, and what one of them weighs."""
    g = subwords(text)
    u, n = np.unique(g, return_counts=True)
    return u.astype(np.int32), n.astype(np.int32), np.float32(SCALE * trust(n) / max(1, len(g)))


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a whole text's n-grams, each once, and their scaled share of all its n-grams."""
    u, n, one = tallied(text)
    return u, n * one


def trust(counts: np.ndarray) -> float:
    """How far an average over few different n-grams counts: as if NEUTRAL n-grams without meaning stood beside them.

    Short texts and texts that repeat a few words have a small effective number of n-grams, the square of the sum of the
    counts over the sum of their squares."""
    n = counts.astype(np.float64)
    effective = n.sum() ** 2 / (n * n).sum() if len(n) else 0.0
    return float(effective / (effective + NEUTRAL))


class Batch:
    """Some documents' n-grams, in the order of documents and in the order of rows. Ten bytes an n-gram and document."""

    def __init__(self, texts: list[str], labels: np.ndarray, common: np.ndarray):
        found, sizes, one = [], [], []
        for t in texts:
            u, n, w = tallied(t)
            keep = common[u]
            found.append((u[keep], n[keep]))
            sizes.append(len(found[-1][0]))
            one.append(w)
        rows, n = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        small = np.uint16 if n.max(initial=0) < 1 << 16 else np.int32
        self.n, self.one, self.y = n.astype(small), np.array(one, np.float32), labels.astype(np.float32)
        self.starts, self.empty = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64), np.array(sizes) == 0
        self.rows, inverse = np.unique(rows, return_inverse=True)
        self.at = inverse.astype(np.int32)
        order = np.argsort(self.at, kind="stable")
        self.doc, self.n_by_row = np.repeat(np.arange(len(texts), dtype=np.int16), sizes)[order], self.n[order]
        self.row_starts = np.searchsorted(self.at[order], np.arange(len(self.rows)))

    def means(self, vectors: np.ndarray) -> np.ndarray:
        """The scaled average of each document's vectors; ``vectors`` has those of ``rows``."""
        z = np.zeros((len(self.y), vectors.shape[1]), np.float32)
        if len(self.at):
            z[~self.empty] = np.add.reduceat(vectors[self.at] * self.n[:, None].astype(np.float32), self.starts[~self.empty], axis=0)
        return z * self.one[:, None]

    def spread(self, g: np.ndarray) -> np.ndarray:
        """For each of ``rows`` the sum of its documents' gradients."""
        g = g * self.one[:, None]
        return np.add.reduceat(g[self.doc] * self.n_by_row[:, None].astype(np.float32), self.row_starts, axis=0) if len(self.at) else np.zeros((0, g.shape[1]), np.float32)


class Toxicity:
    """A trained model: a number a n-gram and a constant."""

    def __init__(self, table: np.ndarray, constant: float):
        self.table, self.constant = table, constant

    def score(self, text: str) -> float:
        u, w = counted(text)
        z = self.constant + float(self.table[u] @ w)
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS) -> Toxicity:
    """Train vectors and softmax together by gradient descent on batches of documents. With labels of one kind only, or none, every
    score is the share of label 1 (smoothed)."""
    y = np.array(labels, np.float32)
    rng = np.random.default_rng(SEED)
    if len(set(labels)) < 2:
        share = (float(y.sum()) + 0.5) / (len(y) + 1.0) if len(y) else 0.25
        return Toxicity(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    mixed = rng.permutation(len(texts))
    in_docs = np.zeros(BUCKETS, np.int32)
    for t in texts:
        in_docs[np.unique(subwords(t))] += 1
    common = in_docs >= min(MIN_DOCS, -(-len(texts) // 100))
    del in_docs
    batches = [Batch([texts[i] for i in part], y[part], common) for part in (mixed[k : k + BATCH] for k in range(0, len(texts), BATCH))]
    vectors = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    softmax, bias = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.log(np.array([1 - y.mean(), y.mean()], np.float32))
    epochs = max(epochs, -(-LEAST_STEPS // len(batches)))
    step, steps = 0, epochs * len(batches)
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            b = batches[k]
            own = vectors[b.rows]
            z = b.means(own)
            s = z @ softmax + bias
            s = np.exp(s - s.max(axis=1, keepdims=True))
            p = s / s.sum(axis=1, keepdims=True)
            p[np.arange(len(p)), b.y.astype(int)] -= 1
            p *= np.where(b.y > 0, POSITIVE, np.float32(1.0))[:, None] / len(p)
            grads = [b.spread(p @ softmax.T), z.T @ p, p.sum(axis=0)]
            step += 1
            rate = RATE * (1 - (step - 1) / steps)
            for x, g, at in zip((vectors, softmax, bias), grads, (b.rows, slice(None), slice(None)), strict=True):
                x[at] -= rate * min(1.0, CLIP / (float(np.sqrt((g * g).sum())) + 1e-12)) * g
    vectors[~common] = 0
    return Toxicity((vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32), float(bias[1] - bias[0]))
