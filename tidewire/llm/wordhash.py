"""Word and shingle fingerprints of many texts at once, computed on their UTF-8 bytes with numpy.

Words are runs of bytes other than space and 0x09-0x0D, A-Z lower-cased. A word's fingerprint is 64 bits of a polynomial
over randomly mapped bytes, finished by a mixing step; a shingle's is made of its words' in order.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20_240_229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_class(separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes end a word, and what each byte counts for in a word's fingerprint."""
    value = _BYTE[_LOWER]
    value[separators] = 0
    return separators, value


#: Words between white space, and words of letters, digits and non-ASCII characters alone.
SPACED = word_class(_SEP)
_PUNCT = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
ALNUM = word_class(_PUNCT)
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, 1 << 18)
        for k, b in ((0, _BASE), (1, pow(_BASE, -1, 1 << 64))):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers


def words_of(data: bytes, kind: tuple[np.ndarray, np.ndarray] = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint, first byte and byte after the last of each word."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    power, inverse = _tables(len(a))
    word = ~kind[0][a]
    edge = np.flatnonzero(np.diff(word)) + 1
    edges = np.concatenate([[0] if word[0] else [], edge, [len(a)] if word[-1] else []]).astype(np.int64)
    starts, ends = edges[0::2], edges[1::2]
    total = np.cumsum(kind[1][a] * power[: len(a)], dtype=np.uint64)
    h = total[ends - 1] - np.where(starts > 0, total[starts - 1], np.uint64(0))
    return mix(h * inverse[starts] + (ends - starts).astype(np.uint64)), starts, ends


def texts_words(texts: list[str], kind: tuple[np.ndarray, np.ndarray] = SPACED) -> list[np.ndarray]:
    """Word fingerprints of each text, in order."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    h, starts, _ = words_of(b"\n".join(data), kind)
    at = np.cumsum([0] + [len(d) + 1 for d in data])
    cut = np.searchsorted(starts, at)
    return [h[cut[i] : cut[i + 1]] for i in range(len(texts))]


def ngrams(words: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of the k-word windows, in order; with fewer words, the whole sequence as one."""
    n = len(words)
    if not n:
        return words
    size = min(k, n)
    x = words[: n - size + 1].copy()
    for j in range(1, size):
        x *= _STEP
        x += words[j : n - size + 1 + j]
    return mix(x + np.uint64(size))


def shingle_sets(texts: list[str], k: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingles of each whole text."""
    return [np.unique(ngrams(w, k)) for w in texts_words(texts)]


def slices(lengths: list[int], most: int = 1 << 18) -> list[tuple[int, int]]:
    """Ranges of texts with about ``most`` characters together; a longer text has a range of its own."""
    out, at, held = [], 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > most:
            out.append((at, i))
            at, held = i, 0
        held += n
    if lengths:
        out.append((at, len(lengths)))
    return out
