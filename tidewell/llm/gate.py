"""Candidate search for the tagger: learnt weights of hashed character 5-grams, summed over a short window.

Every character of every text is scored; the tagger then reads all stretches that score above a threshold, with a
margin around them. The threshold is set from labelled, damaged spans so that none of those is lost.
"""

from __future__ import annotations

import numpy as np

BITS = 20
GRAM = 5
WINDOW = 12
MARGIN = 28
#: Weights are kept as bytes of this many steps a unit.
STEPS = 24


def features(c: np.ndarray) -> np.ndarray:
    """Hashed GRAM-grams of character classes; digits count as one, line ends as blanks."""
    c = np.where((c >= 48) & (c < 58), 48, np.where(c == 10, 32, c)).astype(np.uint32)
    h = c.copy()
    for k in range(1, GRAM):
        h *= np.uint32(401)
        h[:-k] += c[k:]
    h *= np.uint32(0x9E3779B1)
    return h >> np.uint32(32 - BITS)


def fit(windows: list[tuple[np.ndarray, np.ndarray]], lead: int = 8) -> np.ndarray:
    """Log-odds of each gram being in a span or in the ``lead`` characters before one, as bytes.

    ``windows`` are (classes, tags); tag 0 is outside.
    """
    there, all_ = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for c, tags in windows:
        inside = np.concatenate((tags > 0, np.zeros(lead, dtype=bool)))
        near = np.logical_or.reduce([inside[i : i + len(c)] for i in range(lead + 1)])
        f = features(c)
        there += np.bincount(f[near], minlength=1 << BITS)
        all_ += np.bincount(f, minlength=1 << BITS)
    rest = all_ - there
    odds = np.log((there + 0.3) / (rest + 0.3 * rest.sum() / max(there.sum(), 1)))
    return np.round(np.clip(odds, -5, 5) * STEPS).astype(np.int8)


def scores(c: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Mean weight of the WINDOW grams that begin at each character (fewer at the end)."""
    n = len(c)
    total = np.zeros(n + 1, dtype=np.int32)
    np.cumsum(weights[features(c)], dtype=np.int32, out=total[1:])
    out = np.empty(n, dtype=np.float32)
    whole = max(0, n - WINDOW + 1)
    np.subtract(total[WINDOW:], total[:whole], out=out[:whole], casting="unsafe") if whole else None
    out[:whole] *= np.float32(1 / (WINDOW * STEPS))
    rest = np.arange(whole, n)
    out[whole:] = (total[n] - total[whole:n]) / ((n - rest) * STEPS)
    return out


def stretches(c: np.ndarray, weights: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Ranges to be read by the tagger, merged where their margins meet."""
    hit = np.flatnonzero(scores(c, weights) >= threshold)
    if not len(hit):
        return []
    cut = np.flatnonzero(np.diff(hit) > 2 * MARGIN + WINDOW)
    first, last = hit[np.concatenate(([0], cut + 1))], hit[np.concatenate((cut, [len(hit) - 1]))]
    return [(max(0, int(a) - MARGIN), min(len(c), int(z) + WINDOW + MARGIN)) for a, z in zip(first, last, strict=True)]
