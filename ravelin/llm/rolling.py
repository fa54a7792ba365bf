"""Vectorised hashes of substrings: polynomials over bytes, modulo 2**64.

Substrings compared by them are far shorter than the 1,024 bytes from which structured strings can collide for any base.
"""

from __future__ import annotations

import numpy as np

from ravelin.llm.common import mix

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
LETTERS, OTHERS = np.random.default_rng(2024).integers(0, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def span_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of b[start:end] for many spans, equal for equal bytes wherever they stand."""
    power, back = powers(_BASE, len(b)), powers(_INVERSE, len(b) + 1)[start]
    size, sums, out = (end - start).astype(np.uint64), np.zeros(len(b) + 1, np.uint64), []
    for letters in (LETTERS, OTHERS):
        np.cumsum(letters[b] * power, out=sums[1:])
        out.append(mix((sums[end] - sums[start]) * back + size))
    return out[0], out[1]


def gram_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k bytes in a row; k is a power of two."""
    h, size = LETTERS[b], 1
    while size < k:
        h = h[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + h[size:]
        size *= 2
    return mix(h)


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every w values in a row."""
    n, size = len(x) - w + 1, 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[w - size : w - size + n])
