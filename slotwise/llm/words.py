"""Hashes of words and word shingles, computed on whole byte buffers.

A word's hash is the difference of two prefix sums of a polynomial over its
bytes (modulo 2**64, each byte first mapped to a fixed random 64-bit value),
brought to the same power and mixed. It depends on the word alone, so it is the
same in every task and session.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII that is neither a letter nor a digit; bytes of other alphabets count as letters.
NOT_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_BYTES = np.random.Generator(np.random.PCG64(20)).integers(1, 2**63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), kept and grown by doubling."""
    kept = _powers.get(base)
    if kept is None or len(kept) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        kept = np.empty(size, np.uint64)
        kept[0] = 1
        done = 1
        while done < size:
            step = np.uint64(pow(base, done, 2**64))
            kept[done : 2 * done] = kept[: min(done, size - done)] * step
            done *= 2
        _powers[base] = kept
    return kept[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte (in UTF-8) of each word of the lower-cased
    text; words lie between the bytes marked in ``breaks``."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    inside = np.empty(len(data) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~breaks[data]
    edge = np.flatnonzero(np.diff(inside))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64), start, end
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * _power(_BASE, len(data)), out=total[1:])
    return mix((total[end] - total[start]) * _power(_INVERSE, len(data) + 1)[start]), start, end


def batch_hashes(texts: list[str], breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each word of several texts, in order; the same
    hashes as those of ``word_hashes``."""
    lower = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(lower), np.uint8)
    inside = np.empty(len(data) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~breaks[data]
    edge = np.flatnonzero(np.diff(inside))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64), np.empty(0, int)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * _power(_BASE, len(data)), out=total[1:])
    begins = np.cumsum([0, *(len(x) + 1 for x in lower[:-1])])
    return mix((total[end] - total[start]) * _power(_INVERSE, len(data) + 1)[start]), np.searchsorted(begins, start, "right") - 1


def runs(texts: Iterable[str], size: int = 2**18) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``size`` characters, with the first one's number."""
    first, held, n = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t)
        n += len(t)
        if n >= size:
            yield first, held
            first, held, n = i + 1, [], 0
    if held:
        yield first, held


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; of all words, if there are fewer."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(size, n)
    out = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        out = mix(out + hashes[k : n - size + 1 + k]) * np.uint64(0xD6E8FEB86659FD93)
    return mix(out + np.uint64(size))
