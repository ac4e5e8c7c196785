"""Words of many texts at once, on their UTF-8 bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Every byte with A-Z in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Bytes whose words are hashed at once.
PIECE = 1 << 20

_P = 0x9E3779B97F4A7C15  # odd, so that powers have inverses modulo 2**64
_P_INV = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {"p": np.ones(1, np.uint64), "q": np.ones(1, np.uint64)}


def _upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["p"]) < n:
        size = max(n, 1 << 20)
        for key, base in (("p", _P), ("q", _P_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["p"][:n], _powers["q"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """starts, ends: of each word in the step's bytes; ptr: words of text i are ptr[i]:ptr[i + 1]; low: the bytes in lower case."""

    starts: np.ndarray
    ends: np.ndarray
    ptr: np.ndarray
    low: np.ndarray

    def hashes(self) -> np.ndarray:
        """Equal words have equal values; different words, almost never. A long text's words are hashed piece by piece."""
        n = len(self.starts)
        out = np.empty(n, np.uint64)
        k = 0
        while k < n:
            base = self.starts[k]
            e = max(k + 1, int(np.searchsorted(self.ends, base + PIECE, "right")))
            part = self.low[base : self.ends[e - 1]]
            p, q = _upto(len(part) + 1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * p[: len(part)], out=sums[1:])
            starts, ends = self.starts[k:e] - base, self.ends[k:e] - base
            out[k:e] = (sums[ends] - sums[starts]) * q[starts]
            k = e
        return mix(out)

    def texts(self) -> np.ndarray:
        """The text that each word is of."""
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))


def byte_class(inside) -> np.ndarray:
    """A table of the bytes for which inside(byte) holds."""
    return np.array([bool(inside(b)) for b in range(256)])


def find_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Words:
    """Runs of word bytes, A-Z in lower case; a run never goes on from one text to the next."""
    low = LOWER[data]
    mask = np.zeros(len(low) + 2, bool)
    mask[1:-1] = is_word[low]
    inner = mask[1:-1]
    before, after = mask[:-2].copy(), mask[2:].copy()
    full = offsets[:-1][offsets[1:] > offsets[:-1]]
    before[full] = False
    if len(full) > 1:
        after[full[1:] - 1] = False
    starts = np.flatnonzero(inner & ~before)
    ends = np.flatnonzero(inner & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, offsets), low)
