"""Hashes of spans of text in numpy: after one prefix sum over a text, the hash of any span takes one step."""

from __future__ import annotations

import numpy as np

#: Code points that a worker hashes at once.
AT_ONCE = 1 << 20
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def codes_of(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def mixed(z: np.ndarray) -> np.ndarray:
    """Each number with its bits stirred; in place."""
    with np.errstate(over="ignore"):
        z ^= z >> np.uint64(30)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(27)
        z *= np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return z


def _powers_of(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of a base and of its inverse modulo 2^64, at least n of each."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size, base = max(AT_ONCE, n) + AT_ONCE // 4, _BASES[which]
        ups = [np.full(size, x, np.uint64) for x in (base, pow(base, -1, 1 << 64))]
        for u in ups:
            u[0] = 1
        have = _powers[which] = tuple(np.cumprod(u, dtype=np.uint64) for u in ups)
    return have


class Spans:
    """The hashes of the spans of some code points. A letter is a run of that many code points, stirred with which, so
    that the polynomial over them is that of no plain text; spans are at least one letter long."""

    def __init__(self, codes: np.ndarray, letter: int = 1, which: int = 0):
        with np.errstate(over="ignore"):
            z = codes.astype(np.uint64) + np.uint64(1 + which)
            n = len(codes) - letter + 1
            one = z
            z = one[: max(n, 0)].copy()
            for i in range(1, letter):
                z *= np.uint64(0x2545F4914F6CDD1D)
                z += one[i : i + n]
            mixed(z)
            self.letter, (up, self.down) = letter, _powers_of(which, len(codes) + 1)
            self.sums = np.zeros(len(z) + 1, np.uint64)
            np.cumsum(z * up[: len(z)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.sums[ends - (self.letter - 1)] - self.sums[starts]) * self.down[starts]
            h += (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return mixed(h)

    def windows(self, length: int) -> np.ndarray:
        """The hashes of the windows of that length at every place; of(place, place + length) gives the same."""
        m = length - (self.letter - 1)
        n = max(0, len(self.sums) - m)
        with np.errstate(over="ignore"):
            h = (self.sums[m : m + n] - self.sums[:n]) * self.down[:n]
            h += np.uint64(length) * np.uint64(0x9E3779B97F4A7C15)
        return mixed(h)
