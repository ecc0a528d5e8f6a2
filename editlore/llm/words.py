"""Hashes of words and of runs of words, computed on the bytes of many texts at once."""

from __future__ import annotations

import numpy as np

np.seterr(over="ignore")  # hashes wrap around

_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = 0xD6E8FEB86659FD93  # odd, so that it has an inverse modulo 2**64
_BLOCK = 1 << 16


def word_table(separators) -> np.ndarray:
    """A table of bytes in lower case (A-Z only), 0 where ``separators(byte)``."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[[b for b in range(256) if separators(int(table[b]))]] = 0
    return table


#: Words of digits, letters and everything beyond ASCII.
PLAIN = word_table(lambda b: b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F)
#: Words between white space.
SPACED = word_table(lambda b: b <= 0x20)


def _powers(base: int) -> np.ndarray:
    out = np.empty(_BLOCK, np.uint64)
    out[0] = 1
    n = 1
    while n < _BLOCK:
        out[n:2 * n] = out[:n] * np.uint64(pow(base, n, 1 << 64))
        n *= 2
    return out


_UP, _DOWN = _powers(_STEP), _powers(pow(_STEP, -1, 1 << 64))


def power(at: np.ndarray, down: bool = False) -> np.ndarray:
    """The step to the power ``at``, or its inverse."""
    table = _DOWN if down else _UP
    base = pow(_STEP, (-1 if down else 1) * _BLOCK, 1 << 64)
    high = at // _BLOCK
    out = table[at % _BLOCK]
    if len(at) and high.max() > 0:
        large = np.array([pow(base, int(h), 1 << 64) for h in range(int(high.max()) + 1)], np.uint64)
        out = out * large[high]
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Numbers spread over all 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of some texts: ``hash`` of each, ``text`` it belongs to, and ``first``, each text's first word (one more at the end)."""

    def __init__(self, texts: list[str], table: np.ndarray = PLAIN):
        parts = [t.encode() for t in texts]
        data = table[np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)]
        inside = data != 0
        self.starts = np.flatnonzero(inside & ~np.insert(inside[:-1], 0, False))
        self.ends = np.flatnonzero(inside & ~np.append(inside[1:], False)) + 1
        place = np.arange(len(data))
        # A word's polynomial hash: sum of its bytes times powers of its places, divided by the power of its first place.
        sums = np.concatenate([[np.uint64(0)], np.cumsum(data * power(place), dtype=np.uint64)])
        self.hash = mix((sums[self.ends] - sums[self.starts]) * power(self.starts, down=True) ^ (self.ends - self.starts).astype(np.uint64) * _ODD)
        bounds = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
        self.first = np.searchsorted(self.starts, bounds)
        self.text = np.repeat(np.arange(len(parts)), np.diff(self.first))

    def runs(self, n: int) -> np.ndarray:
        """Hash of the ``n`` words from each word on; the last ``n - 1`` of all have none."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        out = np.zeros(m, np.uint64)
        for i in range(n):
            out = out * np.uint64(_STEP) + self.hash[i:m + i]
        return mix(out + np.uint64(n))

    def whole(self, n: int) -> np.ndarray:
        """Which of ``runs(n)`` stay inside their text."""
        m = max(0, len(self.hash) - n + 1)
        return self.text[:m] == self.text[n - 1:n - 1 + m]

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """All runs of ``n`` words with their texts, in order; a shorter text is one run of all its words."""
        runs, ok = self.runs(n), self.whole(n)
        texts, values = self.text[:len(runs)][ok], runs[ok]
        short = np.flatnonzero((np.diff(self.first) < n) & (np.diff(self.first) > 0))
        if len(short):
            extra = []
            for k in short.tolist():
                value = np.uint64(0)
                for h in self.hash[self.first[k]:self.first[k + 1]]:
                    value = value * np.uint64(_STEP) + h
                extra.append(value + np.uint64(self.first[k + 1] - self.first[k]))
            texts, values = np.concatenate([texts, short]), np.concatenate([values, mix(np.array(extra, np.uint64))])
            order = np.argsort(texts, kind="stable")
            texts, values = texts[order], values[order]
        return texts, values
