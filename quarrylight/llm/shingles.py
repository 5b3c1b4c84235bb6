"""Word shingles of a text as sorted arrays of 64-bit hashes, computed on whole arrays of bytes."""

from __future__ import annotations

import hashlib

import numpy as np

#: Bytes that are hashed at once; bounds memory, not the result.
STEP = 1 << 20
ODD, MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX)
    return x ^ (x >> np.uint64(29))


#: A 64-bit number for every byte value, from a rule.
BYTES = mixed(mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(ODD)))


def normal(text: str | None) -> bytes:
    """ASCII-lower-cased words, runs without ASCII white space, with one space between them."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def key_of(words: bytes) -> bytes | None:
    """A 128-bit name of a word sequence as normal() gives it; None without words."""
    return hashlib.blake2b(words, digest_size=16).digest() if words else None


class Shingler:
    """Distinct shingles of texts. Words are hashed by a polynomial over their bytes, from prefix sums of many words at once."""

    def __init__(self, size: int = 5):
        self.size = size
        self.power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(STEP, ODD, np.uint64)]))
        self.back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(STEP, pow(ODD, -1, 1 << 64), np.uint64)]))

    def _hashes(self, b: np.ndarray) -> np.ndarray:
        spaces = np.flatnonzero(b == 32)
        start, end = np.append(0, spaces + 1), np.append(spaces, len(b))
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(BYTES[b] * self.power[: len(b)], out=sums[1:])
        return mixed((sums[end] - sums[start]) * self.back[start])

    def hashes(self, words: bytes) -> np.ndarray:
        """A hash of each word. Words longer than STEP are hashed by themselves."""
        out, at, n = [], 0, len(words)
        while at < n:
            end = n if n - at <= STEP else words.rfind(b" ", at, at + STEP + 1)
            if end < 0:
                end = words.find(b" ", at)
                end = n if end < 0 else end
                out.append(np.frombuffer(hashlib.blake2b(words[at:end], digest_size=8).digest(), np.uint64))
            else:
                out.append(self._hashes(np.frombuffer(words, np.uint8, end - at, at)))
            at = end + 1
        return np.concatenate(out) if out else np.empty(0, np.uint64)

    def runs(self, h: np.ndarray, size: int) -> np.ndarray:
        """A hash of every `size` neighbours."""
        n = len(h) - size + 1
        x = np.full(n, size, np.uint64)
        for k in range(size):
            x = x * np.uint64(ODD) + h[k : k + n]
            x ^= x >> np.uint64(29)
        x *= np.uint64(MIX)
        x ^= x >> np.uint64(32)
        return x

    def of_words(self, words: bytes) -> np.ndarray:
        """Distinct shingles of one text, sorted. Fewer words than a shingle's make one shingle; no words make none."""
        return self.of_many([words])[0]

    def of_many(self, texts: list[bytes]) -> list[np.ndarray]:
        """of_words for each of many texts, hashed together."""
        counts = np.array([w.count(b" ") + 1 if w else 0 for w in texts], np.int64)
        h = self.hashes(b" ".join([w for w in texts if w]))
        ends = np.cumsum(counts)
        x = self.runs(h, self.size) if len(h) >= self.size else None
        out = []
        for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
            if n >= self.size:
                y = np.sort(x[end - n : end - self.size + 1])
                new = y[1:] != y[:-1]
                out.append(y if new.all() else y[np.append(True, new)])
            else:
                out.append(self.runs(h[end - n : end], n) if n else np.empty(0, np.uint64))
        return out
