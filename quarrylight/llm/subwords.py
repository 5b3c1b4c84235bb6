"""Supervised subword embeddings: hashed vectors of words and their character n-grams, averaged over a document, softmax on top.

Training runs in numpy on the driver over a bounded sample of labelled texts. The average weighs a subword by a / (a + p), p its
share of all subwords in the sample, so that frequent ones do not drown the others. Scoring folds the model: the output is linear
in the mean vector, so a bucket needs two numbers (its weight, and its weight times its vector's product with the output), and a
document's score is the softmax of a weighted mean of them. N-grams of a batch are hashed with whole-array operations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

MULTIPLIER, FINISH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Stands for a word that repeats the one before it.
ECHO = "\x02\x02\x02"
#: Characters hashed in one go.
CHARS = 1 << 18


@dataclass(frozen=True)
class Shape:
    """What is hashed. forms: also n-grams of the letters' forms (capital, small, digit; signs as they are)."""

    bits: int = 18
    least: int = 3
    most: int = 5
    lower: bool = True
    forms: bool = False
    dim: int = 8
    a: float = 1e-4
    #: Added to a document's weight before dividing, so that a few subwords alone decide little.
    damp: float = 50.0
    #: A word counts once in a document, however often it is repeated.
    once: bool = True
    #: Words equal to the word before them become one sign.
    echoes: bool = False


def prepared(text: str | None, shape: Shape) -> str:
    """The text's words, or its distinct words in order of appearance, with one space between."""
    words = ((text or "").lower() if shape.lower else text or "").split()
    if shape.echoes:
        words = [ECHO if a == b else a for a, b in zip(words, [None, *words], strict=False)]
    return " ".join(dict.fromkeys(words) if shape.once else words)


def _codes(texts: list[str], shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, a space before each and after the last. And where each starts."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    x = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    return x, np.concatenate([[0], np.cumsum(sizes)[:-1]])


def _forms(x: np.ndarray) -> np.ndarray:
    """Capitals, small letters and digits of ASCII and Latin-1 as one sign each (above all code points)."""
    out = x.astype(np.uint64)
    out[((x >= 65) & (x <= 90)) | ((x >= 192) & (x <= 222))] = 1 << 22
    out[((x >= 97) & (x <= 122)) | ((x >= 223) & (x <= 255))] = 2 << 22
    out[(x >= 48) & (x <= 57)] = 3 << 22
    return out


def subwords(texts: list[str], shape: Shape) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, place) of every subword, kind by kind; places ascend within a kind and refer to _codes of the same texts."""
    x, _ = _codes(texts, shape)
    drop = np.uint64(64 - shape.bits)
    space = x == 32
    before = np.concatenate([[0], np.cumsum(space)])  # spaces left of a place
    for salt, codes in enumerate([x.astype(np.uint64)] + ([_forms(x)] if shape.forms else [])):
        h = codes + np.uint64(1 + 977 * salt)
        for n in range(2, shape.most + 1):
            if n > len(x):
                break
            h = h[: len(x) - n + 1] * MULTIPLIER + codes[n - 1 :]
            if n >= shape.least:
                at = np.flatnonzero(before[n - 1 : len(x)] - before[1 : len(x) - n + 2] == 0)  # no space inside
                yield (h[at] ^ (h[at] >> np.uint64(31))) * FINISH >> drop, at
        # whole words: a polynomial of the word's characters, made independent of where it stands
        edge = np.flatnonzero(space)
        start, end = edge[:-1] + 1, edge[1:]
        start, end = start[end > start], end[end > start]
        power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(x) - 1, MULTIPLIER)]))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * power)])
        back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(x) - 1, INVERSE)]))
        h = (sums[end] - sums[start]) * back[start] + np.uint64(31 + salt)
        yield (h ^ (h >> np.uint64(31))) * FINISH >> drop, start


@dataclass
class Model:
    shape: Shape
    weight: np.ndarray  # of a bucket in the mean
    value: np.ndarray  # weight times vector times (output 1 - output 0)
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability of label 1 for each text; a text without words has the bias alone."""
        out = np.empty(len(texts))
        lo = 0
        while lo < len(texts):
            hi, chars, part = lo, 0, []
            while hi < len(texts) and chars < CHARS:
                part.append(prepared(texts[hi], self.shape))
                chars += len(part[-1])
                hi += 1
            _, starts = _codes(part, self.shape)
            edges = np.append(starts, np.iinfo(np.int64).max)
            total, mass = np.zeros(len(part)), np.zeros(len(part))
            for bucket, at in subwords(part, self.shape):
                bucket = bucket.astype(np.int64)
                cut = np.searchsorted(at, edges)
                for sums, per in ((total, self.value), (mass, self.weight)):
                    run = np.concatenate([[0.0], np.cumsum(per[bucket])])
                    sums += run[cut[1:]] - run[cut[:-1]]
            z = self.bias + total / (mass + self.shape.damp)
            out[lo:hi] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            lo = hi
        return out


def train(texts: list[str | None], labels: list[int], shape: Shape, epochs: int = 5, rate: float = 0.5, seed: int = 1) -> Model:
    """Stochastic gradient descent, one document a step, each vector's step divided by the root of its squared gradients.
    With one label or none, the model is that label's share."""
    y = np.asarray(labels, np.int64)
    size = 1 << shape.bits
    if not len(y) or y.min() == y.max():
        p = float(y.mean()) if len(y) else 0.5
        return Model(shape, np.ones(size, np.float32), np.zeros(size, np.float32), float(np.log((p + 1e-3) / (1 - p + 1e-3))))
    bags = []
    seen = np.zeros(size)
    for t in texts:
        ids, n = np.unique(np.concatenate([b for b, _ in subwords([prepared(t, shape)], shape)]).astype(np.int32), return_counts=True)
        bags.append((ids, n.astype(np.float32)))
        seen[ids] += n
    share = seen / max(1.0, seen.sum())
    weight = (shape.a / (shape.a + share)).astype(np.float32)
    bags = [(ids, (w := n * weight[ids]) / (float(w.sum()) + shape.damp)) for ids, n in bags]
    rng = np.random.default_rng(seed)
    vectors = (rng.random((size, shape.dim), dtype=np.float32) - 0.5) / shape.dim * 0.1
    squares = np.full(size, 1e-6, np.float32)
    out = np.stack([np.full(shape.dim, -1.0 / shape.dim, np.float32), np.full(shape.dim, 1.0 / shape.dim, np.float32)])
    # a text that says nothing gets the share of label 1
    out_bias = np.array([0.0, np.log(y.mean() / (1 - y.mean()))], np.float32)
    steps, total = 0, epochs * len(y)
    for _ in range(epochs):
        for i in rng.permutation(len(y)).tolist():
            ids, part = bags[i]
            eta = rate * (1 - steps / total)
            steps += 1
            h = part @ vectors[ids] if len(ids) else np.zeros(shape.dim, np.float32)
            z = out @ h + out_bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = p @ out
            out -= eta * 0.1 * np.outer(p, h)
            if len(ids):
                grad = part[:, None] * back
                squares[ids] += (grad * grad).mean(axis=1)
                vectors[ids] -= (eta / np.sqrt(squares[ids]))[:, None] * grad
    bias = float(out_bias[1] - out_bias[0])
    return Model(shape, weight, (vectors @ (out[1] - out[0]) * weight).astype(np.float32), bias)
