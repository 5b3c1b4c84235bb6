"""Quality rules on word statistics and on how a public tokenizer's vocabulary takes to a text.

Base rules look at words (runs without ASCII white space). The fertility rules tokenise the whole text with a public byte-level
vocabulary, chosen by the text's main script, and measure characters per token, the share of byte-fallback tokens (tokens that
are not whole UTF-8 characters) and the entropy of tokens in windows that tile the text. A document outside the band of its
language, or else of its script, is rejected.

Defined results: a null lang falls back to the script; null text counts as no words (base_failed); empty and white-space texts likewise; no upper limit on length;
repeated rows are judged one by one; a null doc_id stays null; an empty table gives no rows; other columns are ignored by judge()
and come back unchanged, whatever their names, from keep_good().
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, small_batches
from .tokens import ByteBpe, vocabulary_path

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, script string, n_tokens long, chars_per_token double, fallback_share double, token_entropy double"
)
SYMBOLS = "#*$%&|<>"
#: Scripts by code point ranges, in the order in which they are tried.
SCRIPTS = {"latin": "A-Za-zÀ-ɏ", "cyrillic": "Ѐ-ԯ", "greek": "Ͱ-Ͽ", "arabic": "؀-ۿ", "devanagari": "ऀ-ॿ", "cjk": "぀-ヿ㐀-鿿가-힯"}
#: script -> vocabulary file.
VOCABULARIES = {"latin": "byte_bpe_50k.tiktoken", "other": "byte_bpe_multi_50k.tiktoken"}
#: Tokens of one entropy window. Windows tile the whole text, so the measure does not drift with its length.
WINDOW = 64
#: language or script -> least and most characters per token, most byte-fallback share, least relative window entropy.
#: A language's band goes before its script's. Learnt as the outer edge of clean prose; junk repeats a few sign tokens.
BANDS = {
    "en": (2.0, 8.0, 0.10, 0.855),
    "de": (1.8, 8.0, 0.15, 0.848),
    "fr": (1.7, 8.0, 0.30, 0.835),
    "es": (1.6, 8.0, 0.30, 0.812),
    "latin": (1.5, 8.0, 0.35, 0.78),
    "cyrillic": (1.2, 8.0, 0.50, 0.70),
    "greek": (0.8, 8.0, 0.60, 0.70),
    "arabic": (0.8, 8.0, 0.60, 0.70),
    "devanagari": (0.4, 8.0, 0.95, 0.55),
    "cjk": (0.4, 4.0, 0.95, 0.70),
    "other": (0.3, 10.0, 0.98, 0.50),
}
X_LOG_X = np.concatenate([[0.0], np.arange(1, 2 * WINDOW) * np.log2(np.arange(1, 2 * WINDOW))])


def main_script(text: str, classes: dict[str, re.Pattern]) -> str:
    if text.isascii():
        return "latin" if classes["latin"].search(text) else "other"
    counts = {k: len(p.sub("", text)) for k, p in classes.items()}
    best = min(counts, key=counts.get)
    return best if counts[best] < len(text) else "other"


def repeated_words(words: list[bytes]) -> int:
    """Words covered by 3-word windows that come twice or more."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    x = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    n = len(known)
    if n == len(words):
        return 0
    pair = x[:-1] * n + x[1:]
    pair = np.unique(pair, return_inverse=True)[1]
    _, at, counts = np.unique(pair[:-1] * n + x[2:], return_inverse=True, return_counts=True)
    again = counts[at] > 1
    covered = np.zeros(len(x), bool)
    covered[:-2] |= again
    covered[1:-1] |= again
    covered[2:] |= again
    return int(covered.sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split on ASCII white space only
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(" \t\n\v\f\r"):
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, " \t\n\v\f\r")), sum(map(text.count, SYMBOLS)), dup, repeated_words(words)


def window_entropy(ids: np.ndarray) -> float:
    """Mean entropy of consecutive windows over the most a window can have; what is left of a last window joins one that
    ends with the text. A text shorter than a window is one window."""
    n = len(ids)
    if n <= WINDOW:
        windows = ids[None, :]
    else:
        k = n // WINDOW
        windows = ids[: k * WINDOW].reshape(k, WINDOW)
        if n % WINDOW:
            windows = np.concatenate([windows, ids[None, n - WINDOW :]])
    rows = np.sort(windows, axis=1)
    first = np.ones(rows.shape, bool)
    first[:, 1:] = rows[:, 1:] != rows[:, :-1]
    runs = np.diff(np.append(np.flatnonzero(first), rows.size))
    m = rows.shape[1]
    return float(1 - X_LOG_X[runs].sum() / rows.size / math.log2(m)) if m > 1 else 1.0


def measure(ids: np.ndarray, broken: np.ndarray, n_chars: int) -> tuple[int, float, float, float]:
    """Tokens, characters per token, byte-fallback share, relative window entropy."""
    n = len(ids)
    return (n, n_chars / n, float(broken[ids].mean()), window_entropy(ids)) if n else (0, 0.0, 0.0, 0.0)


class Judge:
    """text -> the values of SCHEMA behind doc_id; vocabularies are loaded when a script first comes up."""

    def __init__(self, bands: dict[str, tuple] | None = None, vocabularies: dict[str, str] | None = None, least_words: int = 50, most_repeat: int = 50):
        self.bands = bands or BANDS
        self.paths = vocabularies or {k: vocabulary_path(v) for k, v in VOCABULARIES.items()}
        self.least_words, self.most_repeat = least_words, most_repeat
        self.classes = {k: re.compile(f"[{v}]+") for k, v in SCRIPTS.items()}
        self.loaded: dict[str, tuple[ByteBpe, np.ndarray]] = {}

    def vocabulary(self, script: str) -> tuple[ByteBpe, np.ndarray]:
        path = self.paths.get(script, self.paths["other"])
        if path not in self.loaded:
            bpe = ByteBpe(path)
            broken = np.zeros(max(bpe.ranks.values()) + 1, bool)
            broken[[i for raw, i in bpe.ranks.items() if not _whole(raw)]] = True
            self.loaded[path] = bpe, broken
        return self.loaded[path]

    def __call__(self, text: str | None, lang: str | None = None) -> tuple:
        text = text or ""
        n_words, word_chars, n_symbols, n_dup, n_repeat = base_counts(text)
        failed = n_words < self.least_words or 100 * n_repeat > self.most_repeat * n_words
        script = main_script(text, self.classes)
        bpe, broken = self.vocabulary(script)
        n, per, fallback, entropy = measure(np.frombuffer(bpe.ids(text), "<u4"), broken, len(text))
        lo, hi, most_fallback, least_entropy = self.bands.get(lang) or self.bands.get(script) or self.bands["other"]
        kept = not failed and lo <= per <= hi and fallback <= most_fallback and entropy >= least_entropy
        return n_words, word_chars, n_symbols, n_dup, n_repeat, failed, kept, script, n, per, fallback, entropy


def judge(docs: DataFrame, **options) -> DataFrame:
    """One verdict per row of docs."""

    def start():
        of = Judge(**options)
        return lambda columns: ((doc_id, *of(text, lang)) for doc_id, text, lang in zip(*columns, strict=True))

    return map_rows(docs, ["doc_id", "text", "lang"], SCHEMA, start)


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs whose text passes, all columns unchanged. The verdict is computed beside the row; nothing is joined."""
    small_batches(docs.sparkSession)
    state: list[Judge] = []

    @F.pandas_udf("boolean")
    def passes(texts: pd.Series, langs: pd.Series) -> pd.Series:
        if not state:
            state.append(Judge(**options))
        return pd.Series([state[0](t if isinstance(t, str) else "", g)[6] for t, g in zip(texts, langs, strict=True)], dtype=bool)

    return docs.where(passes(F.col("text"), F.col("lang")))


def _whole(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True
