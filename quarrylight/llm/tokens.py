"""Byte-level BPE ids with a cache of pieces.

The pre-tokenizer of the public byte-level vocabularies cuts a text into pieces (letters, digits, other signs, white space)
and merges bytes inside a piece only. So the ids of a piece can be looked up when it comes again. Texts of Latin letters are
cut by a character-class expression of the standard library, which is faster than Unicode properties; any other text goes to
the library in one go. Both ways give the ids that the tokenizers library gives for the same vocabulary (tested).
"""

from __future__ import annotations

import base64
import re
import unicodedata

import numpy as np

#: Entries after which a worker's cache starts afresh; bounds its memory, not the result.
CACHE_ENTRIES = 500_000
#: Longer pieces are rare; keeping them would only cost memory.
CACHED_CHARS = 32
#: Code points below this are told apart by the classes below.
LATIN_END = 0x250


def _char_class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(LATIN_END) if unicodedata.category(chr(c))[0] == kind)


def _latin_pieces() -> re.Pattern:
    letters, numbers, white = _char_class("L"), _char_class("N"), "\t-\r \x85\xa0"
    return re.compile(f" ?[{letters}]+|'(?:[stmd]|re|ve|ll)| ?[{numbers}]+| ?[^{white}{letters}{numbers}]+|[{white}]+(?![^{white}])|[{white}]+")


LATIN_PIECES = _latin_pieces()
BEYOND_LATIN = re.compile(f"[^\x00-{chr(LATIN_END - 1)}]")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a vocabulary file of the library (*.json) with their ids. Only plain ones are known here."""
    import json

    with open(path, encoding="utf-8") as f:
        found = json.load(f).get("added_tokens") or []
    odd = [t["content"] for t in found if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]]
    if odd:
        raise ValueError(f"added tokens that take more than their own characters: {odd}")
    return {t["content"]: t["id"] for t in found}


class ByteBpe(dict):
    """piece -> its ids as little-endian uint32, filled on demand. `path`: a vocabulary file of ranks (*.tiktoken). `added`: tokens
    that are cut out of a text before the merges, and their ids."""

    def __init__(self, path: str, added: dict[str, int] | None = None):
        super().__init__()
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self._core = self.encoding._core_bpe
        self.added = {a: i.to_bytes(4, "little") for a, i in (added or {}).items()}
        # of those that start at one place the longest is taken
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "surrogatepass")
        rank = self.ranks.get(raw)
        if rank is not None:
            ids = rank.to_bytes(4, "little")
        else:
            ids = b"".join([i.to_bytes(4, "little") for i in self._core.encode_single_piece(raw)])
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """All ids of a text, four bytes each."""
        if self.cut is None:
            return self.merged(text)
        # the parts between added tokens stand at even places
        return b"".join([self.added[part] if k % 2 else self.merged(part) for k, part in enumerate(self.cut.split(text))])

    def merged(self, text: str) -> bytes:
        """Ids of a text or part without added tokens."""
        if BEYOND_LATIN.search(text):
            return np.array(self.encoding.encode_ordinary(text), dtype="<u4").tobytes()
        return b"".join(map(self.__getitem__, LATIN_PIECES.findall(text)))
