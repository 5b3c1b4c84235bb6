"""Comments, strings, templates and regular expressions of a source file as spans, carried across lines."""

from __future__ import annotations

import re
from bisect import bisect_right

#: Extensions by how comments and strings are written.
C_LIKE = set(".js .jsx .ts .tsx .mjs .cjs .mts .cts .java .kt .scala .go .rs .c .h .cpp .hpp .cc .cs .php .swift .dart .vue .svelte".split())
HASH = set(".py .rb .sh .bash .yml .yaml .toml .tf".split())
#: Characters after which a slash begins a regular expression in C-like languages.
BEFORE_REGEX = set("=([{,;:!&|?+-*%<>~^")

#: By language: where a span may begin, so that plain text is passed over at once. By quote: the rest of a string.
BEGINS = {"c-like": re.compile("['\"`/]"), "hash": re.compile("['\"`#]")}
REST = {q: re.compile(rf"(?:[^\\{q}]++|\\.)*+{q}", re.S) for q in "'\"`"}

Span = tuple[int, int, str]


def language(ext: str) -> str:
    return "c-like" if ext in C_LIKE else "hash" if ext in HASH else "unknown"


def _quoted(line: str, i: int) -> int | None:
    """End of the string that opens at i, or None if it does not close on this line."""
    m = REST[line[i]].match(line, i + 1)
    return m.end() if m else None


def _regex_end(line: str, i: int) -> int | None:
    j, in_class = i + 1, False
    while j < len(line):
        c = line[j]
        if c == "\\":
            j += 1
        elif c == "[":
            in_class = True
        elif c == "]":
            in_class = False
        elif c == "/" and not in_class:
            return j + 1
        j += 1
    return None


def spans(lines: list[str], kind: str) -> list[list[Span]]:
    """Per line the spans (start, end, str | tpl | re | cmt) in order. Languages that are not known have none."""
    if kind == "unknown":
        return [[] for _ in lines]
    out: list[list[Span]] = []
    state = ""  # "", "block" or "template"
    begins = BEGINS[kind]
    for line in lines:
        found: list[Span] = []
        out.append(found)
        i, n, last = 0, len(line), ""
        while i < n:
            if state == "block":
                end = line.find("*/", i)
                found.append((i, n if end < 0 else end + 2, "cmt"))
                if end < 0:
                    break
                state, i = "", end + 2
                continue
            if state == "template":
                m = REST["`"].match(line, i)
                found.append((i, m.end() if m else n, "tpl"))
                if not m:
                    break
                state, i, last = "", m.end(), "`"
                continue
            m = begins.search(line, i)
            if not m:
                break
            plain = line[i : m.start()].rstrip()
            i, last = m.start(), plain[-1] if plain else last
            c = line[i]
            if kind == "c-like" and line.startswith("//", i) or kind == "hash" and c == "#":
                found.append((i, n, "cmt"))
                break
            if kind == "c-like" and line.startswith("/*", i):
                end = line.find("*/", i + 2)
                found.append((i, n if end < 0 else end + 2, "cmt"))
                if end < 0:
                    state = "block"
                    break
                i = end + 2
                continue
            if c in "'\"`":
                end = _quoted(line, i)
                found.append((i, n if end is None else end, "tpl" if c == "`" else "str"))
                if end is None:
                    state = "template" if c == "`" else ""
                    break
                i, last = end, c
                continue
            if c == "/" and kind == "c-like" and (not last or last in BEFORE_REGEX):
                end = _regex_end(line, i)
                if end is not None:
                    found.append((i, end, "re"))
                    i, last = end, "/"
                    continue
            last = c
            i += 1
    return out


#: Which spans block a match: all of them, comments only, or everything outside comments.
MODES = ("code", "strings", "comments")


def blocked(found: list[Span], mode: str, length: int) -> list[tuple[int, int]]:
    """Merged blocked ranges of a line in a mode."""
    if mode == "comments":
        free = [(a, b) for a, b, k in found if k == "cmt"]
        out, at = [], 0
        for a, b in free:
            if a > at:
                out.append((at, a))
            at = max(at, b)
        return out + ([(at, length)] if at < length else [])
    ranges = [(a, b) for a, b, k in found if mode == "code" or k == "cmt"]
    merged: list[tuple[int, int]] = []
    for a, b in ranges:
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def is_blocked(ranges: list[tuple[int, int]], start: int, end: int) -> bool:
    """Only a match that lies wholly in a blocked range is blocked; an empty one never is."""
    if end <= start:
        return False
    k = bisect_right(ranges, (start, float("inf"))) - 1
    return k >= 0 and ranges[k][0] <= start and end <= ranges[k][1]


def without_comments(content: str, ext: str) -> str:
    """The text with comments blanked; offsets stay."""
    lines = content.split("\n")
    out = []
    for line, found in zip(lines, spans(lines, language(ext)), strict=True):
        for a, b, k in found:
            if k == "cmt":
                line = line[:a] + " " * (b - a) + line[b:]
        out.append(line)
    return "\n".join(out)
