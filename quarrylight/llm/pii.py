"""Personal data by anchor expansion.

One Aho-Corasick pass over a text in lower case finds anchors: at-signs, digit-dot-digit, digit pairs, plus-digit, scheme marks and
identifier cues. Each anchor is expanded to both sides by a small parser, which is linear in what it looks at, and the span is
validated. The spans are those of a leftmost scan of the whole text.

Kinds: email, ip, card, phone (base); url_user (credentials before a host in a URL), iban (two capitals before a digit
pair, mod 97), account and ssn (numbers after an identifier cue in any case). Added kinds never remove base spans.

Defined results: null text counts as empty and has no spans; repeated rows are scanned one by one; a null doc_id stays null; an
empty table gives no rows; texts of any length, and runs of any length in them, are scanned whole in time that grows with them;
other columns are ignored by scan() and come back unchanged, whatever their names, from mask().
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, small_batches

KINDS = ("email", "ip", "card", "phone", "url_user", "iban", "account", "ssn")
BASE = KINDS[:4]
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
DIGITS = "0123456789"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS = CAPITALS + CAPITALS.lower()
ALNUM = LETTERS + DIGITS
LOCAL, DOMAIN, SCHEME = ALNUM + "._%+-", "[A-Za-z0-9-]++", ALNUM + "+.-"
#: Characters of a URL that credentials may hold, beside those that part them.
_URL = "".join(re.escape(chr(c)) for c in range(33, 127) if chr(c) not in "\"'<>/@:")
#: What may follow an anchor. Quantifiers that could share characters are possessive, so that no text takes more than a few passes.
PARSE = {
    "email": re.compile(rf"@{DOMAIN}(?:\.{DOMAIN})++"),
    "card": re.compile(r"[0-9](?:[ -]?[0-9])++"),
    "phone": re.compile(r"\+[0-9][ ().0-9-]+[0-9]"),
    "url_user": re.compile(rf"://[{_URL}]++:[{_URL}:]++@[{_URL}]++"),
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"),
    "account": re.compile(r"[ \t]*+(?:number|no\.?|nr\.?|#)?[ \t]*+[:=#]?[ \t]*+([0-9](?:[ -]?[0-9]){5,17})(?![0-9A-Za-z])", re.I),
    "ssn": re.compile(r"[ \t]*+(?:number|no\.?|#)?[ \t]*+[:=#]?[ \t]*+([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])", re.I),
}
#: Words before an identifier (lower case).
CUES = {"account": "account", "acct": "account", "konto": "account", "cuenta": "account", "compte": "account", "ssn": "ssn", "social security": "ssn"}

#: Characters of a country's IBANs (ISO 13616). Others are taken as far as their groups go.
IBAN_CHARS = {
    code: n
    for n, codes in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "AE BG BH CR DE GE IE ME RS VA",
        23: "GB GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for code in codes.split()
}


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def iban(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if c in DIGITS)


def valid(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(n) <= 3 and int(n or "0") <= 255 for n in (p.lstrip("0") for p in s.split(".")))
    if kind == "card":
        return 16 <= len(d := _digits(s)) <= 19 and luhn(d)
    if kind == "phone":
        return 8 <= len(_digits(s)) <= 15
    if kind == "iban":
        return iban(s)
    return True


def automaton():
    """The anchors: pattern -> kind."""
    import ahocorasick

    a = ahocorasick.Automaton()
    anchors = {"@": "email", "://": "url_user"}
    for d in DIGITS:
        anchors[f"+{d}"] = "phone"
        for e in DIGITS:
            anchors[f"{d}.{e}"] = "ip"
            for gap in ("", " ", "-"):
                anchors[f"{d}{gap}{e}"] = "card"
    anchors.update(CUES)
    for k, v in anchors.items():
        a.add_word(k, (v, len(k)))
    a.make_automaton()
    return a


def start_of(text: str, end: int, chars: str, least: int) -> int:
    """Where the maximal run of chars that ends before `end` starts, `least` or later."""
    step, at = 64, end
    while at > least:
        piece = text[max(least, at - step) : at]
        kept = len(piece) - len(piece.rstrip(chars))
        at -= kept
        if kept < len(piece):
            break
        step *= 4
    return at


def end_of(text: str, start: int, chars: str) -> int:
    """Where the maximal run of chars from `start` ends."""
    step, at, n = 64, start, len(text)
    while at < n:
        piece = text[at : at + step]
        kept = len(piece) - len(piece.lstrip(chars))
        at += kept
        if kept < len(piece):
            break
        step *= 4
    return at


def addresses(text: str, lo: int, hi: int) -> list[tuple[int, int]]:
    """Every four numbers in a row, parted by single dots, of a run of digits and dots."""
    out, at, begin, parts = [], lo, lo, 0
    for part in text[lo:hi].split("."):
        if not part:
            parts = 0
        else:
            begin, parts = (at, 1) if parts == 0 else (begin, parts + 1)
            if parts == 4:
                out.append((begin, at + len(part)))
                parts = 0
        at += len(part) + 1
    return out


def iban_at(text: str, at: int) -> int | None:
    """Where the valid IBAN that starts at `at` ends: after as many characters as its country's have, or after all groups."""
    m = PARSE["iban"].match(text, at)
    if not m:
        return None
    places = [i for i in range(at, m.end()) if text[i] != " "]
    n = IBAN_CHARS.get(text[at : at + 2], len(places))
    ends = [places[n - 1] + 1] if n <= len(places) else []
    for end in (*(e for e in ends if text[e : e + 1] not in ALNUM or e == len(text)), m.end()):
        if valid("iban", text[at:end]):
            return end
    return None


def lowered(text: str) -> str:
    """ASCII letters in lower case; every character keeps its place."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def find(text: str, anchors) -> dict[str, list[tuple[int, int]]]:
    """Valid spans by kind, each kind's in order and without overlap."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)  # up to here the kind's runs are parsed
    for end, (kind, length) in anchors.iter(lowered(text)):
        if kind == "card" and length == 2 and end - 3 >= done["iban"] and text[end - 3] in CAPITALS and text[end - 2] in CAPITALS:
            stop = iban_at(text, end - 3)
            if stop:
                out["iban"].append((end - 3, stop))
                done["iban"] = stop
        if end < done[kind]:
            continue
        at = end + 1 - length
        if kind in ("email", "url_user"):
            m = PARSE[kind].match(text, at)
            lo = start_of(text, at, LOCAL if kind == "email" else SCHEME, done[kind]) if m else at
            while kind == "url_user" and lo < at and text[lo] not in LETTERS:
                lo += 1  # a scheme begins with a letter
            if lo < at:
                out[kind].append((lo, m.end()))
                done[kind] = m.end()
        elif kind == "ip":
            lo = start_of(text, end, DIGITS + ".", done[kind])
            done[kind] = end_of(text, end, DIGITS + ".")
            out[kind] += [(a, b) for a, b in addresses(text, lo, done[kind]) if valid(kind, text[a:b])]
        elif kind == "card":
            # the run's first digit pair comes first; what follows it is one match up to a longer gap
            m = PARSE[kind].match(text, at)
            done[kind] = m.end()
            if valid(kind, m[0]):
                out[kind].append(m.span())
        elif kind == "phone":
            m = PARSE[kind].match(text, at)
            if m:
                done[kind] = m.end()
                if valid(kind, m[0]):
                    out[kind].append(m.span())
        elif end + 1 == len(text) or not text[end + 1].isalpha():
            m = PARSE[kind].match(text, end + 1)
            if m and valid(kind, m[1]):
                out[kind].append(m.span(1))
                done[kind] = m.end()
    return out


def row(spans: dict[str, list[tuple[int, int]]]) -> tuple:
    said = {k: [f"{k}:{a}:{b}" for a, b in spans[k]] for k in KINDS}
    base = ",".join(x for k in BASE for x in said[k])
    return (*(len(spans[k]) for k in BASE), hashlib.sha256(base.encode()).hexdigest(), ",".join(x for k in KINDS for x in said[k]))


def scan(docs: DataFrame) -> DataFrame:
    """Counts, a digest of the base spans and all spans of every document."""

    def start():
        a = automaton()
        return lambda columns: ((doc_id, *row(find(text or "", a))) for doc_id, text in zip(*columns, strict=True))

    return map_rows(docs, ["doc_id", "text"], SCHEMA, start)


def masked(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """The text with every span, overlapping ones joined, replaced by the first kind's name in angle brackets."""
    out, at = [], 0
    merged: list[list] = []
    for a, b, kind in sorted((a, b, KINDS.index(k)) for k in KINDS for a, b in spans[k]):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
            merged[-1][2] = min(kind, merged[-1][2])
        else:
            merged.append([a, b, kind])
    for a, b, kind in merged:
        out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def mask(docs: DataFrame) -> DataFrame:
    """docs with personal data masked in text; n_chars follows where the column is there. A null text stays null."""
    small_batches(docs.sparkSession)
    state: list = []

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        if not state:
            state.append(automaton())
        return texts.map(lambda t: masked(t, find(t, state[0])) if isinstance(t, str) else None)

    columns = {"text": clean(F.col("text"))}
    out = docs.withColumns(columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
