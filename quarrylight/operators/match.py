"""The pattern operator: files times applicable patterns, masked by what the lexer found.

Each file crosses into Python once, for all patterns; patterns are compiled once per worker. A JVM test of the extension keeps
files out that no rule reads.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.needs import batched, clauses, mapped, pieces, possible
from . import catalog, lexer

MATCHES = (
    "rule_id string, title string, severity string, confidence string, message string, file string, line int, col int, end_line int, end_col int, "
    "snippet string, recommendation string, cwe string, owasp string, tactic string, technique string, refs array<string>, fp_risk string, engine string, seq bigint"
)
NAMES = [x.split()[0] for x in MATCHES.split(", ")]


def applies(rule: catalog.Rule, ext: str, basename: str) -> bool:
    exts = rule.exts.lower().split()
    return "*" in exts or ext in exts or basename.lower() in exts


class Compiled:
    """The rules of a scan, ready to use in a worker."""

    def __init__(self, rules: list[catalog.Rule]):
        def ready(p: catalog.Pattern) -> tuple:
            folded = "i" in p.flags
            flags = re.A | (re.I if folded else 0)
            return p, re.compile(p.regex, flags), folded, clauses(p.regex, flags), p.requires and re.compile(p.requires, re.I | re.A), p.unless and re.compile(p.unless, re.I | re.A)

        self.rules = [(r, [ready(p) for p in r.patterns]) for r in rules]
        self.authorised, self.dummy = re.compile(catalog.AUTHORISED, re.A), re.compile(catalog.DUMMY, re.A)
        self.by_ext: dict[tuple[str, str], list] = {}

    def of(self, ext: str, basename: str) -> list:
        key = (ext, basename.lower() if basename.lower() in ("dockerfile",) else "")
        if key not in self.by_ext:
            self.by_ext[key] = [x for x in self.rules if applies(x[0], ext, basename)]
        return self.by_ext[key]

    def scan(self, file: str, basename: str, ext: str, content: str) -> Iterator[tuple]:
        rules = self.of(ext, basename)
        if not rules:
            return
        lowered = content.lower()
        lines, low = content.split("\n"), lowered.split("\n")
        kind = lexer.language(ext)
        spans = lexer.spans(lines, kind)
        masks: dict[str, list] = {}
        seq = 0

        def mask(mode: str) -> list:
            if mode not in masks:
                masks[mode] = [lexer.blocked(s, mode, len(t)) for s, t in zip(spans, lines, strict=True)] if kind != "unknown" else [[]] * len(lines)
            return masks[mode]

        for rule, patterns in rules:
            # a pattern is tried only where the text holds what each of its matches holds
            patterns = [x for x in patterns if possible(x[3], lowered if x[2] else content)]
            if not patterns:
                continue
            if rule.scope == "content-first":
                if self.authorised.search(lexer.without_comments(content, ext)):
                    continue
            elif rule.scope == "absence":
                if re.search(r"x-frame-options|frame-ancestors|frameguard", content, re.I):
                    continue
            seen_messages: set[str] = set()
            seen_lines: set[int] = set()
            done = False
            for p, regex, folded, needed, requires, unless in patterns:
                if done or requires and not requires.search(content) or p.mode == "comments" and kind == "unknown":
                    continue
                ranges = mask(p.mode)
                for no, text in enumerate(lines):
                    if done:
                        break
                    if not possible(needed, low[no] if folded else text):
                        continue
                    for m in regex.finditer(text):
                        if m.end() == m.start() or lexer.is_blocked(ranges[no], m.start(), m.end()) or unless and unless.search(text):
                            continue
                        if rule.rule_id == "hardcoded-secrets" and self.dummy.search(m[0]):
                            continue
                        if p.mode == "comments":  # a control is reported once per message and per line
                            if p.message in seen_messages or no in seen_lines:
                                continue
                            seen_messages.add(p.message)
                            seen_lines.add(no)
                        yield (
                            rule.rule_id, rule.title, rule.severity, p.confidence or rule.confidence, p.message, file, no + 1, m.start() + 1, no + 1, m.end() + 1,
                            text.strip()[:150], rule.fix, rule.cwe, rule.owasp, rule.tactic, rule.technique, list(rule.refs), p.fp_risk, "pattern", seq,
                        )
                        seq += 1
                        if rule.scope != "line":
                            done = True
                            break


def match(files: DataFrame, rules: list[catalog.Rule] | None = None) -> DataFrame:
    """Matches of all rules in all files. seq orders the matches of a file."""
    rules = catalog.RULES if rules is None else rules
    exts = {e for r in rules for e in r.exts.lower().split()}
    chosen = files if "*" in exts and any(r.patterns for r in rules if "*" in r.exts.split()) else files.where(F.col("ext").isin(sorted(exts)) | F.lower("basename").isin(sorted(exts)))

    compiled = Compiled(list(rules))  # what patterns need is read from them here, once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (row for piece in pieces(batches) for file, base, ext, content in zip(*piece, strict=True) for row in compiled.scan(file, base or "", ext or "", content or ""))
        return batched(found, TYPES, NAMES)

    return mapped(chosen.select("file", "basename", "ext", "content"), run, MATCHES)


def _type(name: str) -> pa.DataType:
    return {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "array<string>": pa.list_(pa.string())}[name]


TYPES = [_type(x.split()[1]) for x in MATCHES.split(", ")]


def match_rows(lines: DataFrame, patterns: Sequence[Mapping[str, str]]) -> DataFrame:
    """lines with a row for each of the patterns (rule_id, regex and what else is said of it) that its text holds, and how often: n.
    Patterns are literals of one projection, so that the JVM compiles each once and nothing is joined. A pattern may name in `needs`
    a text, in lower case, that every match holds in some case: lines without it are not tried. For catalogs whose matches need
    neither masks nor positions."""
    text, lower = F.col("text"), F.lower("text")

    def hit(p: Mapping[str, str]):
        said = [F.lit(v).alias(k) for k, v in p.items() if k not in ("regex", "needs")]
        found = text.rlike(p["regex"])
        return F.when(F.contains(lower, F.lit(p["needs"])) & found if p.get("needs") else found, F.struct(*said, F.regexp_count(text, F.lit(p["regex"])).alias("n")))

    return lines.select("*", F.explode(F.array_compact(F.array(*map(hit, patterns)))).alias("hit")).select(*lines.columns, "hit.*")


def custom_rules(files: DataFrame, rules: list[dict]) -> DataFrame:
    """Rules of the JSON language (see sources.rules): whole-content patterns with file globs, context and exclusion tests."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        ready = []
        for r in rules:
            globs = [[re.compile(".*".join(map(re.escape, g.split("*"))), re.I) for g in r.get(k) or []] for k in ("includeFiles", "excludeFiles")]
            tests = [[re.compile(x, re.I | re.A) for x in r.get(k) or []] for k in ("contextPatterns", "excludeContextPatterns")]
            ready.append((r, [(p, re.compile(p["regex"], re.I | re.A), clauses(p["regex"], re.I | re.A)) for p in r["patterns"]], *globs, *tests))
        for piece in pieces(batches):
            for file, base, ext, content in zip(*piece, strict=True):
                content, seq = content or "", 0
                lowered = content.lower()
                if not any(possible(needed, lowered) for _, patterns, *_ in ready for _, _, needed in patterns):
                    continue
                lines = content.split("\n")
                starts = [0]
                for t in lines:
                    starts.append(starts[-1] + len(t) + 1)
                masks = [lexer.blocked(s, "code", len(t)) for s, t in zip(lexer.spans(lines, lexer.language(ext)), lines, strict=True)]
                from bisect import bisect_right

                for r, patterns, include, exclude, context, without in ready:
                    exts = [e.lower() for e in r.get("extensions") or ["*"]]
                    if not ("*" in exts or ext in exts or base.lower() in exts) or include and not any(g.search(file) for g in include) or any(g.search(file) for g in exclude):
                        continue
                    if not all(c.search(content) for c in context) or any(c.search(content) for c in without):
                        continue
                    if r.get("matchAll") and not all(rx.search(content) for _, rx, _ in patterns):
                        continue
                    for p, rx, needed in patterns:
                        for m in rx.finditer(content) if possible(needed, lowered) else ():
                            if m.end() == m.start():
                                continue
                            no = bisect_right(starts, m.start()) - 1
                            col, size = m.start() - starts[no], m.end() - m.start()
                            if lexer.is_blocked(masks[no], col, min(col + size, len(lines[no]))):
                                continue
                            yield (
                                r["id"], r.get("name") or r["id"], p.get("severity") or r.get("severity") or "medium", p.get("confidence") or r.get("confidence") or "high",
                                p.get("message") or r.get("description") or r["id"], file, no + 1, col + 1, no + 1, col + size + 1, lines[no].strip()[:100], p.get("recommendation") or "",
                                r.get("cwe") or "CWE-937", r.get("owasp") or "A03", None, None, list(r.get("references") or []), r.get("falsePositiveRisk") or "medium", "custom", seq,
                            )
                            seq += 1

    return mapped(files.select("file", "basename", "ext", "content"), lambda batches: batched(found(batches), TYPES, NAMES), MATCHES)


def masked_matches(files: DataFrame, regex: str) -> DataFrame:
    """(file, in_code, in_strings, in_comments): matches of one pattern by where they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rx, types = re.compile(regex, re.A), [pa.string(), pa.int64(), pa.int64(), pa.int64()]
        for piece in pieces(batches):
            out = []
            for file, ext, content in zip(*piece, strict=True):
                lines, n = content.split("\n"), {"code": 0, "str": 0, "cmt": 0}
                for text, found in zip(lines, lexer.spans(lines, lexer.language(ext)), strict=True):
                    code, strings = lexer.blocked(found, "code", len(text)), lexer.blocked(found, "strings", len(text))
                    for m in rx.finditer(text):
                        if m.end() > m.start():
                            n["cmt" if lexer.is_blocked(strings, *m.span()) else "str" if lexer.is_blocked(code, *m.span()) else "code"] += 1
                out.append((file, n["code"], n["str"], n["cmt"]))
            yield from batched(out, types, ["file", "in_code", "in_strings", "in_comments"])

    return mapped(files.select("file", "ext", "content"), run, "file string, in_code bigint, in_strings bigint, in_comments bigint")


def near_input(lines: DataFrame, around: int = 5, source_regex: str | None = None) -> DataFrame:
    """lines(file, line, text) with near_input: does another line of the file within `around` lines bring request input in?"""
    from pyspark.sql import Window as W

    hit = F.col("text").rlike("(?i)" + (source_regex or catalog.REQUEST)).cast("int")
    w = W.partitionBy("file").orderBy("line")
    before, after = F.max(hit).over(w.rowsBetween(-around, -1)), F.max(hit).over(w.rowsBetween(1, around))
    return lines.withColumn("near_input", F.coalesce(F.greatest(before, after), F.lit(0)) > 0)


def variable_map(lines: DataFrame) -> DataFrame:
    """(file, name, values): what is assigned to each variable, in line order."""
    rx = r"(?:\b(?:const|let|var)\s+)?\b([A-Za-z_$][A-Za-z0-9_$]*)\s*=\s*([^=;][^;]*);"
    found = lines.where(F.col("text").rlike(rx)).select("file", "line", F.regexp_extract("text", rx, 1).alias("name"), F.trim(F.regexp_extract("text", rx, 2)).alias("value"))
    return found.groupBy("file", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]).alias("values"))


def tainted_variables(assignments: DataFrame, source_regex: str, depth: int = 3) -> DataFrame:
    """assignments(file, name, value): variables that a source reaches by at most `depth` assignments, with the chain."""
    hit = assignments.where(F.col("value").rlike(source_regex)).select("file", "name", F.array("name").alias("chain"))
    out = frontier = hit
    for _ in range(depth):
        step = frontier.select("file", F.col("name").alias("via"), "chain").join(assignments, "file")
        uses = F.array_contains(F.regexp_extract_all("value", F.lit(r"[A-Za-z_$][A-Za-z0-9_$]*"), F.lit(0)), F.col("via"))
        frontier = step.where(uses & ~F.array_contains("chain", F.col("name"))).select("file", "name", F.concat("chain", F.array("name")).alias("chain"))
        out = out.unionByName(frontier)
    return out.groupBy("file", "name").agg(F.min_by("chain", F.struct(F.size("chain"), F.col("chain"))).alias("chain"))
