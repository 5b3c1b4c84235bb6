"""Dependency manifests and advisories."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cvss import severity_of
from ..functions.needs import batched, mapped, pieces
from ..functions.scalar import clean_version, fixed_rows
from ..schema import ADVISORIES, DEPS
from .findings import first_per

Dep = tuple[str, str, str, int, bool]  # ecosystem, name, version range, line, only for development


def _line_of(text: str, name: str) -> int:
    at = text.find(f'"{name}"')
    return text.count("\n", 0, at) + 1 if at >= 0 else 1


def _json(text: str) -> dict:
    try:
        v = json.loads(text)
    except ValueError:
        return {}
    return v if isinstance(v, dict) else {}


def _table(v) -> dict:
    return v if isinstance(v, dict) else {}


def package_json(text: str) -> Iterator[Dep]:
    for part, dev in (("dependencies", False), ("devDependencies", True), ("peerDependencies", False), ("optionalDependencies", False)):
        for n, v in _table(_json(text).get(part)).items():
            yield "npm", n, str(v), _line_of(text, n), dev


def package_lock(text: str) -> Iterator[Dep]:
    d = _json(text)
    for n, v in (_table(d.get("packages")) or _table(d.get("dependencies"))).items():
        name = n.rsplit("node_modules/", 1)[-1]
        if name and _table(v).get("version"):
            yield "npm", name, str(v["version"]), _line_of(text, n), bool(v.get("dev"))


def composer_json(text: str) -> Iterator[Dep]:
    for part, dev in (("require", False), ("require-dev", True)):
        for n, v in _table(_json(text).get(part)).items():
            if "/" in n:
                yield "Packagist", n, str(v), _line_of(text, n), dev


def pipfile_lock(text: str) -> Iterator[Dep]:
    for part, dev in (("default", False), ("develop", True)):
        for n, v in _table(_json(text).get(part)).items():
            yield "PyPI", n, str(_table(v).get("version", "*")), _line_of(text, n), dev


def by_line(regex: str, ecosystem: str, skip: str = r"^\s*(?:#|//|--|-[ie]\b)"):
    rx, no = re.compile(regex), re.compile(skip)

    def parse(text: str) -> Iterator[Dep]:
        for i, line in enumerate(text.split("\n"), 1):
            if not no.search(line) and (m := rx.search(line)):
                yield ecosystem, m["n"], (m.groupdict().get("v") or "*").strip(), i, False

    return parse


def go_mod(text: str) -> Iterator[Dep]:
    inside = False
    for i, line in enumerate(text.split("\n"), 1):
        s = line.split("//")[0].strip()
        if s.startswith("require ("):
            inside = True
        elif inside and s == ")":
            inside = False
        elif m := re.match(r"(?:require\s+)?(\S+)\s+v(\S+)$", s) if inside or s.startswith("require ") else None:
            yield "Go", m[1], m[2], i, False


def sections(ecosystem: str, wanted: dict[str, bool]):
    """TOML tables of name = version or name = { version = ... }."""

    def parse(text: str) -> Iterator[Dep]:
        dev = None
        for i, line in enumerate(text.split("\n"), 1):
            s = line.strip()
            if s.startswith("["):
                dev = wanted.get(s.strip("[]").strip())
            elif dev is not None and (m := re.match(r"[\"']?([\w.-]+)[\"']?\s*=\s*(.+)$", s)):
                v = re.search(r"version\s*=\s*[\"']([^\"']+)", m[2]) or re.match(r"[\"']([^\"']+)", m[2])
                yield ecosystem, m[1], v[1] if v else "*", i, dev

    return parse


def lock_blocks(ecosystem: str):
    """Blocks that begin with [[package]] and hold name and version."""

    def parse(text: str) -> Iterator[Dep]:
        name, at = None, 0
        for i, line in enumerate(text.split("\n"), 1):
            s = line.strip()
            if s.startswith("["):
                name = None if s != "[[package]]" else ""
            elif name is not None and (m := re.match(r"(name|version)\s*=\s*[\"']([^\"']+)", s)):
                if m[1] == "name":
                    name, at = m[2], i
                elif name:
                    yield ecosystem, name, m[2], at, False

    return parse


def pom_xml(text: str) -> Iterator[Dep]:
    for m in re.finditer(r"<dependency>(.*?)</dependency>", text, re.S):
        g, a, v = (re.search(rf"<{t}>\s*([^<]+?)\s*</{t}>", m[1]) for t in ("groupId", "artifactId", "version"))
        if g and a:
            yield "Maven", f"{g[1]}:{a[1]}", v[1] if v else "*", text.count("\n", 0, m.start()) + 1, "<scope>test" in m[1]


def yarn_lock(text: str) -> Iterator[Dep]:
    for m in re.finditer(r"^\"?((?:@[^/\s\"]+/)?[^@\s\"]+)@[^\n]*:\n\s+version:?\s+\"?([^\"\s]+)", text, re.M):
        yield "npm", m[1], m[2], text.count("\n", 0, m.start()) + 1, False


def pnpm_lock(text: str) -> Iterator[Dep]:
    for m in re.finditer(r"^\s+['\"]?/?((?:@[^/\s]+/)?[^@/\s'\"]+)[@/](\d[^:('\"\s]*)[^\n]*:\s*$", text, re.M):
        yield "npm", m[1], m[2], text.count("\n", 0, m.start()) + 1, False


PARSERS = {
    "package.json": package_json,
    "package-lock.json": package_lock,
    "composer.json": composer_json,
    "Pipfile.lock": pipfile_lock,
    "requirements.txt": by_line(r"^\s*(?P<n>[A-Za-z0-9._-]+)(?:\[[^\]]*\])?\s*(?P<v>(?:[=<>!~]=?=?)\s*[^;#\s]+)?", "PyPI"),
    "go.mod": go_mod,
    "go.sum": by_line(r"^(?P<n>\S+)\s+v(?P<v>[^\s/]+)(?:/go\.mod)?\s", "Go"),
    "Cargo.toml": sections("crates.io", {"dependencies": False, "dev-dependencies": True, "build-dependencies": True}),
    "Gemfile": by_line(r"^\s*gem\s+[\"'](?P<n>[^\"']+)[\"'](?:\s*,\s*[\"'](?P<v>[^\"']+))?", "RubyGems"),
    "Gemfile.lock": by_line(r"^ {4}(?P<n>[A-Za-z0-9._-]+) \((?P<v>[^)]+)\)", "RubyGems"),
    "pom.xml": pom_xml,
    "Pipfile": sections("PyPI", {"packages": False, "dev-packages": True}),
    "poetry.lock": lock_blocks("PyPI"),
    "yarn.lock": yarn_lock,
    "pnpm-lock.yaml": pnpm_lock,
}

#: An offline excerpt of public advisories (ecosystem, package, id, score, first fixed version, summary).
OFFLINE = (
    ("npm", "lodash", "CVE-2021-23337", 7.2, "4.17.21", "Command injection through template"),
    ("npm", "minimist", "CVE-2021-44906", 9.8, "1.2.6", "Prototype pollution"),
    ("npm", "axios", "CVE-2021-3749", 7.5, "0.21.2", "Regular expression denial of service"),
    ("npm", "node-fetch", "CVE-2022-0235", 6.1, "2.6.7", "Exposure of sensitive information"),
    ("npm", "express", "CVE-2022-24999", 7.5, "4.17.3", "Denial of service through qs"),
    ("npm", "jsonwebtoken", "CVE-2022-23529", 7.6, "9.0.0", "Insecure token verification"),
    ("PyPI", "requests", "CVE-2023-32681", 6.1, "2.31.0", "Information disclosure in proxies"),
    ("PyPI", "django", "CVE-2022-28346", 9.8, "4.0.4", "SQL injection in aliases"),
    ("PyPI", "flask", "CVE-2023-30861", 7.5, "2.2.5", "Session cookie disclosure"),
    ("PyPI", "pyyaml", "CVE-2020-14343", 9.8, "5.4", "Code execution in deserialization"),
    ("Maven", "org.apache.logging.log4j:log4j-core", "CVE-2021-44228", 10.0, "2.15.0", "Remote code execution"),
    ("Maven", "org.springframework:spring-core", "CVE-2022-22965", 9.8, "5.3.18", "Remote code execution"),
    ("RubyGems", "rails", "CVE-2022-32224", 9.8, "7.0.3.1", "Deserialization of YAML"),
    ("Go", "golang.org/x/crypto", "CVE-2020-29652", 7.5, "0.0.0-20201216223049", "Denial of service"),
)
#: Fixed values, first hit counts: what a summary (lower case) speaks of and the weakness it stands for.
SUMMARY_CWE = (
    ("sql injection", "CWE-89"),
    ("xss|cross.site", "CWE-79"),
    ("rce|remote code|cod execution", "CWE-94"),
    ("ssrf|server.side request", "CWE-918"),
    ("path traversal", "CWE-22"),
    ("dos|denial of service", "CWE-400"),
    ("prototype pollution", "CWE-1321"),
    ("csrf|cross.site request", "CWE-352"),
    ("auth|bypass|privilege", "CWE-287"),
    ("deserializ", "CWE-502"),
    ("redirect", "CWE-601"),
)


def parse(name: str, text: str) -> list[Dep]:
    p = PARSERS.get(name)
    return list(p(text)) if p else []


def dependencies(files: DataFrame) -> DataFrame:
    """Dependencies of all manifests among the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (
            (f, e, n, re.sub(r"^[\^~<>=!v ]+|\*+$", "", v) or "*", v, i, dev) for piece in pieces(batches) for f, b, t in zip(*piece, strict=True) for e, n, v, i, dev in parse(b, t or "")
        )
        return batched(found, [pa.string()] * 5 + [pa.int32(), pa.bool_()], [x.split()[0] for x in DEPS.split(", ")])

    return mapped(files.where(F.col("basename").isin(list(PARSERS))).select("file", "basename", "content"), run, DEPS)


def package_json_native(files: DataFrame) -> DataFrame:
    """package.json by from_json and explode, without Python."""
    kinds = [("dependencies", False), ("devDependencies", True), ("peerDependencies", False), ("optionalDependencies", False)]
    schema = "struct<" + ",".join(f"{k}:map<string,string>" for k, _ in kinds) + ">"
    d = files.where("basename = 'package.json'").select("file", F.from_json("content", schema).alias("j"))
    parts = [d.select("file", F.explode(f"j.{k}").alias("name", "spec")).withColumn("dev", F.lit(dev)) for k, dev in kinds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("version", clean_version(F.col("spec")))


def offline_advisories(spark: SparkSession, more: Iterable[tuple] = ()) -> DataFrame:
    rows = [(e, p, i, [i], s, float(c), v) for e, p, i, c, v, s in [*OFFLINE, *more]]
    return fixed_rows(spark, rows, ADVISORIES)


def older(version, fixed):
    """Is a dotted version before another? Unknown versions count as older."""
    num = lambda v: F.transform(F.slice(F.split(F.regexp_extract(v, r"^([0-9]+(?:\.[0-9]+)*)", 1), r"\."), 1, 4), lambda x: F.coalesce(x.try_cast("int") if hasattr(x, "try_cast") else x.cast("int"), F.lit(0)))
    return ~version.rlike(r"^[0-9]") | (num(version) < num(fixed))


def vulnerable(deps: DataFrame, advisories: DataFrame, fuzzy: bool = True, by_version: bool = True) -> DataFrame:
    """Dependencies joined with advisories on ecosystem and name; what finds none may be matched by a part of its name. One row
    per advisory and manifest."""
    a = advisories.select(F.col("ecosystem").alias("a_eco"), "pkg", "id", "summary", "cvss", "fixed_version")
    exact = deps.join(a, (F.lower("name") == F.lower("pkg")) & (F.col("ecosystem") == F.col("a_eco")))
    out = exact.withColumn("match", F.lit("exact"))
    if fuzzy:
        rest = deps.join(a, (F.lower("name") == F.lower("pkg")) & (F.col("ecosystem") == F.col("a_eco")), "left_anti")
        part = (F.col("ecosystem") == F.col("a_eco")) & (F.length("name") >= 4) & F.contains(F.lower("pkg"), F.lower("name"))
        out = out.unionByName(rest.join(a, part).withColumn("match", F.lit("part")))
    if by_version:
        out = out.where(F.col("fixed_version").isNull() | older(F.col("version"), F.col("fixed_version")))
    return first_per(out, ["manifest_file", "id"], F.col("match"), F.col("line"), F.col("name"))


def findings(hits: DataFrame) -> DataFrame:
    cwe = F.lit("CWE-937")
    for word, c in reversed(SUMMARY_CWE):
        cwe = F.when(F.lower("summary").rlike(word), c).otherwise(cwe)
    return hits.select(
        F.lit("dep-cve").alias("rule_id"), F.concat_ws(" ", "id", "name").alias("title"), severity_of(F.col("cvss")).alias("severity"), F.lit("certain").alias("confidence"),
        F.concat(F.col("name"), F.lit(" "), F.col("version"), F.lit(": "), F.col("summary")).alias("message"), F.col("manifest_file").alias("file"), "line", F.lit(1).alias("col"),
        F.concat_ws(" ", "name", "spec").alias("snippet"), F.concat(F.lit("Update to "), F.coalesce("fixed_version", F.lit("a fixed version"))).alias("recommendation"),
        cwe.alias("cwe"), F.lit("A06").alias("owasp"), F.when(F.col("match") == "exact", "low").otherwise("high").alias("fp_risk"), F.lit("deps").alias("engine"), F.xxhash64("id", "name").alias("seq"),
    )
