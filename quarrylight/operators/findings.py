"""Relational operators on findings: dedup, enrichment, weighting, thresholds, order, summaries, band anti-join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cvss
from ..functions.scalar import confidence_rank, fixed_rows, look_up, severity_rank
from ..schema import CONFIDENCES, CVSS, FP_RISKS, SEVERITIES

#: Test, sample and benchmark code by its path below the root.
NON_PRODUCTION = r"(?i)(^|/)(tests?|specs?|__tests__|fixtures?|examples?|samples?|mocks?|testdata|e2e|cypress|benchmarks?)/|\.(test|spec|e2e)\.[cm]?[jt]sx?$"
BAND = 25

#: Taint sink category -> (severity, weakness, title).
SINK_CLASSES = {
    "sql": ("critical", "CWE-89", "SQL injection"),
    "command": ("critical", "CWE-78", "Command injection"),
    "code-exec": ("critical", "CWE-94", "Code execution"),
    "file-op": ("high", "CWE-22", "Path traversal"),
    "xss": ("high", "CWE-79", "Cross-site scripting"),
    "ssrf": ("high", "CWE-918", "Request forgery"),
    "redirect": ("medium", "CWE-601", "Open redirect"),
}
#: Rule -> sink categories it stands for, in every spelling.
RULE_SINKS = {
    "sql-injection": ["sql"],
    "command-injection": ["command", "command-exec", "code-exec"],
    "path-traversal": ["file-op", "file-write", "file-read"],
    "arbitrary-file-write": ["file-op", "file-write"],
    "xss": ["xss"],
    "ssrf": ["ssrf"],
    "open-redirect": ["redirect"],
    "insecure-deserialization": ["deserialization"],
    "nosql-injection": ["nosql"],
    "ssti": ["code-exec", "template"],
    "xxe": ["xxe"],
    "prototype-pollution": ["prototype"],
}

def first_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_first")


def dedupe_positions(findings: DataFrame) -> DataFrame:
    """One finding per rule and position: the most confident, the earliest on ties."""
    return first_per(findings, ["file", "rule_id", "line", "col"], confidence_rank(F.col("confidence")).desc(), F.col("seq"))


def dedupe_engines(structural: DataFrame, pattern: DataFrame) -> DataFrame:
    """Structural findings win over pattern findings at the same file, line and rule."""
    keys = structural.select("file", "line", "rule_id").distinct()
    return structural.unionByName(pattern.join(keys, ["file", "line", "rule_id"], "left_anti"), allowMissingColumns=True)


def band_anti(left: DataFrame, right: DataFrame, keys: list[str], at: str, band: int = BAND) -> DataFrame:
    """Rows of left without a row of right at equal keys within `band` of `at`. Right rows go to their block and both
    neighbours, so that the join is on equality."""
    width = band + 1
    blocks = right.select(*keys, F.col(at).alias("_at"), F.explode(F.array(*[F.floor(F.col(at) / width) + d for d in (-1, 0, 1)])).alias("_block")).distinct()
    tagged = left.withColumn("_block", F.floor(F.col(at) / width))
    same = reduce(lambda a, b: a & b, [tagged[k] == blocks[k] for k in [*keys, "_block"]])
    return tagged.join(blocks, same & (F.abs(tagged[at] - blocks["_at"]) <= band), "left_anti").drop("_block")


def not_declared_nearby(graph: DataFrame, declared: DataFrame, band: int = BAND) -> DataFrame:
    """Graph findings that no rule of the same meaning reports within the band; cpg-<category> and interproc-taint findings are
    mapped to the rules that stand for them."""
    pairs = [(r, c) for r, cs in RULE_SINKS.items() for c in cs]
    names = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("category")) for r, c in pairs]))
    said = declared.select("file", "line", "rule_id", names.alias("m")).where(F.col("rule_id") == F.col("m.rule")).select("file", "line", F.col("m.category").alias("category"))
    g = graph.withColumn("category", F.regexp_replace("rule_id", "^cpg-", ""))
    return band_anti(g, said, ["file", "category"], "line", band).drop("category")


def enrich(findings: DataFrame) -> DataFrame:
    """Category from the weakness and score from the rule, where they are not there yet."""
    scores = fixed_rows(findings.sparkSession, [(r, cvss.score(v)) for r, v in cvss.DEFAULT_VECTORS.items()], f"rule_id string, _cvss {CVSS}")
    # one row per rule with a default
    out = findings.join(F.broadcast(scores), "rule_id", "left")
    return out.withColumns({"owasp": F.coalesce("owasp", cvss.owasp(F.col("cwe"))), "cvss": F.coalesce("cvss", "_cvss")}).drop("_cvss")


def classify_sink(sink: Column) -> Column:
    """struct(severity, cwe, title) of a sink text that begins with its category and a colon."""
    category = F.regexp_extract(sink, "^([a-z-]+):", 1)
    of = [look_up(category, {k: v[i] for k, v in SINK_CLASSES.items()}, d) for i, d in enumerate(("high", "CWE-20", "Tainted data reaches a sink"))]
    return F.struct(of[0].alias("severity"), of[1].alias("cwe"), of[2].alias("title"))


def weight_non_production(findings: DataFrame, file: str = "file") -> DataFrame:
    """Findings in tests and samples go one severity down and say so."""
    hit = F.col(file).rlike(NON_PRODUCTION)
    down = look_up(F.col("severity"), {s: SEVERITIES[max(0, i - 1)] for i, s in enumerate(SEVERITIES)})
    return findings.withColumns(
        {
            "severity": F.when(hit, down).otherwise(F.col("severity")),
            "message": F.when(hit, F.concat("message", F.lit(" (test or sample code)"))).otherwise(F.col("message")),
            "fp_risk": F.when(hit & (F.col("fp_risk") == "low"), "medium").otherwise(F.col("fp_risk")),
        }
    )


def check_threshold(value: str | None, order: tuple[str, ...], what: str) -> int:
    if value is None:
        return 0
    if value not in order:
        raise ValueError(f"unknown {what} {value!r}; one of {', '.join(order)}")
    return order.index(value)


def at_least(findings: DataFrame, severity: str | None = None, confidence: str | None = None) -> DataFrame:
    """Threshold filter on findings, after weighting. An unknown threshold raises before any work."""
    s, c = check_threshold(severity, SEVERITIES, "severity"), check_threshold(confidence, CONFIDENCES, "confidence")
    return findings.where((severity_rank(F.col("severity")) >= s) & (confidence_rank(F.col("confidence")) >= c))


def of_rules(findings: DataFrame, rules: list[str] | None) -> DataFrame:
    """Findings that one of the rules asks for, by id or by what a synthetic id stands for."""
    if not rules:
        return findings
    sinks = sorted({c for r in rules for c in RULE_SINKS.get(r, [])})
    id_ = F.col("rule_id")
    keep = id_.isin(rules)
    if sinks:
        keep = keep | id_.isin([f"cpg-{c}" for c in sinks])
        if "taint" in findings.columns:
            keep = keep | ((id_ == "interproc-taint") & F.exists("taint.sinks", lambda s: F.regexp_extract(s, "^([a-z-]+):", 1).isin(sinks)))
    if "hardcoded-secrets" in rules:
        keep = keep | F.startswith(id_, F.lit("entropy-"))
    if "dependency-vuln" in rules:
        keep = keep | (id_ == "dep-cve")
    return findings.where(F.coalesce(keep, F.lit(False)))


def report_order(findings: DataFrame) -> DataFrame:
    return findings.orderBy(severity_rank(F.col("severity")).desc(), "file", "line", "seq")


def summary(findings: DataFrame) -> DataFrame:
    """(dimension, value, n): counts by severity, confidence, category, weakness and risk, and the total, in one pass; the
    values of fixed enumerations are there with 0."""
    dims = ["severity", "confidence", "owasp", "cwe", "fp_risk"]
    spread = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims], F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("value"))))
    counted = findings.select(spread.alias("x")).where("x.value is not null").groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))
    fixed = [("severity", v) for v in SEVERITIES] + [("confidence", v) for v in CONFIDENCES] + [("fp_risk", v) for v in FP_RISKS] + [("total", "all")]
    domain = findings.sparkSession.createDataFrame(fixed, "dimension string, value string").withColumn("n", F.lit(0).cast("long"))
    return counted.unionByName(domain).groupBy("dimension", "value").agg(F.sum("n").alias("n"))


def share_of_total(findings: DataFrame, key: str) -> DataFrame:
    n = findings.groupBy(key).agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), 4))  # one row per enumeration value


def delta(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both batches marked new, resolved or unchanged."""
    b, a = before.select(*keys).distinct(), after.select(*keys).distinct()
    new = a.join(b, keys, "left_anti").withColumn("state", F.lit("new"))
    gone = b.join(a, keys, "left_anti").withColumn("state", F.lit("resolved"))
    same = a.join(b, keys, "left_semi").withColumn("state", F.lit("unchanged"))
    return new.unionByName(gone).unionByName(same)


def report_key() -> Column:
    """What report_order() orders by, as one value."""
    return F.struct((-severity_rank(F.col("severity"))).alias("severity"), "file", "line", "seq", "rule_id")


def occurrences(findings: DataFrame) -> DataFrame:
    """Findings with the print of their snippet and the running number of equal ones within rule and file."""
    w = W.partitionBy("rule_id", "file", "print").orderBy("line", "seq")
    return findings.withColumn("print", F.substring(F.sha2(F.trim("snippet"), 256), 1, 8)).withColumn("occurrence", F.row_number().over(w) - 1)


def rule_index(findings: DataFrame) -> DataFrame:
    """Findings with the 0-based place of their rule in order of first appearance in the report, and occurrences()."""
    first = findings.groupBy("rule_id").agg(F.min(report_key()).alias("_at"))
    index = first.withColumn("rule_index", F.row_number().over(W.orderBy("_at")) - 1).drop("_at")  # one row per rule of the catalog
    return occurrences(findings).join(F.broadcast(index), "rule_id")
