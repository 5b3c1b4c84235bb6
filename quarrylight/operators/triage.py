"""Verdicts on findings, the review queue, packets with context, hints and fixes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import code_hash, finding_key, severity_rank
from ..schema import CONFIDENCES, SEVERITIES
from .findings import NON_PRODUCTION, first_per

#: Marks of a false and of a true report, and what they say.
FALSE_MARKS = [
    (r"(?i)\b(?:test|spec|mock|fixture|example|sample)s?\b", "looks like test code"),
    (r"(?i)process\.env|os\.environ|getenv", "comes from the environment"),
    (r"(?i)sanitiz|escape|encode|validate", "a check or an escape is near"),
    (r"(?i)placeholder|changeme|your[_-]|xxxx", "a placeholder"),
    (r"\?\s*[,)]|\$\d|:\w+\s*[,)]", "placeholders in a query"),
]
TRUE_MARKS = [
    (r"req\.(?:body|query|params)|request\.(?:args|form|GET|POST)|\$_(?:GET|POST|REQUEST)", "request input"),
    (r"\$\{[^}]+\}|[\"']\s*\+\s*\w", "values are put into a text"),
    (r"(?i)\beval\s*\(|\bexec\s*\(|innerHTML", "a dangerous function"),
    (r"(?i)(?:password|secret|token)\s*[:=]\s*[\"'][^\"']{8,}", "a literal secret"),
]
FIXES = {
    "sql-injection": "Use a prepared statement and pass the values apart.",
    "command-injection": "Call the program with a list of arguments, without a shell.",
    "xss": "Use textContent, or escape the value.",
    "hardcoded-secrets": "Read the secret from the environment.",
    "insecure-crypto": "Use SHA-256 or AES-GCM.",
    "path-traversal": "Resolve the path and check that it stays in the folder.",
    "ssrf": "Allow a list of hosts.",
    "insecure-deserialization": "Parse plain data.",
    "open-redirect": "Redirect to known paths.",
}


def keyed(findings: DataFrame) -> DataFrame:
    return findings.withColumns({"finding_key": finding_key(F.col("rule_id"), F.col("file"), F.col("line")), "code_hash": code_hash(F.col("snippet"))})


def upsert(verdicts: DataFrame, new: DataFrame) -> DataFrame:
    """The last verdict on each finding."""
    return first_per(verdicts.unionByName(new, allowMissingColumns=True), ["finding_key"], F.col("seq").desc())


def judged(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Findings with triage_state: new, stale, false, real or adjusted."""
    f = findings if "finding_key" in findings.columns else keyed(findings)
    v = verdicts.select("finding_key", F.col("code_hash").alias("v_hash"), "is_real", "adjusted_severity", F.col("fix").alias("v_fix"))
    j = f.join(v, "finding_key", "left")
    state = (
        F.when(F.col("v_hash").isNull(), "new")
        .when(F.col("v_hash") != F.col("code_hash"), "stale")
        .when(~F.col("is_real"), "false")
        .when(F.col("adjusted_severity").isNotNull() & (F.col("adjusted_severity") != F.col("severity")), "adjusted")
        .otherwise("real")
    )
    return j.withColumn("triage_state", state)


def apply(findings: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings left, counters): false ones go, severities and fixes of real ones follow the verdict, stale verdicts count for
    nothing. Nothing goes unsaid: the counters say how many of each."""
    j = judged(findings, verdicts)
    counters = j.groupBy("triage_state").agg(F.count("*").alias("n"))
    fix = F.when(F.col("triage_state").isin("real", "adjusted") & F.col("v_fix").isNotNull(), F.col("v_fix"))
    kept = j.where("triage_state <> 'false'").withColumn("severity", F.when(F.col("triage_state") == "adjusted", F.col("adjusted_severity")).otherwise(F.col("severity")))
    if "fix_example" in kept.columns:
        kept = kept.withColumn("fix_example", F.coalesce(fix, F.col("fix_example")))
    return kept.drop("v_hash", "is_real", "adjusted_severity", "v_fix"), counters


def stats(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(F.count("*").alias("total"), F.count_if("is_real").alias("real"), F.count_if(~F.col("is_real")).alias("false_positives"), F.count_if(F.col("fix").isNotNull()).alias("with_fix"))


def _marks(text: Column, marks: list[tuple[str, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(rx), said) for rx, said in marks]))


def hinted(findings: DataFrame) -> DataFrame:
    """Columns false_marks, true_marks and priority (high, medium, low)."""
    text = F.coalesce("snippet", F.lit(""))
    f = findings.withColumns({"false_marks": _marks(text, FALSE_MARKS), "true_marks": _marks(text, TRUE_MARKS)})
    no, yes = F.size("false_marks") + F.col("file").rlike(NON_PRODUCTION).cast("int"), F.size("true_marks")
    if "taint" in findings.columns:
        yes = yes + F.col("taint").isNotNull().cast("int")
    return f.withColumn("priority", F.when(yes > no, "high").when(no > yes, "low").otherwise("medium"))


def review_queue(findings: DataFrame, verdicts: DataFrame, severity: str | None = None, limit: int = 25) -> DataFrame:
    """Findings without a valid verdict, most pressing first."""
    j = judged(findings, verdicts).where("triage_state in ('new', 'stale')")
    if severity:
        j = j.where(F.col("severity") == severity)
    order = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
    return hinted(j).orderBy(order, severity_rank(F.col("severity")).desc(), "file", "line", "finding_key").limit(limit)


def context(findings: DataFrame, lines: DataFrame, radius: int = 5) -> DataFrame:
    """findings(file, line) with the numbered lines around, the line itself marked. Each finding asks for its lines by number, so
    the join is on equality."""
    keys = findings.select("file", "line").distinct()
    asked = keys.select("file", "line", F.explode(F.sequence(F.greatest(F.lit(1), F.col("line") - radius), F.col("line") + radius)).alias("no"))
    got = asked.join(lines.select("file", F.col("line").alias("no"), "text"), ["file", "no"])
    said = F.concat(F.when(F.col("no") == F.col("line"), "> ").otherwise("  "), F.col("no").cast("string"), F.lit(": "), F.col("text"))
    rows = F.array_sort(F.collect_list(F.struct("no", said.alias("said"))))
    return got.groupBy("file", "line").agg(F.array_join(F.transform(rows, lambda x: x["said"]), "\n").alias("context"))


def packets(findings: DataFrame, lines: DataFrame, radius: int = 5) -> DataFrame:
    """What a reviewer gets: the finding, its marks, its priority and its surroundings."""
    return hinted(keyed(findings)).join(context(findings, lines, radius), ["file", "line"], "left")


def suggested_fix(rule_id: Column, own: Column, recommendation: Column) -> Column:
    from ..functions.scalar import look_up

    return F.coalesce(own, look_up(rule_id, FIXES), recommendation)


def validated(verdicts: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """Verdicts with `reject`: why one is not taken, or null."""
    tests = [
        (F.col("finding_key").isNull() | (F.col("finding_key") == ""), "no finding"),
        (F.col("is_real").isNull(), "no decision"),
        (F.col("analysis").isNull() | (F.length(F.trim("analysis")) < 10), "no reasons"),
        (F.col("review_confidence").isNotNull() & ~F.col("review_confidence").isin(*CONFIDENCES), "unknown confidence"),
        (F.col("adjusted_severity").isNotNull() & ~F.col("adjusted_severity").isin(*SEVERITIES), "unknown severity"),
    ]
    out = verdicts
    if findings is not None:
        known = keyed(findings).select("finding_key", F.lit(True).alias("_known")).distinct()
        out = out.join(known, "finding_key", "left")
        tests.append((F.col("_known").isNull(), "finding not known"))
    reason = reduce(lambda acc, t: F.when(t[0], t[1]).otherwise(acc), reversed(tests), F.lit(None).cast("string"))
    return out.withColumn("reject", reason).drop("_known")
