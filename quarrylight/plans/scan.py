"""The full scan: every engine over the files, then dedup, enrichment, weights, thresholds, triage and order, once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import callgraph, catalog, deps, findings, graph, match, secrets, structural, triage
from ..schema import CONFIDENCES, FINDINGS, SEVERITIES
from ..sources import state


@dataclass(frozen=True)
class ScanOptions:
    rules: list[str] | None = None
    severity: str | None = None
    confidence: str | None = None
    extensions: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    max_size: int = 10 * 1024 * 1024
    entropy: bool = True
    deps: bool = True
    taint: bool = True
    custom: tuple[dict, ...] = field(default=())

    def wants(self, *rules: str) -> bool:
        """Can one of the rules' findings be asked for? Phases that cannot are left out of the plan."""
        return not self.rules or any(r in self.rules for r in rules)


def conformed(df: DataFrame) -> DataFrame:
    """Any engine's rows in the schema of findings."""
    empty = df.sparkSession.createDataFrame([], FINDINGS)
    have = set(df.columns)
    if "mitre" not in have and {"tactic", "technique"} <= have:
        df = df.withColumn("mitre", F.when(F.col("tactic").isNotNull(), F.struct("tactic", "technique")))
        have.add("mitre")
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema.fields])


def raw_findings(files: DataFrame, options: ScanOptions | None = None, advisories: DataFrame | None = None) -> DataFrame:
    """Findings of all engines with their dedup rules, before weights and thresholds."""
    o = options or ScanOptions()
    known = catalog.by_id()
    chosen = [r for r in catalog.RULES if not o.rules or r.rule_id in o.rules]
    out = conformed(findings.dedupe_positions(match.match(files, chosen)))
    asked = [r for r in o.rules or [] if r in known]
    if not o.rules or any(p[0] in o.rules for p in structural.PATTERNS):
        out = findings.dedupe_engines(conformed(structural.structural(files, asked or None)), out)
    if o.custom:
        out = out.unionByName(conformed(match.custom_rules(files, list(o.custom))))
    others = o.taint and o.wants("interproc-taint", *findings.RULE_SINKS) or o.entropy and o.wants("hardcoded-secrets") or o.deps and o.wants("dependency-vuln")
    # the other engines are held against these, so they are computed once and written; a cache would outlive the scan and answer
    # for files that have changed since
    declared = out = state.checkpoint(out) if others else out
    if o.taint and o.wants("interproc-taint", *findings.RULE_SINKS):
        traced = conformed(callgraph.trace_findings(callgraph.line_traces(files)))
        paths = conformed(findings.first_per(graph.findings(graph.taint(files)), ["file", "rule_id", "line"], F.col("seq")))
        out = out.unionByName(traced).unionByName(findings.not_declared_nearby(paths, declared))
    if o.entropy and o.wants("hardcoded-secrets"):
        found = conformed(secrets.findings(files))
        same_line = declared.where("rule_id = 'hardcoded-secrets'").select("file", "line").distinct()
        out = out.unionByName(found.join(same_line, ["file", "line"], "left_anti"))
    if o.deps and o.wants("dependency-vuln"):
        a = advisories if advisories is not None else deps.offline_advisories(files.sparkSession)
        found = conformed(deps.findings(deps.vulnerable(deps.dependencies(files), a)))
        out = out.unionByName(found.join(declared.select("file", "line", "col", "rule_id").distinct(), ["file", "line", "col", "rule_id"], "left_anti"))
    return out


def scan(files: DataFrame, options: ScanOptions | None = None, verdicts: DataFrame | None = None, advisories: DataFrame | None = None) -> DataFrame:
    """Findings in report order. Thresholds are checked before any work."""
    o = options or ScanOptions()
    findings.check_threshold(o.severity, SEVERITIES, "severity")
    findings.check_threshold(o.confidence, CONFIDENCES, "confidence")
    if o.rules:
        custom = {r["id"] for r in o.custom}
        catalog.select([r for r in o.rules if r not in custom and r != "interproc-taint"])
    out = findings.enrich(findings.weight_non_production(raw_findings(files, o, advisories)))
    out = findings.at_least(findings.of_rules(out, o.rules), o.severity, o.confidence)
    if verdicts is not None:
        out, _ = triage.apply(out, verdicts)
    return findings.report_order(out)
