"""Schemas of the tables that operators exchange, and the ranks of their enumerations."""

from __future__ import annotations

FILES = "file string, basename string, ext string, content string, size bigint, sha256 string"
LINES = "file string, line int, text string"
RULES = (
    "rule_id string, name string, description string, severity string, confidence string, cwe string, owasp string, "
    "tactic string, technique string, refs array<string>, exts array<string>, custom boolean"
)
PATTERNS = (
    "rule_id string, pat_no int, regex string, mode string, requires_ctx string, neutralized_by string, message string, "
    "recommendation string, fix_example string, confidence string, fp_risk string"
)
CVSS = "struct<base:double,impact:double,exploitability:double,vector:string,rating:string>"
TAINT = "struct<source:string,sinks:array<string>,variable_chain:array<string>,sanitizers:array<string>,confidence:string>"
FINDINGS = (
    "rule_id string, title string, severity string, confidence string, message string, file string, line int, col int, end_line int, "
    "end_col int, snippet string, recommendation string, fix_example string, cwe string, owasp string, "
    f"cvss {CVSS}, mitre struct<tactic:string,technique:string>, taint {TAINT}, refs array<string>, fp_risk string, engine string, seq bigint"
)
CPG_NODES = "id bigint, type string, label string, file string, start_line int, end_line int, start_col int, end_col int, code string, props map<string,string>"
CPG_EDGES = "id bigint, type string, src bigint, dst bigint, label string, props map<string,string>"
VERDICTS = (
    "finding_key string, code_hash string, is_real boolean, review_confidence string, analysis string, adjusted_severity string, "
    "fix string, triaged_by string, triaged_at timestamp, seq bigint"
)
MANIFEST = "file string, sha256 string, size bigint, last_scan timestamp, finding_count int, severity_counts map<string,int>, config_hash string, rules_hash string"
DEPS = "manifest_file string, ecosystem string, name string, version string, spec string, line int, dev boolean"
ADVISORIES = "ecosystem string, pkg string, id string, aliases array<string>, summary string, cvss double, fixed_version string"

SEVERITIES = ("info", "low", "medium", "high", "critical")
CONFIDENCES = ("low", "medium", "high", "certain")
FP_RISKS = ("low", "medium", "high")

NODE_TYPES = (
    "FILE", "FUNCTION", "PARAMETER", "STATEMENT", "CALL_SITE", "ASSIGNMENT", "MEMBER_EXPRESSION", "VARIABLE_DECL", "LITERAL",
    "IDENTIFIER", "RETURN", "CONDITION", "LOOP", "IMPORT", "CLASS", "SOURCE", "SINK",
)
EDGE_TYPES = (
    "AST_CHILD", "HAS_PARAMETER", "DECLARES", "DATA_FLOW", "CONTROL_FLOW", "REFERENCES", "CALLS", "TAINT_SOURCE", "TAINT_SINK",
    "SANITIZES", "RETURNS", "IMPORTS", "ALIASES", "TAINT_FLOW",
)
