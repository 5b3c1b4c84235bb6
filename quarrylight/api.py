"""The functions that a user calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .functions.scalar import severity_rank
from .operators import catalog, deps, findings, triage
from .plans import diff as diffs
from .plans import incremental
from .plans.scan import ScanOptions, scan
from .sources import files as sources
from .sources import rules as user_rules
from .sources import state
from .schema import ADVISORIES, VERDICTS

INLINE = 40


def scan_paths(spark: SparkSession, paths: list[str], options: ScanOptions | None = None, verdicts: DataFrame | None = None, advisories: DataFrame | None = None) -> DataFrame:
    o = options or ScanOptions()
    return scan(sources.of_paths(spark, paths, extensions=o.extensions, exclude=o.exclude, max_size=o.max_size), o, verdicts, advisories)


def read_advisories(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """A table of advisories: ecosystem, pkg, id, aliases, summary, cvss, fixed_version."""
    return spark.read.schema(ADVISORIES).format(fmt).load(path)


def scan_rows(spark: SparkSession, rows: list[tuple[str, str]], options: ScanOptions | None = None) -> DataFrame:
    """Scan snippets: (file name, code)."""
    return scan(sources.of_rows(spark, rows), options)


def scan_git_diff(spark: SparkSession, folder: str, base: str = "HEAD", options: ScanOptions | None = None) -> DataFrame:
    """Scan only files that a repository's work differs in."""
    changed = sources.changed_files(spark, folder, base)
    return scan(sources.of_directory(spark, folder).join(changed, "file", "left_semi"), options)


def scan_dependencies(files: DataFrame, advisories: DataFrame | None = None) -> DataFrame:
    return deps.findings(deps.vulnerable(deps.dependencies(files), advisories if advisories is not None else deps.offline_advisories(files.sparkSession)))


def scan_secrets(files: DataFrame) -> DataFrame:
    return scan(files, ScanOptions(rules=["hardcoded-secrets"], deps=False, taint=False))


def scan_incremental(files: DataFrame, folder: str, options: ScanOptions | None = None) -> DataFrame:
    return incremental.scan_incremental(files, folder, options)


def diff(spark: SparkSession, folder: str, base: str, options: ScanOptions | None = None) -> DataFrame:
    """Findings of a revision against those of the working tree."""
    if not sources.is_repository(folder) or not sources.resolve_revision(folder, base):
        raise ValueError(f"{folder} has no revision {base}")
    o = options or ScanOptions()
    walk = {"extensions": o.extensions, "exclude": o.exclude, "max_size": o.max_size}
    before = scan(sources.of_revision(spark, folder, base, **walk), o)
    after = diffs.relative(scan(sources.of_directory(spark, folder, **walk), o), folder)
    return diffs.compare(before, after)


def list_rules(spark: SparkSession, severity: str | None = None) -> DataFrame:
    """Rules, the most severe first."""
    r = catalog.rules_df(spark).orderBy(severity_rank(F.col("severity")).desc(), "rule_id")
    return r.where(F.col("severity") == severity) if severity else r


rule_summary = catalog.rule_summary
create_rule = user_rules.create
init_example_rules = user_rules.write_examples
export_report = sinks.export
cache_stats = incremental.cache_stats
clear_cache = incremental.clear_cache


def apply_fix(path: str, old: str, new: str, line: int | None = None, spark: SparkSession | None = None) -> dict:
    """Patch a file and, where a session is given, scan it again: where the text stood and what is still found."""
    out: dict = {"file": path, "line": sinks.apply_fix(path, old, new, line)}
    if spark is not None:
        after = scan(sources.of_paths(spark, [path]), ScanOptions(deps=False))
        out |= {"remaining": after.count(), "findings": [r.asDict() for r in brief(after).limit(10).collect()]}
    return out


def brief(found: DataFrame) -> DataFrame:
    """What fits an answer: the most severe findings in a few columns."""
    return findings.report_order(found).limit(INLINE).select("severity", "confidence", "rule_id", "file", "line", "message", "cwe")


def read_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return state.read(spark, f"{folder}/verdicts", VERDICTS)


def submit_verdicts(new: DataFrame, folder: str, found: DataFrame | None = None) -> DataFrame:
    """Store the verdicts that are valid; returns those that are not, with the reason."""
    checked = state.checkpoint(triage.validated(new, found))
    old = read_verdicts(new.sparkSession, folder)
    state.replace(triage.upsert(old, checked.where("reject is null").drop("reject")), f"{folder}/verdicts")
    return checked.where("reject is not null")


def clear_verdicts(spark: SparkSession, folder: str) -> None:
    state.replace(spark.createDataFrame([], VERDICTS), f"{folder}/verdicts")


review_queue = triage.review_queue
finding_context = triage.context
review_packets = triage.packets
triage_stats = triage.stats


def suggest_fix(found: DataFrame) -> DataFrame:
    return found.withColumn("suggested_fix", triage.suggested_fix(F.col("rule_id"), F.col("fix_example"), F.col("recommendation")))


def register_views(spark: SparkSession, found: DataFrame, verdicts: DataFrame | None = None) -> None:
    """Rules, the last scan and verdicts as temporary views."""
    catalog.rules_df(spark).createOrReplaceTempView("rules")
    found.createOrReplaceTempView("last_scan")
    if verdicts is not None:
        verdicts.createOrReplaceTempView("verdicts")


