"""Change detection and scans of what has changed; the result is that of a full scan."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import catalog, findings, structural
from ..schema import FINDINGS, MANIFEST
from ..sources import state
from .scan import ScanOptions, conformed, raw_findings

KEEP_SNAPSHOTS = 50


def config_hash(o: ScanOptions) -> str:
    """Of what changes results; output and triage do not."""
    return _hash([o.extensions, o.exclude, o.max_size, o.entropy, o.deps, o.taint, sorted(o.rules or [])])


def rules_hash(o: ScanOptions) -> str:
    """Of every field of every rule and pattern, of the structural ones and of the user's."""
    return _hash([[asdict(r) for r in catalog.RULES], structural.PATTERNS, sorted(o.custom, key=lambda r: r["id"])])


def _hash(what: object) -> str:
    return hashlib.sha256(json.dumps(what, sort_keys=True, default=str).encode()).hexdigest()[:16]


def changes(current: DataFrame, manifest: DataFrame, config: str | None = None, rules: str | None = None) -> DataFrame:
    """(file, change): added, modified, unchanged or deleted. Under another configuration or other rules everything is added."""
    old = manifest.select("file", F.col("sha256").alias("old_hash"), *([F.col("config_hash"), F.col("rules_hash")] if config else []))
    j = current.select("file", F.col("sha256").alias("new_hash")).join(old, "file", "full")
    valid = (F.col("config_hash") == config) & (F.col("rules_hash") == rules) if config else F.lit(True)
    change = (
        F.when(F.col("new_hash").isNull(), "deleted")
        .when(F.col("old_hash").isNull() | ~valid, "added")
        .when(F.col("old_hash") != F.col("new_hash"), "modified")
        .otherwise("unchanged")
    )
    return j.select("file", change.alias("change"))


def scan_incremental(files: DataFrame, folder: str, options: ScanOptions | None = None) -> DataFrame:
    """Findings of all files; only files that are new, changed or missing from the cache are analysed. The cache is written
    anew with every run. A file whose findings are missing is analysed again unless it is known to have none."""
    o = options or ScanOptions()
    spark = files.sparkSession
    manifest = state.read(spark, f"{folder}/manifest", MANIFEST)
    cached = state.read(spark, f"{folder}/findings", FINDINGS)
    c, r = config_hash(o), rules_hash(o)
    todo = changes(files, manifest, c, r)
    same = todo.where("change = 'unchanged'").select("file")
    have = cached.select("file").distinct().withColumn("have", F.lit(True))
    counted = manifest.select("file", "finding_count")
    missing = same.join(counted, "file").join(have, "file", "left").where("have is null and finding_count > 0").select("file")
    fresh = files.join(todo.where("change in ('added', 'modified')").select("file").union(missing), "file", "left_semi")
    old = cached.join(same.join(missing, "file", "left_anti"), "file", "left_semi")
    out = state.checkpoint(conformed(raw_findings(fresh.select(files.columns), o)).unionByName(old))
    state.replace(out, f"{folder}/findings")
    per = out.groupBy("file", "severity").agg(F.count("*").alias("n")).groupBy("file").agg(F.sum("n").cast("int").alias("finding_count"), F.map_from_entries(F.collect_list(F.struct("severity", F.col("n").cast("int")))).alias("severity_counts"))
    entries = files.join(per, "file", "left").select(
        "file", "sha256", "size", F.current_timestamp().alias("last_scan"), F.coalesce("finding_count", F.lit(0)).alias("finding_count"),
        F.coalesce("severity_counts", F.create_map().cast("map<string,int>")).alias("severity_counts"), F.lit(c).alias("config_hash"), F.lit(r).alias("rules_hash"),
    )
    state.replace(entries, f"{folder}/manifest")
    done = findings.enrich(findings.weight_non_production(out))
    return findings.report_order(findings.at_least(findings.of_rules(done, o.rules), o.severity, o.confidence))


def cache_stats(spark: SparkSession, folder: str) -> DataFrame:
    m = state.read(spark, f"{folder}/manifest", MANIFEST)
    return m.agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sum("finding_count").alias("findings"), F.min("last_scan").alias("oldest"), F.max("last_scan").alias("newest"))


def clear_cache(folder: str, spark: SparkSession | None = None) -> None:
    """Forget all files, whatever store the folder is in."""
    for name in ("manifest", "findings"):
        state.clear(spark or SparkSession.active(), f"{folder}/{name}")


def snapshot(found: DataFrame, snapshot_id: str) -> DataFrame:
    """(snapshot_id, rule_id, n): what a snapshot keeps."""
    return found.groupBy("rule_id").agg(F.count("*").alias("n")).select(F.lit(snapshot_id).alias("snapshot_id"), "rule_id", "n")


def kept_snapshots(all_: DataFrame, keep: int = KEEP_SNAPSHOTS) -> DataFrame:
    """The last snapshots by id; there are few of them, so they are ranked in one place."""
    last = all_.select("snapshot_id").distinct().withColumn("k", F.row_number().over(W.orderBy(F.desc("snapshot_id")))).where(F.col("k") <= keep).select("snapshot_id")
    return all_.join(F.broadcast(last), "snapshot_id", "left_semi")


def count_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Counts by key of two snapshots and their difference; what is in one only counts 0 in the other."""
    b, a = before.groupBy(key).agg(F.count("*").alias("n_before")), after.groupBy(key).agg(F.count("*").alias("n_after"))
    j = b.join(a, key, "full").select(key, F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after"))
    return j.withColumn("delta", F.col("n_after") - F.col("n_before"))
