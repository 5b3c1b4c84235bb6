"""Watching files: a stream of file states is scanned batch by batch, and each batch's findings are compared, per file, with what
was known of these files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import findings
from ..schema import FINDINGS
from ..sources import files as sources
from ..sources import state
from ..plans.scan import ScanOptions, conformed, raw_findings

#: What is watched.
WATCHED = (
    ".js .jsx .ts .tsx .mjs .cjs .py .rb .php .java .kt .go .rs .c .cc .cpp .h .hpp .cs .swift .scala .vue .svelte .html .ejs .erb "
    ".json .yml .yaml .toml .xml .env .tf .sh .sql .properties"
).split()
EVENTS = "path string, event string, content string, at timestamp"


def watched(path) -> object:
    base = F.lower(F.regexp_extract(path, "([^/]*)$", 1))
    return F.regexp_extract(base, r"(\.[^.]*)$", 1).isin(WATCHED) | base.isin("dockerfile", "makefile") | base.rlike(r"^\..*rc$")


def of_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Changes of a folder: each file state that appears. Deletions are not seen by a file source; send them as events."""
    raw = spark.readStream.format("binaryFile").option("recursiveFileLookup", True).schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    return raw.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.lit("change").alias("event"), sources.text_of(F.col("content")).alias("content"), F.col("modificationTime").alias("at")).where(watched(F.col("path")) & F.col("content").isNotNull())


def latest(events: DataFrame) -> DataFrame:
    """The last event of each path in a batch."""
    return events.groupBy("path").agg(F.max_by(F.struct("event", "content"), "at").alias("e")).select("path", "e.event", "e.content")


def process(events: DataFrame, folder: str, options: ScanOptions | None = None) -> DataFrame:
    """Scan a batch and return (file, line, rule_id, state) against the table of known findings, which is then replaced. A
    deleted file resolves its findings."""
    spark = events.sparkSession
    last = state.checkpoint(latest(events))
    known = state.read(spark, f"{folder}/watched", FINDINGS)
    files = sources.of_table(last.where("event <> 'unlink'"), F.col("path"), "content")
    found = state.checkpoint(conformed(raw_findings(files, options)))
    touched = last.select(F.col("path").alias("file"))
    out = state.checkpoint(findings.delta(known.join(touched, "file", "left_semi"), found, ["file", "line", "rule_id"]))
    state.replace(known.join(touched, "file", "left_anti").unionByName(found), f"{folder}/watched")
    return out


def watch(events: DataFrame, folder: str, show: Callable[[DataFrame, int], None], options: ScanOptions | None = None, every: str | None = "300 milliseconds", once: bool = False) -> StreamingQuery:
    """Run process() on every micro-batch; the trigger's pause gathers events that come close together."""
    writer = events.writeStream.foreachBatch(lambda df, n: show(process(df, folder, options), n)).option("checkpointLocation", f"{folder}/stream")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every or "2 seconds")).start()


def sessions(events: DataFrame, key: str, at: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Bursts: events of a key no further apart than the gap. On streams the watermark bounds the state."""
    e = events.withWatermark(at, late) if events.isStreaming else events
    return e.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("first_at"), (F.col("w.end") - F.expr(f"interval {gap}")).alias("last_at"), "n")


def tumbling(events: DataFrame, at: str, width: str, *keys: str, late: str = "1 hour") -> DataFrame:
    e = events.withWatermark(at, late) if events.isStreaming else events
    return e.groupBy(F.window(at, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def sliding(events: DataFrame, at: str, width: str, step: str, *keys: str, late: str = "1 hour") -> DataFrame:
    e = events.withWatermark(at, late) if events.isStreaming else events
    return e.groupBy(F.window(at, width, step).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")
