"""What became of findings between two states of a corpus."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import SEVERITIES

NEAR = 20
DIFF = "file string, rule_id string, line int, before_line int, classification string, severity string, before_severity string, seq bigint"


def matched(before: list[tuple], after: list[tuple]) -> Iterator[tuple]:
    """Rows of one rule in one file, (line, severity, seq) in order: each later one with the nearest free earlier one less than NEAR
    lines away, the first of equally near ones."""
    rank = {s: i for i, s in enumerate(SEVERITIES)}
    at, free = [b[0] for b in before], [True] * len(before)
    for line, severity, seq in after:
        near = range(bisect_right(at, line - NEAR), bisect_left(at, line + NEAR))
        best = min((i for i in near if free[i]), key=lambda i: abs(at[i] - line), default=None)
        if best is None:
            yield line, None, "introduced", severity, None, seq
            continue
        free[best] = False
        d = rank.get(severity, 0) - rank.get(before[best][1], 0)
        yield line, at[best], "worsened" if d > 0 else "improved" if d < 0 else "persisted", severity, before[best][1], seq
    seen = set()
    for i, (line, severity, seq) in enumerate(before):
        if free[i] and line not in seen:
            seen.add(line)
            yield None, line, "resolved", None, severity, seq


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Findings matched one to one within file and rule. Both sides are dealt by file and rule and sorted, and a task goes through
    its rows once, so that it holds one rule's findings in one file at a time."""
    cols = ["file", "rule_id", "line", "severity", "seq"]
    both = before.select(*cols, F.lit(False).alias("later")).unionByName(after.select(*cols, F.lit(True).alias("later")))
    both = both.repartition("file", "rule_id").sortWithinPartitions("file", "rule_id", "later", "line", "seq")
    names = [x.split()[0] for x in DIFF.split(", ")]
    types = [{"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[x.split()[1]] for x in DIFF.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides = None, ([], [])

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            out = []
            for file, rule, line, severity, seq, later in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, rule) != key:
                    out += [(*key, *x) for x in matched(*sides)] if key else []
                    key, sides = (file, rule), ([], [])
                sides[later].append((line, severity, seq))
            if out:
                yield table(out)
        if key:
            yield table([(*key, *x) for x in matched(*sides)])

    return both.mapInArrow(run, DIFF)


def summary(diff: DataFrame) -> DataFrame:
    """One row: how many of each class, the difference and its name."""
    kinds = ("introduced", "resolved", "persisted", "worsened", "improved")
    s = diff.agg(*[F.count_if(F.col("classification") == k).alias(k) for k in kinds])
    s = s.withColumn("delta", F.col("introduced") - F.col("resolved"))
    return s.withColumn("label", F.when(F.col("delta") > 0, "worse").when(F.col("delta") < 0, "better").otherwise("unchanged"))


def relative(found: DataFrame, root: str) -> DataFrame:
    from ..functions.scalar import relative_path

    return found.withColumn("file", relative_path(F.col("file"), root))


def report(diff: DataFrame, limit: int = 10) -> str:
    """Text of a diff: counts, what is new or worse, and up to `limit` resolved ones."""
    s = summary(diff).first().asDict()
    out = [", ".join(f"{s[k]} {k}" for k in ("introduced", "resolved", "persisted", "worsened", "improved")) + f"; {s['label']} ({s['delta']:+d})"]
    for kind in ("introduced", "worsened"):
        rows = diff.where(F.col("classification") == kind).orderBy("file", "line", "rule_id").toLocalIterator()
        out += [f"{kind}: {r['file']}:{r['line']} {r['rule_id']} ({r['severity']})" for r in rows]
    gone = diff.where("classification = 'resolved'").orderBy("file", "before_line", "rule_id").limit(limit).collect()
    return "\n".join(out + [f"resolved: {r['file']}:{r['before_line']} {r['rule_id']}" for r in gone])
