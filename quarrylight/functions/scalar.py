"""Scalar column functions: entropy, hashes, keys, ranks, escapes. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..schema import CONFIDENCES, SEVERITIES


def rank(value: Column, order: Sequence[str]) -> Column:
    """0-based place of an enumeration value; null for others."""
    return look_up(value, {v: i for i, v in enumerate(order)})


def severity_rank(value: Column) -> Column:
    return rank(value, SEVERITIES)


def confidence_rank(value: Column) -> Column:
    return rank(value, CONFIDENCES)


def look_up(value: Column, table: Mapping[str, object], default: object = None) -> Column:
    """Value of a small fixed table, as one flat case expression."""
    out = None
    for k, v in table.items():
        out = F.when(value == k, F.lit(v)) if out is None else out.when(value == k, F.lit(v))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def fixed_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small fixed table. It crosses to the JVM once, as Arrow: a list of tuples would start Python on every executor, in
    processes of their own, to hand its rows through."""
    kind = StructType.fromDDL(schema)
    fields = to_arrow_schema(kind)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields), kind)


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits; 0 for the empty string."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.length(text).cast("double")
    parts = F.transform(F.array_distinct(chars), lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))).cast("double") / n)
    return F.aggregate(parts, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))


def charset_size(text: Column) -> Column:
    return F.size(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")))


def anonymized(text: Column) -> Column:
    """Short values vanish behind stars; of longer ones four characters stay on either side."""
    n = F.length(text)
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(text, 1, 4), F.repeat(F.lit("*"), n - 8), F.right(text, F.lit(4))))


def code_hash(snippet: Column) -> Column:
    """First 16 hex digits of SHA-256 of the text with white space collapsed."""
    return F.substring(F.sha2(F.trim(F.regexp_replace(snippet, r"[ \t\r\n]+", " ")), 256), 1, 16)


def finding_key(rule_id: Column, file: Column, line: Column) -> Column:
    return F.concat_ws(":", rule_id, file, line.cast("string"))


def relative_path(file: Column, root: str) -> Column:
    """file below root, with forward slashes."""
    root = root.rstrip("/") + "/"
    f = F.replace(file, F.lit("\\"), F.lit("/"))
    return F.when(F.startswith(f, F.lit(root)), F.substr(f, F.lit(len(root) + 1))).otherwise(f)


def html_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def sarif_level(severity: Column) -> Column:
    return look_up(severity, {"critical": "error", "high": "error", "medium": "warning", "low": "note"}, "none")


def clean_version(version: Column) -> Column:
    """Without leading range signs and trailing stars."""
    return F.regexp_replace(F.regexp_replace(F.trim(version), r"^[\^~<>= ]+", ""), r"[*]+$", "")


def snippet(text: Column, size: int = 150) -> Column:
    return F.substring(F.trim(F.replace(text, F.lit("\n"), F.lit(" "))), 1, size)


def ascii_bounded(words: str) -> str:
    """A pattern between ASCII word boundaries, the same for the JVM as for RE2's boundary."""
    return rf"(?<![A-Za-z0-9_])(?:{words})(?![A-Za-z0-9_])"


#: Frequent words by which prose is told from random strings.
STOP_WORDS = (
    "the and for are but not you all can had her was one our out has have from they will with this that what when make like just into "
    "over such only other some could been than then also very after about which their there would should because between through "
    "during without another"
).split()


def is_prose(text: Column) -> Column:
    """At least three words, two of them frequent ones, whatever sign stands at a word; or spaces and mostly, not only, letters."""
    words = F.split(F.lower(text), r"[ \t\r\n\f\x0B]+")
    known = F.size(F.filter(words, lambda w: F.regexp_replace(w, "[^a-z]", "").isin(STOP_WORDS)))
    letters = F.length(F.regexp_replace(text, "[^A-Za-z]", "")) / F.greatest(F.length(text), F.lit(1))
    return F.when(F.size(words) < 3, False).when(known >= 2, True).otherwise(F.contains(text, F.lit(" ")) & (letters > 0.6) & (letters < 0.9))
