"""Secrets by entropy, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import anonymized, charset_size, entropy, is_prose

LITERAL = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`"
ASSIGNMENT = r"(?i)(password|passwd|pwd|secret|token|api[_-]?key|auth|credential|private[_-]?key|key)\s*[:=]\s*[\"'`]([^\"'`\n]{8,})[\"'`]"
UPPER = r"([A-Z_]{3,30})\s*=\s*[\"'`]([^\"'`\n]{20,})[\"'`]"
KEY_BLOCK = r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"
LEAST, MOST, CUT, GATE = 16, 512, 200, 4.2


def scored(df: DataFrame, value: str = "value") -> DataFrame:
    """df with entropy and the traits of a string."""
    v = F.col(value)
    return df.withColumns(
        {
            "entropy": entropy(v),
            "is_base64": v.rlike("^[A-Za-z0-9+/]+={0,2}$"),
            "is_hex": v.rlike("^[0-9a-fA-F]+$"),
            "mixed_case": v.rlike("[a-z]") & v.rlike("[A-Z]"),
            "has_digit": v.rlike("[0-9]"),
            "has_special": v.rlike("[^A-Za-z0-9]"),
            "charset": charset_size(v),
        }
    )


def hits(files: DataFrame, regex: str, placed: bool = False) -> DataFrame:
    """(file, seq, hit) of every match in whole contents; placed: with the line and column where it begins. Contents are cut at the
    matches, and only the sizes of the parts between them, not the parts, are moved to be summed up by file."""
    found = F.regexp_extract_all("content", F.lit(regex), F.lit(0))
    if not placed:
        return files.select("file", F.posexplode(found).alias("seq", "hit"))
    both = files.select("file", found.alias("hit"), F.split("content", regex, -1).alias("gap")).where(F.size("hit") > 0)
    parts = both.select("file", F.posexplode(F.arrays_zip("hit", "gap")).alias("seq", "x")).where("x.hit is not null").select("file", "seq", "x.hit", "x.gap")
    lines = lambda t: F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    last = lambda t: F.length(t) - F.length(F.substring_index(t, "\n", -1))  # noqa: E731  characters up to and with the last line feed
    sizes = parts.select("file", "seq", "hit", *[f(F.col(c)).alias(f"{n}_{c}") for c in ("gap", "hit") for n, f in (("n", F.length), ("lines", lines), ("last", last))])
    w = W.partitionBy("file").orderBy("seq")
    upto = lambda c: F.sum(f"{c}_gap").over(w) + F.sum(f"{c}_hit").over(w) - F.col(f"{c}_hit")  # noqa: E731  before this match
    at = sizes.withColumns({"at": upto("n"), "line": (upto("lines") + 1).cast("int")})
    # where the line of a match begins: behind the last line feed of the gap, or of an earlier match
    begin = F.when(F.col("last_gap") > 0, F.col("at") - F.col("n_gap") + F.col("last_gap"))
    after = F.when(F.col("last_hit") > 0, F.col("at") + F.col("last_hit"))
    line_at = F.greatest(F.max(begin).over(w), F.max(after).over(w.rowsBetween(W.unboundedPreceding, -1)))
    return at.withColumn("col", (F.col("at") - F.coalesce(line_at, F.lit(0)) + 1).cast("int")).select("file", "seq", "hit", "line", "col")


def _place(df: DataFrame) -> list[str]:
    return [c for c in ("line", "col") if c in df.columns]


def literals(files: DataFrame, placed: bool = False) -> DataFrame:
    """String literals of whole contents, cut to 200 characters."""
    found = hits(files, LITERAL, placed)
    inner = F.substr("hit", F.lit(2), F.length("hit") - 2)
    return found.select("file", "seq", F.substring(inner, 1, CUT).alias("value"), *_place(found))


def category(value: Column) -> tuple[Column, Column]:
    """(category, confidence) of a scored literal; specific shapes go before the general gates."""
    n, h = F.length(value), F.col("entropy")
    b64 = F.col("is_base64") & (n >= 20) & (h >= 4.5)
    hexa = F.col("is_hex") & (n >= 32) & (h >= 3.5)
    generic = (h >= 4.8) & (F.col("charset") >= 30)
    kind = (
        F.when(value.rlike("^AKIA[0-9A-Z]{16}$"), "aws-access-key")
        .when(value.rlike("^gh[pousr]_[A-Za-z0-9]{36,}$"), "github-token")
        .when(b64 & (n == 40), "aws-secret-key")
        .when(b64, "base64-secret")
        .when(hexa, "hex-secret")
        .when(generic, "high-entropy")
    )
    sure = (
        F.when(kind.isin("aws-access-key", "github-token"), "certain")
        .when(kind.isin("aws-secret-key", "base64-secret"), F.when(h >= 5.2, "certain").otherwise("high"))
        .when(kind == "hex-secret", F.when(h >= 4.0, "high").otherwise("medium"))
        .when(kind == "high-entropy", "medium")
    )
    return kind, sure


def generic_secrets(files: DataFrame, gate: float = 3.5, placed: bool = False) -> DataFrame:
    """Literals that look random and are no prose."""
    s = scored(literals(files, placed)).where((F.length("value") >= LEAST) & (F.length("value") <= MOST) & ~is_prose(F.col("value")) & (F.col("entropy") >= gate))
    kind, sure = category(F.col("value"))
    return s.withColumns({"category": kind, "confidence": sure}).where("category is not null").select("file", "seq", "value", F.round("entropy", 6).alias("entropy"), "category", "confidence", *_place(s))


def _named(files: DataFrame, regex: str, placed: bool) -> DataFrame:
    found = hits(files, regex, placed)
    out = found.select("file", "seq", F.regexp_extract("hit", regex, 1).alias("name"), F.regexp_extract("hit", regex, 2).alias("value"), *_place(found))
    return out.withColumn("entropy", F.round(entropy(F.col("value")), 6))


def assignments(files: DataFrame, placed: bool = False) -> DataFrame:
    """Every credential assignment with its entropy, strong or not."""
    return _named(files, ASSIGNMENT, placed)


def assigned_secrets(files: DataFrame, placed: bool = False) -> DataFrame:
    """Credential assignments of at least 16 characters and 3.5 bits."""
    s = assignments(files, placed).where((F.length("value") >= 16) & (F.col("entropy") >= 3.5))
    strong = F.col("entropy") >= 4.5
    return s.select("*", F.when(strong, "critical").otherwise("high").alias("severity"), F.when(strong, "certain").otherwise("high").alias("confidence"), anonymized(F.col("value")).alias("masked"))


def named_secrets(files: DataFrame, placed: bool = False) -> DataFrame:
    """Upper-case names that speak of a secret, with random values."""
    return _named(files, UPPER, placed).where((F.col("entropy") >= 3.8) & F.col("name").rlike("KEY|SECRET|TOKEN|PASSWORD|CREDENTIAL|AUTH|API|PRIVATE"))


def private_keys(files: DataFrame, placed: bool = False) -> DataFrame:
    found = hits(files, KEY_BLOCK, placed)
    return found.select("file", "seq", F.col("hit").alias("value"), *_place(found))


def findings(files: DataFrame) -> DataFrame:
    """Secret findings of all scans, one at every place of a value, values anonymised."""
    parts = [
        generic_secrets(files, placed=True).select("file", "line", "col", "value", "entropy", F.col("category"), "confidence", F.lit("high").alias("severity")),
        assigned_secrets(files, placed=True).select("file", "line", "col", "value", "entropy", F.lit("password").alias("category"), "confidence", "severity"),
        named_secrets(files, placed=True).select("file", "line", "col", "value", "entropy", F.lit("named-secret").alias("category"), F.lit("high").alias("confidence"), F.lit("high").alias("severity")),
        private_keys(files, placed=True).select("file", "line", "col", "value", F.lit(6.0).alias("entropy"), F.lit("private-key").alias("category"), F.lit("certain").alias("confidence"), F.lit("critical").alias("severity")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(
        F.concat(F.lit("entropy-"), F.col("category")).alias("rule_id"), F.lit("Secret in source").alias("title"), "severity", "confidence",
        F.concat(F.lit("A "), F.col("category"), F.lit(" with "), F.format_number("entropy", 2), F.lit(" bits per character")).alias("message"),
        "file", "line", "col", anonymized(F.expr("substr(value, 1, 60)")).alias("snippet"), F.lit("Read secrets from the environment or a vault.").alias("recommendation"),
        F.lit("CWE-798").alias("cwe"), F.lit("A02").alias("owasp"), F.when(F.col("entropy") < 4.5, "medium").otherwise("low").alias("fp_risk"), F.lit("entropy").alias("engine"),
        F.xxhash64("category", "value", "line", "col").alias("seq"),
    ).dropDuplicates(["file", "rule_id", "line", "col"])
