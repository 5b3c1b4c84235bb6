"""CVSS 3.1 base scores as column arithmetic, and the tables that go with rules."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalar import look_up

#: Fixed values of the standard.
AV = {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}
AC = {"L": 0.77, "H": 0.44}
PR = {"N": 0.85, "L": 0.62, "H": 0.27}
PR_CHANGED = {"N": 0.85, "L": 0.68, "H": 0.5}
UI = {"N": 0.85, "R": 0.62}
CIA = {"N": 0.0, "L": 0.22, "H": 0.56}

#: Default vector of a rule (short form AV/AC/PR/UI/S/C/I/A); rules without one have no score.
DEFAULT_VECTORS = {
    "sql-injection": "N/L/N/N/U/H/H/H",
    "command-injection": "N/L/N/N/U/H/H/H",
    "hardcoded-secrets": "N/L/N/N/U/H/H/H",
    "xss": "N/L/N/R/C/L/L/N",
    "path-traversal": "N/L/N/N/U/H/N/N",
    "insecure-crypto": "N/H/N/N/U/H/H/N",
    "ssrf": "N/L/N/N/U/H/H/N",
    "nosql-injection": "N/L/N/N/U/H/H/H",
    "open-redirect": "N/L/N/R/U/L/L/N",
    "prototype-pollution": "N/L/N/N/U/H/H/H",
    "insecure-deserialization": "N/L/N/N/U/H/H/H",
    "xxe": "N/L/N/N/U/H/N/N",
    "insecure-jwt": "N/L/N/N/U/H/H/N",
    "missing-authz": "N/L/L/N/U/H/H/H",
    "ssti": "N/L/N/N/U/H/H/H",
    "ldap-injection": "N/L/N/N/U/H/H/N",
    "mass-assignment": "N/L/N/N/U/H/H/H",
    "idor": "N/L/L/N/U/H/H/N",
    "graphql-injection": "N/L/N/N/U/H/H/N",
    "cors-misconfig": "N/L/N/R/C/H/H/N",
    "race-condition": "N/H/N/N/U/H/H/H",
    "arbitrary-file-write": "N/L/N/N/U/H/H/H",
    "dependency-vuln": "N/L/N/N/U/H/H/H",
    "docker-root": "L/L/L/N/C/H/H/H",
    "docker-secret": "L/L/L/N/C/H/H/N",
    "k8s-privileged": "N/L/L/N/C/H/H/H",
    "terraform-misconfig": "N/L/N/N/U/H/H/H",
    "csrf": "N/L/N/R/U/L/L/N",
    "http-parameter-pollution": "N/L/N/N/U/L/L/N",
    "cache-poisoning": "N/H/N/N/C/H/H/N",
    "clickjacking": "N/L/N/R/U/L/L/N",
    "dos-redos": "N/L/N/N/U/N/N/H",
    "insecure-cors": "N/L/N/R/C/H/H/N",
}

#: Class of weakness -> category of the 2021 list; what is not named is insecure design.
CWE_OWASP = {
    "CWE-89": "A03",
    "CWE-78": "A03",
    "CWE-79": "A03",
    "CWE-91": "A03",
    "CWE-94": "A03",
    "CWE-95": "A03",
    "CWE-564": "A03",
    "CWE-643": "A03",
    "CWE-1336": "A03",
    "CWE-20": "A03",
    "CWE-22": "A01",
    "CWE-23": "A01",
    "CWE-284": "A01",
    "CWE-285": "A01",
    "CWE-639": "A01",
    "CWE-601": "A01",
    "CWE-352": "A01",
    "CWE-918": "A10",
    "CWE-327": "A02",
    "CWE-328": "A02",
    "CWE-330": "A02",
    "CWE-798": "A02",
    "CWE-916": "A02",
    "CWE-502": "A08",
    "CWE-611": "A05",
    "CWE-16": "A05",
    "CWE-1004": "A05",
    "CWE-1021": "A05",
    "CWE-287": "A07",
    "CWE-306": "A07",
    "CWE-384": "A07",
    "CWE-1395": "A06",
    "CWE-1104": "A06",
    "CWE-117": "A09",
    "CWE-778": "A09",
    "CWE-400": "A04",
    "CWE-1333": "A04",
    "CWE-362": "A04",
    "CWE-434": "A04",
}
DEFAULT_OWASP = "A04"


def owasp(cwe: Column) -> Column:
    return look_up(cwe, CWE_OWASP, DEFAULT_OWASP)


def _round_up(x: Column) -> Column:
    return F.ceil(F.round(x * 10, 6)) / 10


def scored(df: DataFrame, vector: str = "vector") -> DataFrame:
    """df with base, impact, exploitability and rating of a short vector; nulls for a null vector. Parts become columns first, so
    that no expression is written out more than once."""
    at = F.split(vector, "/")
    parts = {f"_{n}": look_up(at[i], t) for n, i, t in (("av", 0, AV), ("ac", 1, AC), ("p0", 2, PR), ("p1", 2, PR_CHANGED), ("ui", 3, UI), ("c", 5, CIA), ("i", 6, CIA), ("a", 7, CIA))}
    out = df.withColumns(parts | {"_changed": at[4] == "C"})
    out = out.withColumns({"_e": 8.22 * F.col("_av") * F.col("_ac") * F.when(F.col("_changed"), F.col("_p1")).otherwise(F.col("_p0")) * F.col("_ui"), "_isc": 1 - (1 - F.col("_c")) * (1 - F.col("_i")) * (1 - F.col("_a"))})
    isc = F.col("_isc")
    out = out.withColumn("_imp", F.when(F.col("_changed"), 7.52 * (isc - 0.029) - 3.25 * F.pow(isc - 0.02, 15)).otherwise(6.42 * isc))
    out = out.withColumn("_sum", F.when(F.col("_changed"), 1.08 * (F.col("_imp") + F.col("_e"))).otherwise(F.col("_imp") + F.col("_e")))
    out = out.withColumn("base", F.when(F.col("_imp") <= 0, 0.0).otherwise(_round_up(F.least("_sum", F.lit(10.0)))))
    out = out.withColumns({"impact": F.round(F.greatest("_imp", F.lit(0.0)), 1), "exploitability": F.round("_e", 1), "rating": F.when(F.col("base").isNotNull(), rating(F.col("base")))})
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def score(vector: str) -> tuple[float, float, float, str, str]:
    """(base, impact, exploitability, vector, rating) of one vector, outside Spark."""
    av, ac, pr, ui, scope, c, i, a = vector.split("/")
    changed = scope == "C"
    e = 8.22 * AV[av] * AC[ac] * (PR_CHANGED if changed else PR)[pr] * UI[ui]
    isc = 1 - (1 - CIA[c]) * (1 - CIA[i]) * (1 - CIA[a])
    impact = 7.52 * (isc - 0.029) - 3.25 * (isc - 0.02) ** 15 if changed else 6.42 * isc
    base = 0.0 if impact <= 0 else math.ceil(round(min(10.0, 1.08 * (impact + e) if changed else impact + e) * 10, 6)) / 10
    name = next((n for least, n in ((9, "critical"), (7, "high"), (4, "medium"), (0.1, "low")) if base >= least), "none")
    return base, round(max(impact, 0.0), 1), round(e, 1), vector, name


def rating(base: Column) -> Column:
    return F.when(base >= 9, "critical").when(base >= 7, "high").when(base >= 4, "medium").when(base >= 0.1, "low").otherwise("none")


def severity_of(base: Column) -> Column:
    """Severity from a score: as the rating, but info where there is none."""
    return F.when(base >= 9, "critical").when(base >= 7, "high").when(base >= 4, "medium").when(base >= 0.1, "low").otherwise("info")


def oracle_scores(vectors: str) -> str:
    """DuckDB SQL over a relation (rule_id, vector)."""

    def case(i, table):
        return f"CASE string_split(vector, '/')[{i}] " + " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in table.items()) + " END"

    return f"""
WITH v(rule_id, vector) AS ({vectors}),
p AS (SELECT *, string_split(vector, '/')[5] = 'C' AS changed, {case(1, AV)} AS av, {case(2, AC)} AS ac, {case(3, PR)} AS pr0, {case(3, PR_CHANGED)} AS pr1,
  {case(4, UI)} AS ui, {case(6, CIA)} AS c, {case(7, CIA)} AS i, {case(8, CIA)} AS a FROM v),
q AS (SELECT *, CAST(8.22 AS DOUBLE) * av * ac * (CASE WHEN changed THEN pr1 ELSE pr0 END) * ui AS e, 1 - (1 - c) * (1 - i) * (1 - a) AS isc FROM p),
r AS (SELECT *, CASE WHEN changed THEN CAST(7.52 AS DOUBLE) * (isc - 0.029) - CAST(3.25 AS DOUBLE) * pow(isc - 0.02, 15) ELSE CAST(6.42 AS DOUBLE) * isc END AS imp FROM q),
s AS (SELECT *, CASE WHEN imp <= 0 THEN 0.0 ELSE ceil(round(least(CASE WHEN changed THEN CAST(1.08 AS DOUBLE) * (imp + e) ELSE imp + e END, 10.0) * 10, 6)) / 10 END AS base FROM r)
SELECT rule_id, CAST(base AS DOUBLE) AS base, round(greatest(imp, 0.0), 1) AS impact, round(e, 1) AS exploitability,
  CASE WHEN base >= 9 THEN 'critical' WHEN base >= 7 THEN 'high' WHEN base >= 4 THEN 'medium' WHEN base >= 0.1 THEN 'low' ELSE 'none' END AS rating FROM s"""
