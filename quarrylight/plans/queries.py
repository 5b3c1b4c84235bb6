"""The registered queries on the data tables, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cvss
from ..functions.scalar import anonymized, ascii_bounded, code_hash, finding_key, html_escaped, is_prose, look_up, severity_rank
from ..operators import callgraph, deps, findings, graph, match, secrets, ssa, triage
from .. import sinks
from ..sources import files as sources
from ..sources import state
from ..streaming import watch
from . import diff, incremental
from .scan import ScanOptions, scan

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def doc_files(spark: SparkSession, d: str) -> DataFrame:
    """documents as files doc/<id>.txt"""
    return sources.of_table(table(spark, d, "documents"), F.format_string("doc/%d.txt", "doc_id"), "text")


def page_files(spark: SparkSession, d: str) -> DataFrame:
    return sources.of_table(table(spark, d, "pages"), F.format_string("page/%d.html", "page_id"), "html")


#: The catalog of the table queries: (rule, regex for the JVM, regex for RE2, severity, confidence, weakness).
CATALOG = [
    ("weak-cipher", "(?i)" + ascii_bounded("des"), r"(?i)\bdes\b", "high", "low", "CWE-327"),
    ("hardcoded-token", r"token = \"[0-9a-f]{40}\"", r'token = "[0-9a-f]{40}"', "critical", "high", "CWE-798"),
    ("script-tag", r"<script", r"<script", "medium", "medium", "CWE-79"),
    ("email-address", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[a-z]{2,}", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[a-z]{2,}", "low", "high", "CWE-200"),
    ("license-line", r"(?i)licen[sc]ed? under", r"(?i)licen[sc]ed? under", "info", "certain", "CWE-937"),
    ("phone-number", r"\+1 \([0-9]{3}\)", r"\+1 \([0-9]{3}\)", "low", "medium", "CWE-200"),
]
_VALUES = ", ".join(f"('{r}', '{rx}', '{s}', '{c}', '{w}')" for r, _, rx, s, c, w in CATALOG)
_LINES = "lines AS (SELECT 'doc/' || doc_id || '.txt' AS file, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS text FROM documents WHERE text IS NOT NULL)"
_CATALOG = f"catalog(rule_id, regex, severity, confidence, cwe) AS (VALUES {_VALUES})"
_HITS = f"{_LINES}, {_CATALOG}, hits AS (SELECT file, line, text, rule_id, severity, confidence, cwe, len(regexp_extract_all(text, regex)) AS n FROM lines, catalog WHERE regexp_matches(text, regex))"


NEEDS = {"weak-cipher": "des", "hardcoded-token": "token = ", "script-tag": "<script", "email-address": "@", "license-line": "licen", "phone-number": "+1 ("}
PATTERNS = [{"rule_id": r, "regex": j, "needs": NEEDS[r], "severity": s, "confidence": c, "cwe": w} for r, j, _, s, c, w in CATALOG]


def doc_hits(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents that the catalog matches: file, line, text, rule_id, severity, confidence, cwe, n."""
    return match.match_rows(sources.lines(doc_files(spark, d)), PATTERNS)


def doc_findings(spark: SparkSession, d: str) -> DataFrame:
    """The hits as findings."""
    h = doc_hits(spark, d)
    return h.select("rule_id", "file", "line", "severity", "confidence", "cwe", F.substring(F.trim("text"), 1, 150).alias("snippet"), F.lit("low").alias("fp_risk"), F.lit("").alias("message"), cvss.owasp(F.col("cwe")).alias("owasp"), (F.col("line") * 10).cast("bigint").alias("seq"), F.lit(1).alias("col"))


def _case(column: str, table_: dict, default: str = "NULL") -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in table_.items()) + f" ELSE {default} END"


_RANK = "CASE severity WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 END"
_OWASP = _case("cwe", cvss.CWE_OWASP, "'A04'")


@query(f"WITH {_LINES} SELECT file, CAST(line AS INT) AS line, text FROM lines")
def lines_explode(spark, d):
    return sources.lines(doc_files(spark, d))


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE n_chars <= 10000 AND lang IN ('en', 'de') AND source <> 'src0' AND source NOT LIKE 'src1%'")
def corpus_filter_size_lang(spark, d):
    t = table(spark, d, "documents")
    return t.where((F.col("n_chars") <= 10_000) & F.col("lang").isin("en", "de") & ~sources.excluded(F.col("source"), ["src0", "src1*"])).select("doc_id", "lang", "source", "n_chars")


_ENTROPY = "coalesce((SELECT -sum(p * log2(p)) FROM (SELECT count(*) * 1.0 / len(value) AS p FROM (SELECT unnest(string_split(value, '')) AS ch) WHERE ch <> '' GROUP BY ch)), 0.0)"
_ASSIGN_RE = r"""(?i)(password|passwd|pwd|secret|token|api[_-]?key|auth|credential|private[_-]?key|key)\s*[:=]\s*["''`]([^"''`\n]{8,})["''`]"""
_ASSIGNED = f"hits AS (SELECT 'doc/' || doc_id || '.txt' AS file, unnest(regexp_extract_all(text, '{_ASSIGN_RE}')) AS hit FROM documents), named AS (SELECT row_number() OVER () AS k, file, regexp_extract(hit, '{_ASSIGN_RE}', 1) AS name, regexp_extract(hit, '{_ASSIGN_RE}', 2) AS value FROM hits), chars AS (SELECT k, ch, count(*) AS n FROM (SELECT k, unnest(string_split(value, '')) AS ch FROM named) WHERE ch <> '' GROUP BY k, ch), ent AS (SELECT k, -sum(n / len(value) * log2(n / len(value))) AS h FROM chars JOIN named USING (k) GROUP BY k)"


@query(f"WITH {_ASSIGNED} SELECT file, name, value, round(h, 6) AS entropy FROM named JOIN ent USING (k)")
def secret_assignments(spark, d):
    return secrets.assignments(doc_files(spark, d)).select("file", "name", "value", "entropy")


@query(f"WITH {_ASSIGNED} SELECT file, value, round(h, 6) AS entropy, CASE WHEN h >= 4.5 THEN 'critical' ELSE 'high' END AS severity FROM named JOIN ent USING (k) WHERE len(value) >= 16 AND round(h, 6) >= 3.5")
def secret_entropy(spark, d):
    return secrets.assigned_secrets(doc_files(spark, d)).select("file", "value", "entropy", "severity")


@query(f"WITH {_ASSIGNED} SELECT file, CASE WHEN len(value) <= 8 THEN repeat('*', len(value)) ELSE substr(value, 1, 4) || repeat('*', len(value) - 8) || right(value, 4) END AS masked FROM named")
def anonymized_secrets(spark, d):
    return secrets.assignments(doc_files(spark, d)).select("file", anonymized(F.col("value")).alias("masked"))


_LITERAL_RE = r"""\"(?:[^\"\\\n]|\\.)*\"|''(?:[^''\\\n]|\\.)*''|`(?:[^`\\]|\\.)*`"""


@query(
    f"""WITH f AS (SELECT 'page/' || page_id || '.html' AS file, html AS content FROM pages UNION ALL SELECT 'doc/' || doc_id || '.txt', text FROM documents), l AS (SELECT file, unnest(regexp_extract_all(content, '{_LITERAL_RE}')) AS q FROM f),
v AS (SELECT row_number() OVER () AS k, file, substr(substr(q, 2, len(q) - 2), 1, 200) AS value FROM l), c AS (SELECT k, file, value FROM v WHERE len(value) BETWEEN 16 AND 512),
ch AS (SELECT k, x, count(*) AS n FROM (SELECT k, unnest(string_split(value, '')) AS x FROM c) WHERE x <> '' GROUP BY k, x), e AS (SELECT k, -sum(n / len(value) * log2(n / len(value))) AS h FROM ch JOIN c USING (k) GROUP BY k)
SELECT file, value, round(h, 5) AS entropy FROM c JOIN e USING (k) WHERE h >= 4.0"""
)
def generic_secret_literals(spark, d):
    files = page_files(spark, d).unionByName(doc_files(spark, d))
    s = secrets.scored(secrets.literals(files).where((F.length("value") >= secrets.LEAST) & (F.length("value") <= secrets.MOST)))
    return s.where("entropy >= 4.0").select("file", "value", F.round("entropy", 5).alias("entropy"))


_STOP = "['" + "','".join(__import__("quarrylight.functions.scalar", fromlist=["STOP_WORDS"]).STOP_WORDS) + "']"


@query(
    f"""WITH b AS (SELECT 'doc/' || doc_id AS file, text FROM documents UNION ALL SELECT 'turn/' || conv_id || '/' || turn, text FROM conversations),
t AS (SELECT file, text, string_split_regex(lower(text), '[ \\t\\r\\n\\f\\x0B]+') AS words FROM b WHERE text IS NOT NULL),
s AS (SELECT *, len(list_filter(words, lambda w: list_contains({_STOP}, regexp_replace(w, '[^a-z]', '', 'g')))) AS known, len(regexp_replace(text, '[^A-Za-z]', '', 'g')) * 1.0 / greatest(len(text), 1) AS letters FROM t)
SELECT file, CASE WHEN len(words) < 3 THEN false WHEN known >= 2 THEN true ELSE contains(text, ' ') AND letters > 0.6 AND letters < 0.9 END AS prose FROM s"""
)
def natural_language_docs(spark, d):
    """Documents and conversations."""
    docs = table(spark, d, "documents").select(F.format_string("doc/%d", "doc_id").alias("file"), "text")
    turns = table(spark, d, "conversations").select(F.format_string("turn/%d/%d", "conv_id", "turn").alias("file"), "text")
    return docs.unionByName(turns).where("text is not null").select("file", is_prose(F.col("text")).alias("prose"))


@query(f"WITH {_HITS} SELECT file, CAST(line AS INT) AS line, rule_id, CAST(n AS INT) AS n FROM hits")
def pattern_match_docs(spark, d):
    return doc_hits(spark, d).select("file", "line", "rule_id", "n")


_PAGE_LINES = "pl AS (SELECT 'page/' || page_id || '.html' AS file, unnest(range(1, len(string_split(html, chr(10))) + 1)) AS line, unnest(string_split(html, chr(10))) AS text FROM pages WHERE html IS NOT NULL)"


@query(f"WITH {_PAGE_LINES}, {_CATALOG} SELECT file, CAST(line AS INT) AS line, rule_id, CAST(len(regexp_extract_all(text, regex)) AS INT) AS n FROM pl, catalog WHERE regexp_matches(text, regex)")
def pattern_match_pages(spark, d):
    return match.match_rows(sources.lines(page_files(spark, d)), PATTERNS).select("file", "line", "rule_id", "n")


@query()
def pattern_masked_matches(spark, d):
    return match.masked_matches(page_files(spark, d).withColumn("ext", F.lit(".js")), r"\btrack\(|<script|https?://")


@query(f"WITH {_HITS} SELECT rule_id, severity, file, CAST(line AS INT) AS line, cwe, {_OWASP} AS owasp FROM hits WHERE {_RANK} >= 2 ORDER BY {_RANK} DESC, file, line, rule_id")
def entry_findings(spark, d):
    f = findings.at_least(findings.weight_non_production(doc_findings(spark, d)), "medium")
    return findings.report_order(f).select("rule_id", "severity", "file", "line", "cwe", "owasp")


_ITEMS = "SELECT l_orderkey AS file, l_suppkey % 7 AS rule_id, l_linenumber AS line, l_linenumber % 2 AS col, CASE l_returnflag WHEN 'R' THEN 'certain' WHEN 'A' THEN 'high' ELSE 'low' END AS confidence, l_partkey * 10 + l_linenumber AS seq FROM lineitem"


def _items(spark, d):
    t = table(spark, d, "lineitem")
    conf = look_up(F.col("l_returnflag"), {"R": "certain", "A": "high"}, "low")
    return t.select(F.col("l_orderkey").alias("file"), (F.col("l_suppkey") % 7).alias("rule_id"), F.col("l_linenumber").alias("line"), (F.col("l_linenumber") % 2).alias("col"), conf.alias("confidence"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("seq"))


@query(f"WITH i AS ({_ITEMS}), k AS (SELECT file, rule_id, col AS line, confidence, seq, row_number() OVER (PARTITION BY file, rule_id, col ORDER BY CASE confidence WHEN 'certain' THEN 3 WHEN 'high' THEN 2 ELSE 0 END DESC, seq) AS r FROM i) SELECT file, rule_id, line, confidence, seq FROM k WHERE r = 1")
def finding_dedup_position(spark, d):
    i = _items(spark, d).withColumn("line", F.col("col")).withColumn("col", F.lit(1))
    return findings.dedupe_positions(i).select("file", "rule_id", "line", "confidence", "seq")


@query(
    f"""WITH i AS ({_ITEMS}), a AS (SELECT file, line, rule_id, 'ast' AS engine FROM i WHERE confidence = 'certain'), p AS (SELECT file, line, rule_id, 'pattern' AS engine FROM i WHERE confidence <> 'low' OR col = 0)
SELECT * FROM a UNION ALL SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.file = p.file AND a.line = p.line AND a.rule_id = p.rule_id)"""
)
def finding_dedup_engines(spark, d):
    i, cols = _items(spark, d), ["file", "line", "rule_id"]
    a = i.where("confidence = 'certain'").select(*cols, F.lit("ast").alias("engine"))
    p = i.where("confidence <> 'low' or col = 0").select(*cols, F.lit("pattern").alias("engine"))
    return findings.dedupe_engines(a, p)


@query(
    """WITH a AS (SELECT l_orderkey AS k, l_suppkey AS s, l_partkey AS line FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT l_suppkey AS s, l_partkey AS line FROM lineitem WHERE l_returnflag = 'A')
SELECT k, s, line FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.s = a.s AND abs(a.line - b.line) <= 25)"""
)
def band_anti_join_25(spark, d):
    t = table(spark, d, "lineitem")
    a = t.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("line"))
    b = t.where("l_returnflag = 'A'").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("line"))
    return findings.band_anti(a, b, ["s"], "line")


_PRIORITY = {"1-URGENT": "critical", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "low", "5-LOW": "info"}


def _orders(spark, d):
    t = table(spark, d, "orders")
    return t.select("o_orderkey", look_up(F.col("o_orderpriority"), _PRIORITY).alias("severity"), F.round("o_totalprice", 2).alias("price"))


_ORDERS = f"SELECT o_orderkey, {_case('o_orderpriority', _PRIORITY)} AS severity, round(o_totalprice, 2) AS price FROM orders"


@query(f"WITH o AS ({_ORDERS}) SELECT * FROM o WHERE {_RANK} >= 3")
def severity_threshold(spark, d):
    return _orders(spark, d).where(severity_rank(F.col("severity")) >= 3)


@query(f"WITH o AS ({_ORDERS}) SELECT * FROM o ORDER BY {_RANK} DESC NULLS LAST, price DESC, o_orderkey LIMIT 100")
def severity_sorted_topk(spark, d):
    return _orders(spark, d).orderBy(severity_rank(F.col("severity")).desc(), F.desc("price"), "o_orderkey").limit(100)


@query(
    f"""WITH {_HITS}, f AS (SELECT severity, confidence, {_OWASP} AS owasp, cwe, 'low' AS fp_risk FROM hits),
c AS (SELECT 'severity' AS dimension, severity AS value, count(*) AS n FROM f GROUP BY 2 UNION ALL SELECT 'confidence', confidence, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'owasp', owasp, count(*) FROM f GROUP BY 2
  UNION ALL SELECT 'cwe', cwe, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'fp_risk', fp_risk, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'total', 'all', count(*) FROM f
  UNION ALL SELECT * FROM (VALUES ('severity', 'info', 0), ('severity', 'low', 0), ('severity', 'medium', 0), ('severity', 'high', 0), ('severity', 'critical', 0), ('confidence', 'low', 0), ('confidence', 'medium', 0), ('confidence', 'high', 0), ('confidence', 'certain', 0), ('fp_risk', 'low', 0), ('fp_risk', 'medium', 0), ('fp_risk', 'high', 0)))
SELECT dimension, value, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1, 2"""
)
def summary_counts(spark, d):
    return findings.summary(doc_findings(spark, d))


@query(f"WITH {_HITS} SELECT rule_id, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM hits GROUP BY rule_id")
def percent_of_total(spark, d):
    return findings.share_of_total(doc_hits(spark, d).select("rule_id"), "rule_id")


@query(cvss.oracle_scores("VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in cvss.DEFAULT_VECTORS.items())))
def cvss_scores(spark, d):
    v = spark.createDataFrame(list(cvss.DEFAULT_VECTORS.items()), "rule_id string, vector string")
    return cvss.scored(v).select("rule_id", "base", "impact", "exploitability", "rating")


@query(f"WITH {_HITS} SELECT cwe, {_OWASP} AS owasp, count(*) AS n FROM hits GROUP BY 1, 2")
def cwe_owasp_enrich(spark, d):
    return doc_findings(spark, d).groupBy("cwe", "owasp").agg(F.count("*").alias("n"))


@query(
    """WITH p AS (SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'low' ELSE 'info' END AS severity, CASE WHEN page_id % 2 = 0 THEN 'tests/' || page_id || '.js' ELSE 'src/' || page_id || '.js' END AS file FROM pages),
h AS (SELECT *, regexp_matches(file, '(^|/)tests?/') AS hit FROM p)
SELECT page_id, file, CASE WHEN NOT hit THEN severity WHEN severity = 'critical' THEN 'high' ELSE 'info' END AS severity, CASE WHEN hit THEN 'm (test or sample code)' ELSE 'm' END AS message, CASE WHEN hit THEN 'medium' ELSE 'low' END AS fp_risk FROM h"""
)
def weight_nonprod(spark, d):
    p = table(spark, d, "pages")
    sev = look_up((F.col("page_id") % 3).cast("string"), {"0": "critical", "1": "low"}, "info")
    file = F.when(F.col("page_id") % 2 == 0, F.format_string("tests/%d.js", "page_id")).otherwise(F.format_string("src/%d.js", "page_id"))
    return findings.weight_non_production(p.select("page_id", file.alias("file"), sev.alias("severity"), F.lit("m").alias("message"), F.lit("low").alias("fp_risk")))


def _verdicts(spark, d):
    """labels as verdicts: quality says whether a finding on the document is real, toxic raises its severity."""
    lab = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    j = lab.join(docs, "doc_id")
    # every tenth document has changed since
    then = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))
    return j.select(
        finding_key(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(1)).alias("finding_key"), code_hash(then).alias("code_hash"), (F.col("quality") == 1).alias("is_real"),
        F.when(F.col("toxic") == 1, "critical").alias("adjusted_severity"), F.when(F.col("toxic") == 1, "fix").alias("fix"),
    )


def _doc_rows(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select(F.lit("doc").alias("rule_id"), F.col("doc_id").cast("string").alias("file"), F.lit(1).alias("line"), F.lit("medium").alias("severity"), F.col("text").alias("snippet"), "doc_id")


_TRIAGE = """lab AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
j AS (SELECT d.doc_id, CASE WHEN quality IS NULL THEN 'new' WHEN d.doc_id % 10 = 0 THEN 'stale' WHEN quality <> 1 THEN 'false' WHEN toxic = 1 THEN 'adjusted' ELSE 'real' END AS triage_state FROM documents d LEFT JOIN lab USING (doc_id) WHERE text IS NOT NULL)"""


@query(f"WITH {_TRIAGE} SELECT doc_id, triage_state, CASE WHEN triage_state = 'adjusted' THEN 'critical' ELSE 'medium' END AS severity FROM j WHERE triage_state <> 'false'")
def triage_apply(spark, d):
    return triage.apply(_doc_rows(spark, d), _verdicts(spark, d))[0].select("doc_id", "triage_state", "severity")


@query(f"WITH {_TRIAGE} SELECT triage_state, count(*) AS n FROM j GROUP BY 1")
def triage_counters(spark, d):
    return triage.apply(_doc_rows(spark, d), _verdicts(spark, d))[1]


@query("WITH lab AS (SELECT doc_id, max(quality) AS q, max(toxic) AS t FROM labels GROUP BY doc_id) SELECT count(*) AS total, count(*) FILTER (q = 1) AS real, count(*) FILTER (q <> 1) AS false_positives, count(*) FILTER (t = 1) AS with_fix FROM lab JOIN documents USING (doc_id)")
def triage_stats(spark, d):
    return triage.stats(_verdicts(spark, d))


def _marked(marks):
    return " + ".join(f"CAST(regexp_matches(text, '{rx.replace(chr(39), chr(39) * 2)}') AS INT)" for rx, _ in marks)


@query(
    f"""WITH {_TRIAGE}, q AS (SELECT doc_id, {_marked(triage.FALSE_MARKS)} AS no_, {_marked(triage.TRUE_MARKS)} AS yes_ FROM j JOIN documents USING (doc_id) WHERE triage_state IN ('new', 'stale'))
SELECT doc_id, CASE WHEN yes_ > no_ THEN 'high' WHEN no_ > yes_ THEN 'low' ELSE 'medium' END AS priority FROM q
ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, CAST(doc_id AS VARCHAR) LIMIT 25"""
)
def review_queue(spark, d):
    return triage.review_queue(_doc_rows(spark, d), _verdicts(spark, d)).select("doc_id", "priority")


def _two_versions(spark, d):
    """The corpus before and after: a seventh is new, a ninth is gone, an eleventh has changed."""
    f = table(spark, d, "documents").where("text is not null")
    now = f.where("doc_id % 9 <> 1").select(F.col("doc_id").cast("string").alias("file"), F.sha2("text", 256).alias("sha256"))
    then = f.where("doc_id % 7 <> 1").select(F.col("doc_id").cast("string").alias("file"), F.sha2(F.when(F.col("doc_id") % 11 == 1, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("sha256"))
    return then, now


_CHANGES = """now_ AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL AND doc_id % 9 <> 1), then_ AS (SELECT doc_id, sha256(CASE WHEN doc_id % 11 = 1 THEN text || 'x' ELSE text END) AS h FROM documents WHERE text IS NOT NULL AND doc_id % 7 <> 1),
ch AS (SELECT CAST(coalesce(n.doc_id, t.doc_id) AS VARCHAR) AS file, CASE WHEN n.h IS NULL THEN 'deleted' WHEN t.h IS NULL THEN 'added' WHEN n.h <> t.h THEN 'modified' ELSE 'unchanged' END AS change FROM now_ n FULL JOIN then_ t ON n.doc_id = t.doc_id)"""


@query(f"WITH {_CHANGES} SELECT file, change FROM ch")
def change_detection(spark, d):
    then, now = _two_versions(spark, d)
    return incremental.changes(now, then)


#: The catalog as rules of a user, so that the whole scan runs on what SQL can say too.
USER_RULES = tuple({"id": r, "name": r, "severity": s, "confidence": c, "cwe": w, "extensions": ["*"], "patterns": [{"regex": rx}], "falsePositiveRisk": "low"} for r, _, rx, s, c, w in CATALOG)
USER_SCAN = ScanOptions(rules=[r["id"] for r in USER_RULES], custom=USER_RULES, entropy=False, deps=False, taint=False)
_SCANNED = f"{_LINES}, {_CATALOG}, scanned AS (SELECT file, line, rule_id, severity, confidence, cwe, text, unnest(regexp_extract_all(text, '(?i)' || regex)) AS hit FROM lines, catalog WHERE regexp_matches(text, '(?i)' || regex))"


@query(f"WITH {_SCANNED} SELECT rule_id, file, CAST(line AS INT) AS line, severity, confidence, cwe, count(*) AS n FROM scanned GROUP BY ALL")
def full_scan_docs(spark, d):
    """The whole scan of all documents under the catalog as a user's rules."""
    return scan(doc_files(spark, d), USER_SCAN).groupBy("rule_id", "file", "line", "severity", "confidence", "cwe").agg(F.count("*").alias("n"))


@query()
def full_scan_pages(spark, d):
    """The whole scan of all pages, every rule and engine."""
    return scan(page_files(spark, d)).groupBy("rule_id", "severity", "confidence", "engine").agg(F.count("*").alias("n"))


#: Generated files that one task scans.
MODULES_A_TASK = 4000


def modules(spark, d):
    """A module of source for each part: a handler with a query, a digest and a helper in the same file, safe or not by the part's
    size."""
    t = table(spark, d, "part").where("p_partkey is not null and p_size is not null").select("p_partkey", "p_size")
    # a few bytes of a part become a file: dealt out by the number of files, not by the size of the table that they come from
    t = t.repartition(max(spark.sparkContext.defaultParallelism, -(-t.count() // MODULES_A_TASK)), "p_partkey")
    n = F.col("p_partkey").cast("string")
    query_ = F.when(F.col("p_size") % 2 == 0, "'SELECT * FROM t WHERE id = ' + id").otherwise("'SELECT * FROM t WHERE id = ?', [id]")
    digest = F.when(F.col("p_size") % 3 == 0, "md5").otherwise("sha256")
    lines = [
        (F.lit("const db = require('./db');"),),
        (F.lit("function handle"), n, F.lit("(req, res) {")),
        (F.lit("  const id = req.query.id;"),),
        (F.lit("  db.query("), query_, F.lit(");")),
        (F.lit("  const h = crypto.createHash('"), digest, F.lit("').update(id);")),
        (F.lit("  return helper"), n, F.lit("(h);")),
        (F.lit("}"),),
        (F.lit("function helper"), n, F.lit("(x) {")),
        (F.lit("  return x;"),),
        (F.lit("}"),),
        (F.lit("module.exports = { handle"), n, F.lit(" };"),),
    ]
    code = F.concat_ws("\n", *[F.concat(*x) for x in lines])
    return t.select(F.format_string("src/m%d.js", "p_partkey").alias("name"), code.alias("code"))


@query(
    """WITH m AS (SELECT 'src/m' || p_partkey || '.js' AS file, p_size FROM part WHERE p_partkey IS NOT NULL)
SELECT file, 'insecure-crypto' AS rule_id, 5 AS line FROM m WHERE p_size % 3 = 0 UNION ALL SELECT file, 'sql-injection', 4 FROM m WHERE p_size % 2 = 0"""
)
def scan_modules(spark, d):
    """A module of source for every part, scanned by every rule and engine; the two planted flaws by file and line."""
    files = sources.of_table(modules(spark, d), F.col("name"), "code")
    return scan(files).where(F.col("rule_id").isin("sql-injection", "insecure-crypto")).select("file", "rule_id", "line")


@query(f"WITH {_CHANGES}, {_SCANNED} SELECT file, rule_id, count(*) AS n FROM scanned WHERE CAST(regexp_extract(file, '([0-9]+)', 1) AS BIGINT) % 9 <> 1 GROUP BY 1, 2")
def incremental_equals_full(spark, d):
    """The corpus as it was is scanned into a cache; the scan of the corpus as it is takes what has not changed from there."""
    n = F.regexp_extract("file", "([0-9]+)", 1).cast("long")
    files = doc_files(spark, d)
    then = F.when(n % 11 == 1, F.concat("content", F.lit("x"))).otherwise(F.col("content"))
    old = sources.of_table(files.where(n % 7 != 1).select("file", then.alias("text")), F.col("file"), "text")
    folder = state.scratch(spark, "scans")
    incremental.scan_incremental(old, folder, USER_SCAN)
    found = incremental.scan_incremental(files.where(n % 9 != 1), folder, USER_SCAN)
    return found.groupBy("file", "rule_id").agg(F.count("*").alias("n"))


@query(
    """WITH m AS (SELECT median(epoch(ts)) AS mid FROM events), b AS (SELECT event_type, count(*) AS n FROM events, (SELECT min(epoch(ts)) + (max(epoch(ts)) - min(epoch(ts))) / 2 AS mid FROM events) WHERE epoch(ts) < mid GROUP BY 1),
a AS (SELECT event_type, count(*) AS n FROM events, (SELECT min(epoch(ts)) + (max(epoch(ts)) - min(epoch(ts))) / 2 AS mid FROM events) WHERE epoch(ts) >= mid GROUP BY 1)
SELECT coalesce(a.event_type, b.event_type) AS event_type, coalesce(b.n, 0) AS n_before, coalesce(a.n, 0) AS n_after, coalesce(a.n, 0) - coalesce(b.n, 0) AS delta FROM b FULL JOIN a ON a.event_type = b.event_type"""
)
def snapshot_diff_counts(spark, d):
    e = table(spark, d, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    mid = e.agg((F.min("s") + (F.max("s") - F.min("s")) / 2).alias("mid"))  # one row
    e = e.join(F.broadcast(mid))
    return incremental.count_diff(e.where("s < mid"), e.where("s >= mid"), "event_type")


@query()
def semantic_diff(spark, d):
    n = F.regexp_extract("file", "([0-9]+)", 1).cast("bigint")
    before = doc_findings(spark, d).where(n % 5 != 0).withColumn("line", F.col("line") + (n % 30).cast("int"))
    return diff.compare(before, doc_findings(spark, d).where(n % 7 != 0)).groupBy("classification").agg(F.count("*").alias("n"))


@query(
    """WITH b AS (SELECT DISTINCT user_id, event_type FROM events WHERE epoch(ts) < (SELECT min(epoch(ts)) + (max(epoch(ts)) - min(epoch(ts))) / 2 FROM events)), a AS (SELECT DISTINCT user_id, event_type FROM events WHERE epoch(ts) >= (SELECT min(epoch(ts)) + (max(epoch(ts)) - min(epoch(ts))) / 2 FROM events))
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, CASE WHEN b.user_id IS NULL THEN 'new' WHEN a.user_id IS NULL THEN 'resolved' ELSE 'unchanged' END AS state FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type"""
)
def watch_delta(spark, d):
    e = table(spark, d, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    e = e.join(F.broadcast(e.agg((F.min("s") + (F.max("s") - F.min("s")) / 2).alias("mid"))))
    return findings.delta(e.where("s < mid"), e.where("s >= mid"), ["user_id", "event_type"])


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS first_at, max(ts) AS last_at, count(*) AS n FROM s GROUP BY user_id, k"""
)
def session_debounce(spark, d):
    return watch.sessions(table(spark, d, "events"), "user_id", "ts", "6 hours")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark, d):
    return watch.tumbling(table(spark, d, "events"), "ts", "1 day", "event_type")


@query(
    """WITH x AS (SELECT event_type, time_bucket(INTERVAL 12 HOUR, ts) AS w FROM events), y AS (SELECT event_type, w AS window_start FROM x UNION ALL SELECT event_type, w - INTERVAL 12 HOUR FROM x)
SELECT window_start, event_type, count(*) AS n FROM y GROUP BY 1, 2"""
)
def sliding_counts(spark, d):
    return watch.sliding(table(spark, d, "events"), "ts", "1 day", "12 hours", "event_type")


@query(
    f"""WITH {_HITS}, k AS (SELECT DISTINCT file, line FROM hits WHERE rule_id = 'hardcoded-token'), r AS (SELECT k.file, k.line, l.line AS no, CASE WHEN l.line = k.line THEN '> ' ELSE '  ' END || l.line || ': ' || l.text AS said FROM k JOIN lines l ON l.file = k.file AND l.line BETWEEN k.line - 2 AND k.line + 2)
SELECT file, CAST(line AS INT) AS line, string_agg(said, chr(10) ORDER BY no) AS context FROM r GROUP BY 1, 2"""
)
def context_window(spark, d):
    hits = doc_hits(spark, d).where("rule_id = 'hardcoded-token'")
    return triage.context(hits, sources.lines(doc_files(spark, d)), 2)


def _edges(spark, d):
    """Foreign keys as a graph of names."""
    t = {n: table(spark, d, n) for n in ("nation", "customer", "supplier", "orders")}
    name = lambda k, c: F.format_string(k + "%d", F.col(c).cast("long"))
    parts = [
        ("IN", t["nation"].select(name("n", "n_nationkey").alias("src"), name("r", "n_regionkey").alias("dst"))),
        ("OF", t["customer"].select(name("c", "c_custkey").alias("src"), name("n", "c_nationkey").alias("dst"))),
        ("OF", t["supplier"].select(name("s", "s_suppkey").alias("src"), name("n", "s_nationkey").alias("dst"))),
        ("BY", t["orders"].select(name("o", "o_orderkey").alias("src"), name("c", "o_custkey").alias("dst"))),
    ]
    out = None
    for kind, p in parts:
        p = p.withColumn("type", F.lit(kind))
        out = p if out is None else out.unionByName(p)
    return out


_EDGES = """e AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'IN' AS type FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'OF' FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'OF' FROM supplier UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'BY' FROM orders)"""


@query(f"WITH {_EDGES} SELECT a.src, a.type, a.dst, b.dst AS next FROM e a JOIN e b ON a.dst = b.src WHERE a.type = 'OF'")
def graph_out_edges(spark, d):
    e = _edges(spark, d)
    return e.where("type = 'OF'").join(e.select(F.col("src").alias("dst"), F.col("dst").alias("next")), "dst").select("src", "type", "dst", "next")


@query(f"WITH {_EDGES}, n AS (SELECT src AS x FROM e UNION SELECT dst FROM e) SELECT 'edge' AS what, type, count(*) AS n FROM e GROUP BY type UNION ALL SELECT 'node', substr(x, 1, 1), count(*) FROM n GROUP BY 2 UNION ALL SELECT 'file', 'all', 1")
def graph_stats(spark, d):
    e = _edges(spark, d)
    n = e.select(F.col("src").alias("x")).union(e.select("dst")).distinct().select(F.substring("x", 1, 1).alias("type"), F.lit("g").alias("file"))
    return graph.stats(n, e)


@query(f"WITH RECURSIVE {_EDGES}, x AS (SELECT src FROM e UNION SELECT dst FROM e), r(src, dst) AS (SELECT src, src FROM x UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT src, dst FROM r")
def reachability_closure(spark, d):
    return callgraph.reachable(_edges(spark, d))


@query(f"WITH {_EDGES} SELECT a.src AS start, a.src AS node, 0 AS depth FROM (SELECT DISTINCT src FROM e WHERE type = 'OF') a UNION ALL SELECT DISTINCT src, dst, 1 FROM e WHERE type = 'OF' UNION ALL SELECT DISTINCT a.src, b.dst, 2 FROM e a JOIN e b ON a.dst = b.src WHERE a.type = 'OF'")
def bounded_paths(spark, d):
    e = _edges(spark, d)
    return callgraph.bounded_paths(e, e.where("type = 'OF'").select(F.col("src").alias("start")).distinct(), 3)


#: Snippets of our own for the operators on programs.
SNIPPETS = [
    ("src/a.js", "const id = req.query.id;\nconst q = 'SELECT * FROM t WHERE id = ' + id;\ndb.query(q);\nconst n = parseInt(req.query.n);\ndb.query('SELECT ' + n);\n"),
    ("src/b.py", "name = request.args.get('n')\nos.system('ping ' + name)\n"),
    ("src/c.js", "db.query('SELECT 1 WHERE a = ?', [req.query.a]);\nfunction f() { return g(1); }\nfunction g(x) { return x; }\n"),
]


@query("SELECT * FROM (VALUES ('src/a.js', 'cpg-sql', 1, 3, 'id'), ('src/b.py', 'cpg-command-exec', 1, 2, 'name')) v(file, rule_id, source_line, line, variable)")
def taint_paths(spark, d):
    return graph.taint(sources.of_rows(spark, SNIPPETS)).select("file", "rule_id", "source_line", "line", "variable")


@query("SELECT * FROM (VALUES ('src/a.js', 1, 3, 'sql'), ('src/b.py', 1, 2, 'command'), ('src/a.js', 4, 5, 'sql')) v(file, source_line, line, kind)")
def line_traces(spark, d):
    return callgraph.line_traces(sources.of_rows(spark, SNIPPETS)).select("file", "source_line", "line", F.regexp_extract("sink", "^([a-z-]+)", 1).alias("kind"))


@query("SELECT * FROM (VALUES ('src/c.js', 'f', 'src/c.js', 'g')) v(src_file, src, dst_file, dst)")
def call_edges(spark, d):
    return callgraph.call_edges(callgraph.functions(sources.of_rows(spark, SNIPPETS)))


@query(
    """WITH RECURSIVE copy(src, dst) AS (SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM lineitem), addr(var, alloc) AS (SELECT DISTINCT 'p' || p_partkey, 'b' || p_brand FROM part),
pts(var, alloc) AS (SELECT var, alloc FROM addr UNION SELECT alloc, alloc FROM addr UNION SELECT dst, alloc FROM pts JOIN copy ON src = var) SELECT var, alloc FROM pts"""
)
def points_to_fixpoint(spark, d):
    c = table(spark, d, "lineitem").select(F.lit("copy").alias("kind"), F.format_string("s%d", "l_suppkey").alias("lhs"), F.format_string("p%d", "l_partkey").alias("rhs"))
    a = table(spark, d, "part").select(F.lit("addr").alias("kind"), F.format_string("p%d", "p_partkey").alias("lhs"), F.concat(F.lit("b"), "p_brand").alias("rhs"))
    return ssa.points_to(c.unionByName(a).distinct())


def _blocks(spark):
    return spark.createDataFrame([("f", 0, [1, 2]), ("f", 1, [3]), ("f", 2, [3]), ("f", 3, [4, 0]), ("f", 4, []), ("g", 0, [1]), ("g", 1, [1, 2]), ("g", 2, [])], "fn string, block int, succ array<int>")


@query("SELECT * FROM (VALUES ('f', 0, 0, '0'), ('f', 1, 0, '3'), ('f', 2, 0, '3'), ('f', 3, 0, '0'), ('f', 4, 3, ''), ('g', 0, 0, ''), ('g', 1, 0, '1'), ('g', 2, 1, '')) v(fn, block, idom, frontier)")
def dominators(spark, d):
    return ssa.dominators(_blocks(spark)).select("fn", "block", "idom", F.array_join(F.col("frontier").cast("array<string>"), ",").alias("frontier"))


def _instr(spark):
    rows = [("f", 0, 0, "LITERAL", "x", []), ("f", 1, 0, "ASSIGN", "x", ["p"]), ("f", 2, 0, "CALL", "x", ["x"]), ("f", 3, 0, "ASSIGN", "y", ["x"]), ("f", 4, 0, "RETURN", None, ["y"])]
    return spark.createDataFrame(rows, "fn string, block int, seq int, op string, dest string, args array<string>")


@query()
def ssa_def_use(spark, d):
    return ssa.def_use(ssa.ssa(_instr(spark), _blocks(spark).where("fn = 'f'")))


@query("SELECT * FROM (VALUES ('lodash', '^4.17.0', '4.17.0', false), ('jest', '~29.0.0', '29.0.0', true)) v(name, spec, version, dev)")
def dep_manifest_json(spark, d):
    text = '{"dependencies": {"lodash": "^4.17.0"}, "devDependencies": {"jest": "~29.0.0"}}'
    return deps.package_json_native(sources.of_rows(spark, [("a/package.json", text)])).select("name", "spec", "version", "dev")


@query("SELECT * FROM (VALUES ('lodash', 'CVE-2021-23337', 'exact'), ('pyyaml', 'CVE-2020-14343', 'exact')) v(name, id, match)")
def dep_advisories(spark, d):
    rows = [("a/package.json", '{"dependencies": {"lodash": "^4.17.0", "express": "4.18.0"}}'), ("b/requirements.txt", "pyyaml==5.1\nrequests>=2.31.0\n")]
    return deps.vulnerable(deps.dependencies(sources.of_rows(spark, rows)), deps.offline_advisories(spark)).select("name", "id", "match")


@query(r"SELECT page_id, c AS call, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '([A-Za-z_]+)\(', 1)) AS c FROM pages) GROUP BY 1, 2")
def call_extract(spark, d):
    p = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"([A-Za-z_]+)\("), F.lit(1))).alias("call"))
    return p.groupBy("page_id", "call").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_verdict(spark, d):
    return findings.first_per(table(spark, d, "events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type")


@query(
    f"""WITH {_HITS}, f AS (SELECT rule_id, file, line, text, row_number() OVER (ORDER BY {_RANK} DESC, file, line, rule_id) AS place FROM hits),
r AS (SELECT rule_id, dense_rank() OVER (ORDER BY first_place) - 1 AS k FROM (SELECT rule_id, min(place) AS first_place FROM f GROUP BY 1)),
o AS (SELECT rule_id, file, line, row_number() OVER (PARTITION BY rule_id, file, sha256(trim(substr(trim(text), 1, 150))) ORDER BY line) - 1 AS n FROM f)
SELECT rule_id, file, CAST(line AS INT) AS line, CAST(k AS INT) AS rule_index, CAST(n AS INT) AS occurrence FROM o JOIN r USING (rule_id)"""
)
def sarif_rule_index(spark, d):
    return sinks.sarif_rows(doc_findings(spark, d)).select("rule_id", "file", "line", "rule_index", "occurrence")


@query(f"WITH {_HITS}, p AS (SELECT rule_id, file, line, substr(sha256(trim(substr(trim(text), 1, 150))), 1, 8) AS print FROM hits) SELECT rule_id, print, CAST(max(o) AS INT) AS last FROM (SELECT *, row_number() OVER (PARTITION BY rule_id, file, print ORDER BY line) - 1 AS o FROM p) GROUP BY 1, 2")
def occurrence_fingerprint(spark, d):
    return findings.occurrences(doc_findings(spark, d)).groupBy("rule_id", "print").agg(F.max("occurrence").alias("last"))


@query("SELECT page_id, length(e) AS n_chars, sha256(e) AS escaped_sha256 FROM (SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS e FROM pages)")
def html_escape(spark, d):
    p = table(spark, d, "pages").select("page_id", html_escaped(F.col("html")).alias("e"))
    return p.select("page_id", F.length("e").cast("bigint").alias("n_chars"), F.sha2(F.col("e"), 256).alias("escaped_sha256"))


@query()
def rule_summary(spark, d):
    from ..operators import catalog

    return catalog.rule_summary(spark)
