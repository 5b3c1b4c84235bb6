"""Functions, calls, the call graph and its closure; and the forward trace of tainted lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.needs import batched, mapped, pieces

FUNCTIONS = "file string, name string, start_line int, end_line int, exported boolean, calls array<string>, seq bigint"
#: Words before a bracket that are no calls.
NO_CALLS = set(
    "if for while switch catch return function typeof new await async else elif and or not in is with lambda def class print range len "
    "require import super this self func go defer make append panic echo isset empty array list foreach unset parseInt parseFloat "
    "String Number Boolean Array Object Promise Math JSON console setTimeout setInterval".split()
)
HEADS = {
    ".py": re.compile(r"^(?P<indent>\s*)(?:async\s+)?def\s+(?P<n>\w+)\s*\(", re.M),
    ".go": re.compile(r"^func\s+(?:\([^)]*\)\s*)?(?P<n>\w+)\s*\(", re.M),
    ".php": re.compile(r"\bfunction\s+(?P<n>\w+)\s*\(", re.M),
    ".rb": re.compile(r"^(?P<indent>\s*)def\s+(?:self\.)?(?P<n>\w+[?!]?)", re.M),
    ".js": re.compile(
        r"(?P<x>export\s+(?:default\s+)?)?(?:async\s+)?function\s*\*?\s*(?P<n>\w+)\s*\(|(?P<x2>export\s+)?(?:const|let|var)\s+(?P<n2>\w+)\s*=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*=>|\w+\s*=>)|^\s+(?:async\s+)?(?P<n3>\w+)\s*\([^)]*\)\s*\{",
        re.M,
    ),
}
HEADS |= dict.fromkeys((".jsx", ".ts", ".tsx", ".mjs", ".cjs"), HEADS[".js"])
CALL = re.compile(r"([A-Za-z_$][\w$.]*)\s*\(")


def _body(content: str, at: int, ext: str, indent: str) -> tuple[int, int]:
    """Bounds of a function's text: by indentation where there are no braces."""
    if ext in (".py", ".rb"):
        end = content.find("\n", at)
        pos = end + 1 if end >= 0 else len(content)
        while pos < len(content):
            stop = content.find("\n", pos)
            stop = len(content) if stop < 0 else stop
            line = content[pos:stop]
            if line.strip() and len(line) - len(line.lstrip()) <= len(indent) and not (ext == ".rb" and line.strip() == "end"):
                break
            pos = stop + 1
        return at, min(pos, len(content))
    brace = content.find("{", at)
    if brace < 0 or content.count("\n", at, brace) > 3:
        stop = content.find("\n", at)
        return at, len(content) if stop < 0 else stop
    depth = 0
    for i in range(brace, len(content)):
        c = content[i]
        depth += (c == "{") - (c == "}")
        if depth == 0:
            return at, i + 1
    return at, len(content)


def functions_of(content: str, ext: str) -> list[tuple[str, int, int, bool, list[str]]]:
    """(name, first line, last line, exported, called names) in order."""
    head = HEADS.get(ext)
    out = []
    for m in head.finditer(content) if head else ():
        g = m.groupdict()
        name = g.get("n") or g.get("n2") or g.get("n3")
        if not name or name in NO_CALLS:
            continue
        start = m.start() + len(m[0]) - len(m[0].lstrip("\n"))
        a, b = _body(content, start, ext, (g.get("indent") or "").strip("\n"))
        inner = content[m.end() : b]
        calls = list(dict.fromkeys(c.rsplit(".", 1)[-1] for c in CALL.findall(inner) if c.rsplit(".", 1)[-1] not in NO_CALLS))
        exported = bool(g.get("x") or g.get("x2")) or ext != ".js" and name[0].isupper() or f"exports.{name}" in content
        out.append((name, content.count("\n", 0, a) + 1, content.count("\n", 0, max(a, b - 1)) + 1, exported, calls))
    return out


def functions(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.string()), pa.int64()]
        found = ((f, *x, i) for piece in pieces(batches) for f, e, t in zip(*piece, strict=True) for i, x in enumerate(functions_of(t or "", e)))
        return batched(found, types, [x.split()[0] for x in FUNCTIONS.split(", ")])

    return mapped(files.where(F.col("ext").isin(list(HEADS))).select("file", "ext", "content"), run, FUNCTIONS)


def call_edges(funcs: DataFrame) -> DataFrame:
    """Calls resolved by name: the same file's function first, else the first exported one of that name."""
    calls = funcs.select(F.col("file").alias("src_file"), F.col("name").alias("src"), F.col("seq").alias("src_seq"), F.explode("calls").alias("callee"))
    own = funcs.groupBy("file", "name").agg(F.min("seq").alias("seq")).select(F.col("file").alias("own_file"), F.col("name").alias("own"))
    best = funcs.where("exported").groupBy(F.col("name").alias("far")).agg(F.min(F.struct("file", "seq")).alias("at")).select("far", F.col("at.file").alias("far_file"))
    j = calls.join(own, (F.col("src_file") == F.col("own_file")) & (F.col("callee") == F.col("own")), "left").join(best, F.col("callee") == F.col("far"), "left")
    j = j.withColumn("dst_file", F.coalesce("own_file", "far_file")).where("dst_file is not null")
    return j.select("src_file", "src", "dst_file", F.col("callee").alias("dst")).distinct()


#: Rows of a join that one task takes, and from how many on a node's rows are dealt out over several.
TASK_ROWS, HUB_ROWS = 1_000_000, 100_000


def reachable(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 64) -> DataFrame:
    """All pairs (src, dst) joined by a path, and each node with itself. Least distances double every round: a pair farther apart
    than 2^k has a node on its way that is 2^k from its end, so that only pairs of that very distance are joined on. New pairs are
    written to the shared folder; nodes that many pairs lead to are dealt out over several tasks."""
    spark = edges.sparkSession
    same = F.col("src").eqNullSafe(F.col("dst"))
    e = _cut(spark, edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct())
    nodes = e.select("src").union(e.select("dst")).distinct()
    # as in SQL, an edge from null is followed from nowhere
    reach = end = e.where(F.col("src").isNotNull() & ~same).withColumn("far", F.lit(1))
    n = reach.count()
    for k in range(rounds):
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK_ROWS))
        two = _through(reach, end, 2**k, parts).where(~same).groupBy("src", "dst").agg(F.min("far").alias("far"))
        known = reach.select(F.col("src").alias("_src"), F.col("dst").alias("_dst")).repartition(parts, "_src", "_dst")
        new = _cut(spark, two.join(known, (F.col("src") == F.col("_src")) & F.col("dst").eqNullSafe(F.col("_dst")), "left_anti"))
        m = new.count()
        reach, n = reach.unionByName(new), n + m
        # pairs of the greatest distance that paths of this round have; without them there are no longer ones
        end = new.where(F.col("far") == 2 ** (k + 1))
        if not m or end.isEmpty():
            break
    return reach.select("src", "dst").union(nodes.select(F.col("src"), F.col("src").alias("dst")))


def _through(reach: DataFrame, end: DataFrame, step: int, parts: int) -> DataFrame:
    """Pairs (src, dst, far) of a pair of reach and one of end, of distance `step`, that begins where it ends."""
    last = end.select(F.col("src").alias("mid"), F.col("dst").alias("to"))
    starts = last.groupBy("mid").agg(F.count("*").alias("_n")).select(F.col("mid").alias("node"))
    # one row per node with HUB_ROWS pairs or more
    hubs = reach.groupBy(F.col("dst").alias("hub")).agg(F.count("*").alias("_n")).where(F.col("_n") >= HUB_ROWS)
    hubs = F.broadcast(hubs.join(starts, F.col("hub") == F.col("node"), "left").select("hub", F.ceil(F.col("_n") / HUB_ROWS).cast("int").alias("shares"), F.col("node").isNotNull().alias("goes_on")))
    # pairs into a hub that no pair of end leaves are not moved
    a = reach.join(hubs, F.col("dst") == F.col("hub"), "left").where("goes_on is null or goes_on").select("src", F.col("dst").alias("at"), "far", F.pmod(F.xxhash64("src"), F.coalesce("shares", F.lit(1))).cast("int").alias("share"))
    b = last.join(hubs, F.col("mid") == F.col("hub"), "left").select("mid", "to", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)).alias("part"))
    j = a.repartition(parts, "at", "share").join(b.repartition(parts, "mid", "part"), (F.col("at") == F.col("mid")) & (F.col("share") == F.col("part")))
    return j.select("src", F.col("to").alias("dst"), (F.col("far") + step).alias("far")).repartition(parts, "src", "dst")


def _cut(spark, df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the cluster's shared folder."""
    from ..sources.state import checkpoint

    return checkpoint(df)


#: What a line must hold to bring outside data in, and where it must not go.
SOURCES = {
    "request": r"\breq(?:uest)?\.(?:query|params|body|headers|cookies|args|form|values|GET|POST|files)|\$_(?:GET|POST|REQUEST|COOKIE)|\bparams\[|\bctx\.(?:query|request)",
    "input": r"\binput\(|\breadline\(|\bgets\b|process\.stdin|sys\.stdin",
    "environment": r"process\.(?:argv|env)|os\.environ|sys\.argv|os\.Getenv|\$argv",
    "url": r"location\.(?:search|hash|href)|URLSearchParams|document\.(?:cookie|referrer)|r\.(?:URL\.Query|FormValue)",
}
SINKS = {
    "sql": r"\b(?:query|execute|executemany|raw|Exec|QueryRow|mysqli_query)\s*\(",
    "command": r"\b(?:exec|execSync|spawn|system|popen|shell_exec|passthru|Popen|check_output)\s*\(|exec\.Command\(",
    "code-exec": r"\beval\s*\(|new\s+Function\s*\(",
    "file-op": r"\b(?:readFile|readFileSync|writeFile|createReadStream|open|fopen|file_get_contents|unlink)\s*\(",
    "xss": r"innerHTML|document\.write\s*\(|res\.(?:send|write)\s*\(|\becho\b",
    "ssrf": r"\b(?:fetch|axios(?:\.\w+)?|urlopen|requests\.\w+|curl_init)\s*\(",
    "redirect": r"\bredirect\s*\(|location\.href\s*=",
}
WINDOW = 80
TRACE = "file string, source_line int, source string, variable string, line int, sink string, snippet string, chain array<string>, seq bigint"


def trace_lines(content: str) -> list[tuple]:
    """For each source line that assigns a variable: lines after it, at most WINDOW on, where the variable or one it is assigned
    to reaches a sink. One row per line and sink."""
    lines = content.split("\n")
    sources = [(k, re.compile(v, re.A)) for k, v in SOURCES.items()]
    sinks = [(k, re.compile(v, re.A)) for k, v in SINKS.items()]
    assign = re.compile(r"\$?([A-Za-z_$][\w$]*)\s*:?=[^=]", re.A)
    seen, out = set(), []
    for i, text in enumerate(lines):
        kind = next((k for k, rx in sources if rx.search(text)), None)
        m = assign.search(text) if kind else None
        if not m:
            continue
        var, chain = m[1], [m[1]]
        for j in range(i + 1, min(i + WINDOW, len(lines))):
            uses = re.search(rf"(?<![\w$]){re.escape(var)}(?![\w$])", lines[j])
            if not uses:
                continue
            sink = next((k for k, rx in sinks if rx.search(lines[j])), None)
            m2 = assign.search(lines[j])
            if m2 and m2[1] != var and not sink and uses.start() > m2.start():
                var = m2[1]
                chain = [*chain, var]
                continue
            if sink and (j, sink) not in seen:
                seen.add((j, sink))
                out.append((i + 1, kind, var, j + 1, f"{sink}: {lines[j].strip()[:150]}", lines[j].strip()[:150], chain, len(out)))
    return out


def line_traces(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int64()]
        found = ((f, *x) for piece in pieces(batches) for f, t in zip(*piece, strict=True) for x in trace_lines(t or ""))
        return batched(found, types, [x.split()[0] for x in TRACE.split(", ")])

    any_source = "|".join(f"(?:{v})" for v in SOURCES.values())
    return mapped(files.where(F.col("content").rlike(any_source)).select("file", "content"), run, TRACE)


def trace_findings(traces: DataFrame) -> DataFrame:
    from .findings import classify_sink

    c = classify_sink(F.col("sink"))
    return traces.select(
        F.lit("interproc-taint").alias("rule_id"), c["title"].alias("title"), c["severity"].alias("severity"), F.lit("high").alias("confidence"),
        F.concat(F.lit("Data from line "), F.col("source_line").cast("string"), F.lit(" reaches "), F.regexp_extract("sink", "^([a-z-]+)", 1)).alias("message"),
        "file", "line", F.lit(1).alias("col"), "snippet", F.lit("Validate or escape the value before it is used.").alias("recommendation"), c["cwe"].alias("cwe"),
        F.struct(F.col("source").alias("source"), F.array("sink").alias("sinks"), F.col("chain").alias("variable_chain"), F.array().cast("array<string>").alias("sanitizers"), F.lit("high").alias("confidence")).alias("taint"),
        F.lit("medium").alias("fp_risk"), F.lit("interproc").alias("engine"), "seq",
    )


def bounded_paths(edges: DataFrame, start: DataFrame, depth: int, src: str = "src", dst: str = "dst") -> DataFrame:
    """(start, node, depth): nodes at every least distance up to depth."""
    e = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct()
    found = start.select(F.col("start"), F.col("start").alias("node"), F.lit(0).alias("depth"))
    frontier = found
    for k in range(1, depth + 1):
        step = frontier.join(e, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        frontier = step.join(found, ["start", "node"], "left_anti").withColumn("depth", F.lit(k))
        found = found.unionByName(frontier)
    return found


def consecutive(statements: DataFrame, by: str, order: str, item: str) -> DataFrame:
    """Edges from each statement to the next of its file."""
    return statements.withColumn("dst", F.lead(item).over(W.partitionBy(by).orderBy(order))).where("dst is not null").select(by, F.col(item).alias("src"), "dst")
