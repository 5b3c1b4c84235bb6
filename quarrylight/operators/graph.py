"""Code property graphs as node and edge tables, and the taint search over them."""

from __future__ import annotations

import re
from collections import defaultdict, deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.needs import batched, clauses, mapped, pieces, possible
from ..schema import CPG_EDGES, CPG_NODES
from . import callgraph, lexer, shapes

#: Annotation specifications, tried in order; the first hit gives the category.
SOURCE_SPECS = [(k, v) for k, v in callgraph.SOURCES.items()]
SINK_SPECS = [
    ("sql", callgraph.SINKS["sql"]), ("command-exec", callgraph.SINKS["command"]), ("code-exec", callgraph.SINKS["code-exec"]), ("xss", callgraph.SINKS["xss"]),
    ("ssrf", callgraph.SINKS["ssrf"]), ("redirect", callgraph.SINKS["redirect"]), ("file-write", r"\b(?:writeFile|writeFileSync|file_put_contents)\s*\("), ("file-op", callgraph.SINKS["file-op"]),
    ("deserialization", r"pickle\.loads?\(|yaml\.load\(|unserialize\(|Marshal\.load\("),
]
SANITIZER_SPECS = [
    ("html", r"escapeHtml|htmlspecialchars|htmlentities|DOMPurify|sanitizeHtml|html\.escape|CGI\.escape"),
    ("number", r"\b(?:parseInt|parseFloat|Number|intval|floatval|int|float|strconv\.Atoi)\s*\("),
    ("sql", r"mysqli_real_escape_string|\.escape\(|sqlstring|quote_ident"),
    ("shell", r"shlex\.quote|escapeshellarg|Shellwords\.escape"),
    ("path", r"path\.basename|os\.path\.basename|secure_filename|filepath\.Base|realpath\("),
    ("check", r"\b(?:validate|sanitize|isValid|whitelist|allowlist)\w*\s*\("),
    ("url", r"encodeURIComponent|urlencode|url\.QueryEscape"),
]
#: Names that carry nothing of their own.
IGNORED = set("const let var return function if else for while true false null undefined None self this req res request response err error e i j k x y n ctx next app db data".split())
IDENT = re.compile(r"[A-Za-z_$][\w$]*", re.A)
MAX_DEPTH, MAX_PATHS = 15, 5
ASSIGN = re.compile(r"^\s*(?:export\s+)?(?:const|let|var|my)?\s*(?:\$?([A-Za-z_]\w*)(?:\s*:\s*[\w<>\[\], ]+)?|[{\[]([^}\]]+)[}\]])\s*:?=(?!=|>)\s*(.+?);?\s*$", re.A)
CALLED = re.compile(r"([A-Za-z_$][\w$.]*)\s*\(", re.A)


def _first(specs: list, code: str) -> str | None:
    return next((k for k, rx, needed in specs if possible(needed, code) and rx.search(code)), None)


SPECS = {"source": SOURCE_SPECS, "sink": SINK_SPECS, "sanitizer": SANITIZER_SPECS}
#: The specifications ready to use, with what each match holds.
COMPILED = {k: [(c, re.compile(rx, re.A), clauses(rx, re.A)) for c, rx in v] for k, v in SPECS.items()}
SOURCE_NEEDS = [needed for _, _, needed in COMPILED["source"]]
NOT_CALLED = callgraph.NO_CALLS - {"require"}


def annotate(nodes: DataFrame) -> DataFrame:
    """Columns source_cat, sink_cat and sanitizer_cat: the first specification that the code meets."""

    def of(specs) -> Column:
        out = F.lit(None).cast("string")
        for k, rx in reversed(specs):
            out = F.when(F.col("code").rlike(rx), k).otherwise(out)
        return out

    return nodes.withColumns({f"{k}_cat": of(v) for k, v in SPECS.items()})


class Builder:
    """Nodes and edges of one file. Ids count up within the file above the file's own number."""

    def __init__(self, file: str, base: int):
        self.file, self.base, self.nodes, self.edges = file, base, [], []

    def node(self, kind: str, label: str, line: int, col: int, code: str, end: int | None = None, **props) -> int:
        i = self.base + len(self.nodes)
        code = code.strip().replace("\n", " ")[:200]
        self.nodes.append((i, kind, label, self.file, line, end or line, col, col + len(code), code, {k: str(v) for k, v in props.items()} if props else {}))
        return i

    def edge(self, kind: str, src: int, dst: int, label: str = "", **props) -> None:
        self.edges.append((self.base + len(self.edges), kind, src, dst, label, {k: str(v) for k, v in props.items()} if props else {}))


def build_file(file: str, ext: str, content: str, base: int = 0) -> Builder:
    """FILE, FUNCTION with PARAMETERs, one STATEMENT per code line, CALL_SITE, ASSIGNMENT, MEMBER_EXPRESSION and VARIABLE_DECL nodes;
    AST_CHILD, HAS_PARAMETER, DECLARES, DATA_FLOW, REFERENCES, CONTROL_FLOW and CALLS edges."""
    g = Builder(file, base)
    root = g.node("FILE", file, 1, 0, file)
    clean = lexer.without_comments(content, ext)
    lines = clean.split("\n")
    funcs: dict[str, int] = {}
    bounds = []
    for name, a, b, exported, _ in callgraph.functions_of(clean, ext):
        head = lines[a - 1] if a <= len(lines) else ""
        f = g.node("FUNCTION", name, a, 0, name, b, exported=exported)
        g.edge("AST_CHILD", root, f)
        funcs[name] = f
        bounds.append((a, b, f))
        m = re.search(r"\(([^)]*)\)", head)
        for p in IDENT.findall(re.sub(r"=[^,]*", "", m[1])) if m else ():
            q = g.node("PARAMETER", p, a, 0, p)
            g.edge("HAS_PARAMETER", f, q)
    declared: dict[str, int] = {}
    last: dict[int, int] = {}
    open_values: list[tuple[str, int]] = []
    for no, text in enumerate(lines, 1):
        if not text.strip() or text.strip() in ("{", "}", "});", "};", "end"):
            continue
        owner = min(((b - a, f) for a, b, f in bounds if a < no <= b), default=(0, root))[1]
        st = g.node("CONDITION" if re.match(r"\s*(?:if|elif|else if|while|switch)\b", text) else "STATEMENT", text.strip()[:60], no, len(text) - len(text.lstrip()), text)
        g.edge("AST_CHILD", owner, st)
        if owner in last:
            g.edge("CONTROL_FLOW", last[owner], st)
        last[owner] = st
        targets: list[str] = []
        m = ASSIGN.match(text)
        if m:
            targets = [m[1]] if m[1] else IDENT.findall(m[2])
            asg = g.node("ASSIGNMENT", targets[0] if targets else "", no, m.start(3), text)
            g.edge("AST_CHILD", st, asg)
            for v in targets:
                d = g.node("VARIABLE_DECL", v, no, text.find(v), v)
                g.edge("DECLARES", asg, d, v)
                declared[v] = d
        used = set(IDENT.findall(m[3] if m else text))
        for v, at in open_values:
            if v in used:
                g.edge("DATA_FLOW", at, asg if m else st, v)
        for v in used & declared.keys():
            if v not in targets:
                g.edge("REFERENCES", declared[v], asg if m else st, v)
        for c in CALLED.finditer(text):
            if c[1].rsplit(".", 1)[-1] in NOT_CALLED:
                continue
            args = shapes.arguments(text, c.end() - 1)
            code = text[c.start() :].strip()
            call = g.node("CALL_SITE", c[1], no, c.start(), code, args=len(args or []))
            g.edge("AST_CHILD", asg if m else st, call)
            names = set(IDENT.findall(" ".join(args or [code])))
            for v, at in open_values:
                if v in names:
                    g.edge("DATA_FLOW", at, call, v)
            target = funcs.get(c[1].rsplit(".", 1)[-1])
            if target is not None:
                g.edge("CALLS", call, target, c[1])
            if "." in c[1]:
                g.edge("AST_CHILD", call, g.node("MEMBER_EXPRESSION", c[1], no, c.start(), c[1]))
        if m:
            open_values = [(v, at) for v, at in open_values if v not in targets] + [(v, asg) for v in targets]
    return g


def _rows(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, big, num, props = pa.string(), pa.int64(), pa.int32(), pa.map_(pa.string(), pa.string())
        types = [big, text, text, text, num, num, num, num, text, props] if kind == "nodes" else [big, text, big, big, text, props]
        names = [x.split()[0] for x in (CPG_NODES if kind == "nodes" else CPG_EDGES).split(", ")]
        graphs = (build_file(f, e, t or "", base) for piece in pieces(batches) for f, e, t, base in zip(*piece, strict=True))
        return batched(((*r[:-1], list(r[-1].items())) for g in graphs for r in (g.nodes if kind == "nodes" else g.edges)), types, names)

    return run


def _numbered(files: DataFrame) -> DataFrame:
    """Files with the first id of their nodes: 40 bits of the path's hash above 23 bits of counting, the same on every run."""
    base = F.shiftleft(F.xxhash64("file").bitwiseAND(F.lit((1 << 40) - 1)), 23)
    return files.where(F.col("ext").isin(sorted(lexer.C_LIKE | {".py", ".rb"}))).select("file", "ext", "content", base.alias("base"))


def nodes(files: DataFrame) -> DataFrame:
    return mapped(_numbered(files), _rows("nodes"), CPG_NODES)


def edges(files: DataFrame) -> DataFrame:
    return mapped(_numbered(files), _rows("edges"), CPG_EDGES)


def cross_file_calls(n: DataFrame) -> DataFrame:
    """CALLS edges from call sites to functions of other files by the last part of the name."""
    calls = n.where("type = 'CALL_SITE'").select(F.col("id").alias("src"), F.col("file").alias("src_file"), F.element_at(F.split("label", r"\."), -1).alias("name"))
    decl = n.where("type = 'FUNCTION'").groupBy(F.col("label").alias("name")).agg(F.max(F.struct("file", "id")).alias("d"))
    j = calls.join(decl, "name").where(F.col("src_file") != F.col("d.file"))
    return j.select("src", F.col("d.id").alias("dst"), F.col("name").alias("label"))


def expand(n: DataFrame, e: DataFrame, start: DataFrame, edge_type: str | None = None, backward: bool = False) -> DataFrame:
    """Nodes one edge away from start(id), along or against the edges."""
    a, b = ("dst", "src") if backward else ("src", "dst")
    e = e.where(F.col("type") == edge_type) if edge_type else e
    to = e.join(start.select(F.col("id").alias(a)), a, "left_semi").select(F.col(b).alias("id"))
    return n.join(to.distinct(), "id")


def find(n: DataFrame, regex: str | None = None, on: str = "code", kind: str | None = None, file: str | None = None) -> DataFrame:
    if kind:
        n = n.where(F.col("type") == kind)
    if file:
        n = n.where(F.col("file") == file)
    return n.where(F.col(on).rlike(regex)) if regex else n


def stats(n: DataFrame, e: DataFrame) -> DataFrame:
    """(what, type, n): nodes and edges by type, and files."""
    a = n.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), "type", "n")
    b = e.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), "type", "n")
    return a.unionByName(b).unionByName(n.agg(F.count_distinct("file").alias("n")).select(F.lit("file").alias("what"), F.lit("all").alias("type"), "n"))


def taint_stats(n: DataFrame) -> DataFrame:
    a = annotate(n).select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_cat").alias("category")) for k in SPECS])).alias("x"))
    return a.where("x.category is not null").groupBy("x.kind", "x.category").agg(F.count("*").alias("n"))


def result_variables(code: str) -> list[str]:
    m = ASSIGN.match(code)
    return ([m[1]] if m[1] else IDENT.findall(m[2])) if m else []


def follow(kind: str, label: str, target: tuple, var: str, names: frozenset[str], results: list[str]) -> str | None:
    """The variable that carries on over an edge; None where the trail ends. names and results: those of the target's code."""
    has = var in names
    if kind == "DATA_FLOW":
        return (results or [var])[0] if label == var or has else None
    if kind == "CONTROL_FLOW":
        return var if has or target[1] == "CONDITION" else None
    if kind == "CALLS":
        return var if has or label == var else None
    if kind in ("AST_CHILD", "TAINT_SOURCE", "TAINT_SINK"):
        return var
    if kind == "REFERENCES":
        return label if label == var else None
    if kind == "SANITIZES":
        return None
    return var if has else None


def taint_paths(g: Builder) -> list[tuple]:
    """Breadth-first search from every source variable over simple paths: (source node, category, variable, sink node, category,
    path). Sinks are recorded and not passed; sanitizers, of whatever kind, end a path; a search stops after MAX_PATHS."""
    said: dict[tuple[str, str], str | None] = {}

    def category(of: str, node: tuple) -> str | None:
        if node[1] == "FILE":
            return None
        key = (of, node[8])
        if key not in said:
            said[key] = _first(COMPILED[of], node[8])
        return said[key]

    read: dict[str, tuple[frozenset[str], list[str]]] = {}

    def names_of(code: str) -> tuple[frozenset[str], list[str]]:
        if code not in read:
            read[code] = frozenset(IDENT.findall(code)), result_variables(code)
        return read[code]

    out_edges = defaultdict(list)
    for _, kind, src, dst, label, _ in g.edges:
        out_edges[src].append((kind, dst, label))
    by_id = {n[0]: n for n in g.nodes}
    found, seen = [], set()
    for n in g.nodes:
        source = category("source", n)
        if not source:
            continue
        names = result_variables(n[8]) or IDENT.findall(n[8])
        for var in dict.fromkeys(names):
            if var in IGNORED or len(var) > 50:
                continue
            queue, got = deque([((n[0],), var)]), 0
            while queue and got < MAX_PATHS:
                path, v = queue.popleft()
                if len(path) > MAX_DEPTH:
                    continue
                here = by_id[path[-1]]
                sink = category("sink", here)
                if sink and (len(path) == 1 or v in names_of(here[8])[0]):
                    got += 1
                    key = (n[4], var, here[4], sink)
                    if key not in seen and not shapes.safe_sink(sink, here[8]):
                        seen.add(key)
                        found.append((n, source, var, here, sink, path))
                    continue
                if category("sanitizer", here):
                    continue
                for kind, dst, label in out_edges[path[-1]]:
                    if dst not in path and (nv := follow(kind, label, by_id[dst], v, *names_of(by_id[dst][8]))) is not None:
                        queue.append(((*path, dst), nv))
    return found


def sanitizers_on(g: Builder, path: tuple) -> list[str]:
    """Kinds of the sanitizers that the nodes of a path meet."""
    by_id = {n[0]: n for n in g.nodes}
    return [c for p in path if (c := _first(COMPILED["sanitizer"], by_id[p][8]))]


def confidence(length: int, source: str) -> str:
    c = "certain" if length <= 2 else "high" if length <= 4 else "medium" if length <= 7 else "low"
    return {"certain": "high", "high": "medium", "medium": "low", "low": "low"}[c] if source == "environment" else c


TAINT = "file string, rule_id string, source_line int, source string, variable string, line int, sink string, path array<string>, snippet string, confidence string, fp_risk string, seq bigint"
#: Sink category -> (severity, weakness).
SINK_OUTCOME = {
    "sql": ("critical", "CWE-89"), "command-exec": ("critical", "CWE-78"), "code-exec": ("critical", "CWE-94"), "xss": ("high", "CWE-79"), "ssrf": ("high", "CWE-918"),
    "redirect": ("medium", "CWE-601"), "file-write": ("high", "CWE-22"), "file-op": ("high", "CWE-22"), "deserialization": ("critical", "CWE-502"),
}


def taint(files: DataFrame) -> DataFrame:
    """Tainted paths per file: the graph is built and searched where the file lies."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for piece in pieces(batches):
            for f, e, t, base in zip(*piece, strict=True):
                # without a source no path begins, whatever the graph
                if not any(possible(needed, t or "") for needed in SOURCE_NEEDS):
                    continue
                g = build_file(f, e, t or "", base)
                by_id = {n[0]: n for n in g.nodes}
                for i, (n, source, var, sink, cat, path) in enumerate(taint_paths(g)):
                    codes = [by_id[p][8][:60] for p in path]
                    yield f, f"cpg-{cat}", n[4], source, var, sink[4], cat, codes, " -> ".join(codes), confidence(len(path), source), "medium" if len(path) > 3 else "low", i

    s, i = pa.string(), pa.int32()
    types, names = [s, s, i, s, s, i, s, pa.list_(s), s, s, s, pa.int64()], [x.split()[0] for x in TAINT.split(", ")]
    return mapped(_numbered(files), lambda batches: batched(found(batches), types, names), TAINT)


def findings(paths: DataFrame) -> DataFrame:
    from ..functions.scalar import look_up

    return paths.select(
        "rule_id", F.concat(F.lit("Tainted "), "sink").alias("title"), look_up(F.col("sink"), {k: v[0] for k, v in SINK_OUTCOME.items()}, "high").alias("severity"), "confidence",
        F.format_string("%s data in %s reaches a %s sink over %d steps", "source", "variable", "sink", F.size("path")).alias("message"), "file", "line", F.lit(0).alias("col"), "snippet",
        F.lit("Validate or escape the value before it is used.").alias("recommendation"), look_up(F.col("sink"), {k: v[1] for k, v in SINK_OUTCOME.items()}, "CWE-20").alias("cwe"),
        F.struct("source", F.array("sink").alias("sinks"), F.array("variable").alias("variable_chain"), F.array().cast("array<string>").alias("sanitizers"), "confidence").alias("taint"),
        "fp_risk", F.lit("cpg").alias("engine"), "seq",
    )


def reach_stats(paths: DataFrame) -> DataFrame:
    """One row over taint(): paths, sinks that a source reaches, and the mean number of steps."""
    return paths.agg(F.count("*").alias("paths"), F.count_distinct("file", "line", "sink").alias("reachable_sinks"), F.coalesce(F.avg(F.size("path")), F.lit(0.0)).alias("mean_length"))


def dangerous_calls(n: DataFrame, regex: str, category: str) -> DataFrame:
    """Call sites of a pattern without those of a safe shape."""

    @F.pandas_udf("boolean")
    def safe(codes: pd.Series) -> pd.Series:
        return pd.Series([shapes.safe_sink(category, code or "") for code in codes], dtype=bool)

    return n.where((F.col("type") == "CALL_SITE") & F.col("code").rlike(regex)).where(~safe("code"))
