"""Dominators, static single assignment, points-to sets and function summaries over tables of instructions.

Tables: blocks(fn, block, succ array<int>), the entry being the least block; instr(fn, block, seq, op, dest, args array<string>).
Per-function algorithms run in one Python call per function; what crosses functions (points-to, closures) runs as joins.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.state import checkpoint


def reverse_postorder(succ: dict[int, list[int]], entry: int) -> list[int]:
    order, seen, stack = [], {entry}, [(entry, iter(succ.get(entry, [])))]
    while stack:
        node, it = stack[-1]
        for s in it:
            if s not in seen:
                seen.add(s)
                stack.append((s, iter(succ.get(s, []))))
                break
        else:
            order.append(node)
            stack.pop()
    return order[::-1]


def immediate_dominators(succ: dict[int, list[int]], entry: int) -> dict[int, int]:
    """Nearest dominators of reachable blocks, the entry its own."""
    order = reverse_postorder(succ, entry)
    place = {b: i for i, b in enumerate(order)}
    preds = defaultdict(list)
    for b in order:
        for s in succ.get(b, []):
            preds[s].append(b)
    idom = {entry: entry}
    changed = True
    while changed:
        changed = False
        for b in order[1:]:
            known = [p for p in preds[b] if p in idom]
            new = known[0]
            for p in known[1:]:
                a, c = p, new
                while a != c:
                    while place[a] > place[c]:
                        a = idom[a]
                    while place[c] > place[a]:
                        c = idom[c]
                new = a
            if idom.get(b) != new:
                idom[b] = new
                changed = True
    return idom


def frontiers(succ: dict[int, list[int]], idom: dict[int, int]) -> dict[int, set[int]]:
    preds = defaultdict(list)
    for b in idom:
        for s in succ.get(b, []):
            preds[s].append(b)
    out: dict[int, set[int]] = {b: set() for b in idom}
    for b in idom:
        entry = idom[b] == b  # is entered from outside, too
        if len(preds[b]) > 1 or entry:
            for p in preds[b]:
                while entry or p != idom[b]:
                    out[p].add(b)
                    if p == idom[p]:
                        break
                    p = idom[p]
    return out


def dominators(blocks: DataFrame) -> DataFrame:
    """(fn, block, idom, frontier) of the blocks that the entry reaches."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        succ = {int(b): [int(x) for x in s] for b, s in zip(pdf["block"], pdf["succ"], strict=True)}
        idom = immediate_dominators(succ, min(succ))
        df = frontiers(succ, idom)
        return pd.DataFrame([(pdf["fn"].iloc[0], b, idom[b], sorted(df[b])) for b in sorted(idom)], columns=["fn", "block", "idom", "frontier"])

    return blocks.groupBy("fn").applyInPandas(run, "fn string, block int, idom int, frontier array<int>")


def variables(instr: DataFrame) -> DataFrame:
    """(fn, var, def_blocks, use_blocks)."""
    d = instr.where("dest is not null").select("fn", F.col("dest").alias("var"), F.col("block").alias("d"), F.lit(None).cast("int").alias("u"))
    u = instr.select("fn", F.explode("args").alias("var"), F.lit(None).cast("int").alias("d"), F.col("block").alias("u"))
    return d.unionByName(u).groupBy("fn", "var").agg(F.array_sort(F.collect_set("d")).alias("def_blocks"), F.array_sort(F.collect_set("u")).alias("use_blocks"))


SSA = "fn string, block int, seq int, op string, dest string, args array<string>"


def build_ssa(pdf: pd.DataFrame, succ: dict[int, list[int]]) -> list[tuple]:
    """Instructions in single assignment form, phis first (seq below 0). Uses without a definition keep version 0."""
    entry = min(succ)
    idom = immediate_dominators(succ, entry)
    df = frontiers(succ, idom)
    code: dict[int, list] = {b: [] for b in idom}
    for r in pdf.sort_values(["block", "seq"]).itertuples():
        if int(r.block) in code:
            code[int(r.block)].append((int(r.seq), r.op, r.dest if isinstance(r.dest, str) else None, list(r.args if r.args is not None else [])))
    defs = defaultdict(set)
    for b, ins in code.items():
        for _, _, dest, _ in ins:
            if dest:
                defs[dest].add(b)
    phis: dict[int, dict[str, list]] = {b: {} for b in idom}
    for var in sorted(defs):
        work = sorted(defs[var])
        while work:
            for f in sorted(df[work.pop()]):
                if var not in phis[f]:
                    phis[f][var] = []
                    if f not in defs[var]:
                        work.append(f)
    preds = defaultdict(list)
    for b in idom:
        for s in succ.get(b, []):
            preds[s].append(b)
    children = defaultdict(list)
    for b in sorted(idom):
        if b != entry:
            children[idom[b]].append(b)
    count, stack = defaultdict(int), defaultdict(list)

    def fresh(v):
        count[v] += 1
        stack[v].append(count[v])
        return f"{v}_{count[v]}"

    def current(v):
        return f"{v}_{stack[v][-1] if stack[v] else 0}"

    named: dict[int, dict[str, str]] = {b: {} for b in idom}
    out = []

    def rename(b):
        pushed = []
        for v in sorted(phis[b]):
            named[b][v] = fresh(v)
            pushed.append(v)
        for seq, op, dest, args in code[b]:
            args = [current(a) for a in args]
            if dest:
                pushed.append(dest)
                dest = fresh(dest)
            out.append((b, seq, op, dest, args))
        for s in succ.get(b, []):
            for v in phis.get(s, {}):
                phis[s][v].append((b, current(v)))
        return pushed

    todo: list = [(entry, False, None)]
    while todo:  # the dominator tree, without recursion
        b, leave, pushed = todo.pop()
        if leave:
            for v in pushed:
                stack[v].pop()
            continue
        pushed = rename(b)
        todo.append((b, True, pushed))
        todo.extend((c, False, None) for c in reversed(children[b]))
    for b in idom:
        for k, v in enumerate(sorted(phis[b])):
            out.append((b, k - len(phis[b]), "PHI", named[b][v], [x for _, x in sorted(phis[b][v])]))
    return sorted(out)


def ssa(instr: DataFrame, blocks: DataFrame) -> DataFrame:
    """Functions in single assignment form."""

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        succ = {int(b): [int(x) for x in s] for b, s in zip(right["block"], right["succ"], strict=True)}
        rows = [(key[0], *r) for r in build_ssa(left, succ)] if succ else []
        return pd.DataFrame(rows, columns=["fn", "block", "seq", "op", "dest", "args"])

    return instr.groupBy("fn").cogroup(blocks.groupBy("fn")).applyInPandas(run, SSA)


def def_use(s: DataFrame) -> DataFrame:
    """(fn, var, def_block, def_seq, use_block, use_seq): each use with its definition; uses without one have nulls."""
    d = s.where("dest is not null").select("fn", F.col("dest").alias("var"), F.col("block").alias("def_block"), F.col("seq").alias("def_seq"))
    u = s.select("fn", F.explode("args").alias("var"), F.col("block").alias("use_block"), F.col("seq").alias("use_seq"))
    return u.join(d, ["fn", "var"], "left")


def flows(s: DataFrame) -> DataFrame:
    """Edges (fn, src, dst) from each argument to the result of its instruction."""
    return s.where("dest is not null").select("fn", F.explode("args").alias("src"), F.col("dest").alias("dst")).distinct()


def taint_closure(edges: DataFrame, start: DataFrame, rounds: int = 200) -> DataFrame:
    """(fn, origin, var): variables that each of start(fn, var) reaches over edges(fn, src, dst); new pairs only go on."""
    reached = checkpoint(start.select("fn", F.col("var").alias("origin"), "var").distinct())
    new = reached
    for _ in range(rounds):
        step = new.join(edges, (new["fn"] == edges["fn"]) & (new["var"] == edges["src"])).select(new["fn"], "origin", F.col("dst").alias("var")).distinct()
        new = checkpoint(step.join(reached, ["fn", "origin", "var"], "left_anti"))
        if new.limit(1).count() == 0:
            return reached
        reached = checkpoint(reached.unionByName(new))
    raise RuntimeError("the closure did not settle")


def constraints(instr: DataFrame) -> DataFrame:
    """(kind, lhs, rhs): addr, copy, load and store constraints of instructions; names carry their function."""
    v = lambda c: F.concat_ws(".", "fn", c)
    alloc = F.concat_ws("#", F.lit("alloc"), "fn", "block", "seq")
    first = F.get("args", F.lit(0))

    def row(kind, lhs, rhs):
        return F.struct(F.lit(kind).alias("kind"), lhs.alias("lhs"), rhs.alias("rhs"))

    parts = (
        F.when((F.col("op") == "ASSIGN") & (F.size("args") > 0), F.array(row("copy", v("dest"), v(first))))
        .when(F.col("op").isin("ASSIGN", "LITERAL", "NEW"), F.array(row("addr", v("dest"), alloc)))
        .when((F.col("op") == "CALL") & F.col("dest").isNotNull(), F.array(row("addr", v("dest"), F.concat(F.lit("ret_"), alloc))))
        .when(F.col("op") == "LOAD_PROP", F.array(row("load", v("dest"), v(first))))
        .when(F.col("op") == "STORE_PROP", F.array(row("store", v(first), v(F.get("args", F.lit(1))))))
        .when(F.col("op") == "PHI", F.transform("args", lambda a: row("copy", F.concat_ws(".", F.col("fn"), F.col("dest")), F.concat_ws(".", F.col("fn"), a))))
    )
    return instr.select(F.explode(parts).alias("c")).select("c.*").distinct()


#: Constraints that one task of a join takes.
TASK_ROWS = 1_000_000


def points_to(c: DataFrame, rounds: int = 200) -> DataFrame:
    """(var, alloc): least inclusion-based solution. Each round joins the new pairs only."""
    of = lambda k: c.where(F.col("kind") == k)
    # constraints are read once; every round's join then reads what was written
    copy = checkpoint(of("copy").select(F.col("rhs").alias("src"), F.col("lhs").alias("dst")).distinct())
    load, store = of("load"), of("store")
    parts = max(int(c.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-copy.count() // TASK_ROWS))
    pts = of("addr").select(F.col("lhs").alias("var"), F.col("rhs").alias("alloc"))
    pts = checkpoint(pts.union(pts.select(F.col("alloc"), F.col("alloc"))).distinct())
    for _ in range(rounds):
        loads = load.join(pts, load["rhs"] == pts["var"]).select(F.col("alloc").alias("src"), F.col("lhs").alias("dst"))
        stores = store.join(pts, store["lhs"] == pts["var"]).select(F.col("rhs").alias("src"), F.col("alloc").alias("dst"))
        e = copy.union(loads).union(stores).distinct()
        e, held = e.repartition(parts, "src"), pts.repartition(parts, "var")
        step = e.join(held, e["src"] == held["var"]).select(F.col("dst").alias("var"), "alloc").distinct()
        new = checkpoint(step.join(pts, ["var", "alloc"], "left_anti"))
        if new.limit(1).count() == 0:
            return pts
        pts = checkpoint(pts.unionByName(new))
    raise RuntimeError("points-to sets did not settle")


def may_alias(pts: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(a, b) with alias: do their points-to sets meet?"""
    sets = pts.groupBy("var").agg(F.collect_set("alloc").alias("s"))
    j = pairs.join(sets.select(F.col("var").alias("a"), F.col("s").alias("sa")), "a", "left").join(sets.select(F.col("var").alias("b"), F.col("s").alias("sb")), "b", "left")
    return j.select("a", "b", F.coalesce(F.arrays_overlap("sa", "sb"), F.lit(False)).alias("alias"))


def summaries(s: DataFrame, params: DataFrame) -> DataFrame:
    """Per function: what becomes of each parameter (propagates, sanitizes, blocks), whether the result is tainted, which sinks are
    reached and whether it is pure. params(fn, idx, var): first versions. Instructions RETURN, SINK:<kind> and SANITIZE count."""
    reach = taint_closure(flows(s), params.select("fn", "var"))
    use = s.select("fn", "op", F.explode("args").alias("var")).distinct()
    hit = reach.join(use, ["fn", "var"], "left").groupBy("fn", F.col("origin").alias("var")).agg(
        F.coalesce(F.max(F.col("op") == "RETURN"), F.lit(False)).alias("returns"),
        F.coalesce(F.max(F.col("op") == "SANITIZE"), F.lit(False)).alias("cleans"),
        F.array_sort(F.collect_set(F.when(F.startswith("op", F.lit("SINK:")), F.substr("op", F.lit(6))))).alias("sinks"),
    )
    p = params.join(hit, ["fn", "var"], "left")
    effect = F.when(F.size("sinks") > 0, "propagates").when(F.col("cleans") & ~F.col("returns"), "sanitizes").when(~F.coalesce("returns", F.lit(False)), "blocks").otherwise("propagates")
    return p.groupBy("fn").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("idx").cast("int"), effect)))).alias("params"),
        F.max(F.coalesce("returns", F.lit(False))).alias("return_tainted"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("sinks")))).alias("sinks"),
        (F.max(F.size("sinks")) <= 0).alias("pure"),
    )


def resolve_summary(calls: DataFrame, known: DataFrame) -> DataFrame:
    """calls(callee, idx) with whether taint passes; by name or the last part of it; unknown functions pass it on."""
    k = known.select(F.element_at(F.split("fn", r"\."), -1).alias("short"), "fn", "params").groupBy("short").agg(F.min_by("params", "fn").alias("params"))
    j = calls.withColumn("short", F.element_at(F.split("callee", r"\."), -1)).join(k, "short", "left")
    return j.select("callee", "idx", F.coalesce(F.element_at("params", F.col("idx").cast("int")) == "propagates", F.lit(True)).alias("passes"))


SUMMARIES = "fn string, params map<int,string>, return_tainted boolean, sinks array<string>, pure boolean"


def write_summaries(known: DataFrame, path: str) -> None:
    known.write.mode("overwrite").json(path)


def read_summaries(spark, path: str) -> DataFrame:
    """Summaries of a former run; a missing or broken store counts as empty."""
    from ..sources.state import read

    return read(spark, path, SUMMARIES, "json")
