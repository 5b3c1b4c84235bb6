"""Incremental scans, verdicts, diffs, streams, single assignment."""

import pandas as pd
from pyspark.sql import functions as F

from quarrylight import api
from quarrylight.operators import callgraph, ssa, triage
from quarrylight.plans import diff, incremental
from quarrylight.plans.scan import ScanOptions, scan
from quarrylight.schema import FINDINGS, VERDICTS
from quarrylight.sources import files, state
from quarrylight.streaming import watch

FAST = ScanOptions(taint=False, deps=False, entropy=False)
BAD, WORSE, CLEAN = "el.innerHTML = x;\n", "el.innerHTML = x;\nexec(`ls ${d}`);\n", "const a = 1;\n"


def keys(df):
    return sorted((r.file, r.rule_id, r.line) for r in df.collect())


def test_incremental_equals_full(spark, tmp_path):
    folder = str(tmp_path / "state")
    for rows in ([("a.js", BAD), ("b.js", CLEAN)], [("a.js", BAD), ("b.js", WORSE), ("c.js", BAD)], [("b.js", CLEAN), ("c.js", BAD)]):
        f = files.of_rows(spark, rows)
        assert keys(incremental.scan_incremental(f, folder, FAST)) == keys(scan(f, FAST))
    todo = incremental.changes(f, state.read(spark, f"{folder}/manifest", incremental.MANIFEST), incremental.config_hash(FAST), incremental.rules_hash(FAST))
    assert {r.change for r in todo.collect()} == {"unchanged"}
    # findings that are lost are found again
    state.replace(spark.createDataFrame([], FINDINGS), f"{folder}/findings")
    assert keys(incremental.scan_incremental(f, folder, FAST)) == keys(scan(f, FAST))
    assert api.cache_stats(spark, folder).first().files == 2
    incremental.clear_cache(folder)
    assert api.cache_stats(spark, folder).first().files == 0


def test_other_configuration_scans_all(spark):
    f = files.of_rows(spark, [("a.js", BAD)])
    m = f.select("file", "sha256", F.lit("x").alias("config_hash"), F.lit("y").alias("rules_hash"))
    assert incremental.changes(f, m, "x", "y").first().change == "unchanged"
    assert incremental.changes(f, m, "x", "z").first().change == "added"


def test_triage(spark, tmp_path):
    f = spark.createDataFrame([("r", "a.js", 1, "high", "x = 1"), ("r", "a.js", 2, "low", "y"), ("r", "a.js", 3, "low", "z"), ("r", "b.js", 1, "low", "w")], "rule_id string, file string, line int, severity string, snippet string")
    k = {r.line: r for r in triage.keyed(f).where("file = 'a.js'").collect()}
    rows = [(k[1].finding_key, k[1].code_hash, False, "high", "not reachable at all", None), (k[2].finding_key, k[2].code_hash, True, "high", "it is reachable, see", "critical"), (k[3].finding_key, "old", False, None, "was wrong back then", None), ("", "x", None, None, "", None)]
    v = spark.createDataFrame(rows, "finding_key string, code_hash string, is_real boolean, review_confidence string, analysis string, adjusted_severity string").withColumns({"fix": F.lit(None).cast("string"), "triaged_by": F.lit("t"), "triaged_at": F.current_timestamp(), "seq": F.lit(1).cast("bigint")})
    folder = str(tmp_path)
    assert api.submit_verdicts(v, folder).count() == 1
    stored = api.read_verdicts(spark, folder)
    kept, counters = triage.apply(f, stored)
    assert {(r.file, r.line, r.severity, r.triage_state) for r in kept.collect()} == {("a.js", 2, "critical", "adjusted"), ("a.js", 3, "low", "stale"), ("b.js", 1, "low", "new")}
    assert {r.triage_state: r.n for r in counters.collect()} == {"false": 1, "adjusted": 1, "stale": 1, "new": 1}
    assert {(r.file, r.line) for r in triage.review_queue(f, stored).collect()} == {("a.js", 3), ("b.js", 1)}
    assert triage.stats(stored).first().total == 3
    # white space does not change a verdict's code
    same = triage.keyed(f.withColumn("snippet", F.concat(F.lit("  "), F.regexp_replace("snippet", " ", "   "))))
    assert {r.code_hash for r in same.collect()} == {r.code_hash for r in triage.keyed(f).collect()}
    assert state.read(spark, str(tmp_path / "nothing"), VERDICTS).count() == 0


def test_context(spark):
    f = spark.createDataFrame([("a", 2)], "file string, line int")
    assert triage.context(f, files.lines(files.of_rows(spark, [("a", "x\ny\nz\nw")])), 1).first().context == "  1: x\n> 2: y\n  3: z"


def test_diff(spark):
    def rows(*x):
        return spark.createDataFrame([("a.js", "r", line, sev, i) for i, (line, sev) in enumerate(x)], "file string, rule_id string, line int, severity string, seq bigint")

    d = diff.compare(rows((10, "high"), (50, "low"), (200, "low")), rows((12, "high"), (14, "high"), (55, "high")))
    assert sorted(r.classification for r in d.collect()) == ["introduced", "persisted", "resolved", "worsened"]
    s = diff.summary(d).first()
    assert (s.introduced, s.resolved, s.delta, s.label) == (1, 1, 0, "unchanged")
    assert "1 introduced" in diff.report(d)


def test_watch(spark, tmp_path):
    source, folder, seen = tmp_path / "events", str(tmp_path / "state"), []
    source.mkdir()

    def run(*events):
        pd.DataFrame(events, columns=["path", "event", "content", "at"]).assign(at=lambda d: pd.to_datetime(d["at"])).to_json(source / f"{len(list(source.iterdir()))}.json", orient="records", lines=True, date_format="iso")
        stream = spark.readStream.schema(watch.EVENTS).json(str(source))
        q = watch.watch(stream, folder, lambda df, n: seen.extend(map(tuple, df.collect())), FAST, once=True)
        q.awaitTermination()
        out = sorted((s, f, r) for f, _, r, s in seen)
        seen.clear()
        return out

    new = run(("a.js", "add", BAD, "2024-01-01"), ("b.js", "add", CLEAN, "2024-01-01"))
    assert {x[0] for x in new} == {"new"} and ("new", "a.js", "xss") in new
    again = run(("a.js", "change", CLEAN, "2024-01-02"), ("a.js", "change", WORSE, "2024-01-03"))
    assert ("unchanged", "a.js", "xss") in again and ("new", "a.js", "command-injection") in again
    gone = run(("a.js", "unlink", None, "2024-01-04"))
    assert {x[0] for x in gone} == {"resolved"}


def test_ssa_and_summaries(spark):
    blocks = spark.createDataFrame([("f", 0, [1, 2]), ("f", 1, [3]), ("f", 2, [3]), ("f", 3, [])], "fn string, block int, succ array<int>")
    instr = spark.createDataFrame([("f", 0, 0, "LITERAL", "x", []), ("f", 1, 0, "ASSIGN", "x", ["p"]), ("f", 3, 0, "ASSIGN", "y", ["x"]), ("f", 3, 1, "RETURN", None, ["y"]), ("f", 3, 2, "SINK:sql", None, ["y"])], "fn string, block int, seq int, op string, dest string, args array<string>")
    s = ssa.ssa(instr, blocks).persist()
    phi = s.where("op = 'PHI'").collect()
    assert [(r.block, sorted(r.args)) for r in phi] == [(3, ["x_1", "x_2"])]
    assert s.where("dest is not null").groupBy("dest").count().where("count > 1").count() == 0
    got = ssa.summaries(s, spark.createDataFrame([("f", 0, "p_0"), ("f", 1, "q_0")], "fn string, idx int, var string")).first()
    assert got.params == {0: "propagates", 1: "blocks"} and got.return_tainted and got.sinks == ["sql"] and not got.pure
    calls = spark.createDataFrame([("m.f", 1), ("unknown", 0)], "callee string, idx int")
    known = ssa.summaries(s, spark.createDataFrame([("f", 0, "p_0"), ("f", 1, "q_0")], "fn string, idx int, var string"))
    assert {(r.callee, r.passes) for r in ssa.resolve_summary(calls, known).collect()} == {("m.f", False), ("unknown", True)}


def test_points_to(spark):
    c = spark.createDataFrame([("addr", "a", "o1"), ("addr", "v", "o2"), ("store", "a", "v"), ("copy", "b", "a"), ("load", "c", "b")], "kind string, lhs string, rhs string")
    pts = ssa.points_to(c)
    assert {(r.var, r.alloc) for r in pts.collect() if r.var in "abcv"} == {("a", "o1"), ("v", "o2"), ("b", "o1"), ("c", "o1"), ("c", "o2")}  # an allocation points to itself, too
    pairs = spark.createDataFrame([("a", "b"), ("a", "v"), ("c", "v")], "a string, b string")
    assert {(r.a, r.b): r.alias for r in ssa.may_alias(pts, pairs).collect()} == {("a", "b"): True, ("a", "v"): False, ("c", "v"): True}


def test_reachable(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(20)], "src int, dst int")
    assert callgraph.reachable(e).count() == 21 * 22 // 2
