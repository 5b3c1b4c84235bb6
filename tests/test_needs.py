"""What patterns need of a text, pieces of batches, and how generated files are dealt out."""

import re

import pyarrow as pa
import pytest

from quarrylight.functions import cvss
from quarrylight.functions.needs import BATCH_BYTES, BATCH_ROWS, batched, clauses, pieces, possible
from quarrylight.functions.scalar import fixed_rows
from quarrylight.operators import deps, findings, lexer, match
from quarrylight.plans import queries
from quarrylight.plans.scan import conformed
from quarrylight.sources import files as sources


@pytest.mark.parametrize(
    ("regex", "flags", "text"),
    [
        (r"\b(?:exec|execSync)\(\s*`[^`]*\$\{", re.I | re.A, "EXECsync( `a ${"),
        (r"a(?:b|)c", re.A, "ac"), (r"a(?:bc)?d", re.A, "ad"), (r"(?:xy){2}z", re.A, "xyxyz"), (r"a(?=b)b", re.A, "ab"), (r"a(?!c)b", re.A, "ab"), (r"(?i:A)b", re.A, "ab"), (r"k", re.I, "K"), (r"É", re.I | re.A, "É"), (r"", 0, ""),
    ],
)
def test_what_matches_is_possible(regex, flags, text):
    assert re.search(regex, text, flags)
    assert possible(clauses(regex, flags), text.lower() if flags & re.I else text)


def test_texts_without_what_is_needed_are_not_tried():
    assert not possible(clauses(r"\b(?:exec|spawn)\([^)]*req", re.I | re.A), "spawn(a)")
    assert not possible(clauses(r"md5|sha1", re.A), "sha256")


def test_pieces_are_bounded_by_rows_and_bytes():
    rows = ["x" * n for n in (10, 10, 50, 1, 1, 1, 1, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(rows), pa.array(range(9))], names=["t", "i"])
    got = list(pieces([batch], rows=3, size=30))
    assert [x for p in got for x in p[0]] == rows and [x for p in got for x in p[1]] == list(range(9))
    assert [len(p[0]) for p in got] == [2, 1, 3, 3]


def test_spans_carry_on_over_lines():
    lines = ["a = /[/]x/ / b; // c", "/* 'd", "e */ \"f\\\"g\" `h", "i ${j}` 'k", "l = 1 / 2 / 3"]
    assert lexer.spans(lines, "c-like") == [[(4, 10, "re"), (16, 20, "cmt")], [(0, 5, "cmt")], [(0, 4, "cmt"), (5, 11, "str"), (12, 14, "tpl")], [(0, 7, "tpl"), (8, 10, "str")], []]


def test_modules_are_dealt_out_by_their_number(spark, tmp_path, monkeypatch):
    spark.range(1000).selectExpr("id p_partkey", "cast(id % 50 as int) p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    assert queries.modules(spark, str(tmp_path)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    monkeypatch.setattr(queries, "MODULES_A_TASK", 50)
    m = queries.modules(spark, str(tmp_path))
    assert m.rdd.getNumPartitions() == 20 and m.distinct().count() == 1000


@pytest.mark.parametrize(("n", "text"), [(3000, "a@b.cc"), (1200, "x " * 10_000 + "a@b.cc")])
def test_scans_are_handed_small_batches(spark, monkeypatch, n, text):
    """By Spark's defaults a task's rows come as one batch here."""
    for k in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{k}")
    inner, rows, size = pieces, BATCH_ROWS, BATCH_BYTES + 100_000

    def checked(batches):
        for batch in batches:
            assert batch.num_rows <= rows and batch.nbytes <= size, (batch.num_rows, batch.nbytes)
            yield from inner([batch])

    monkeypatch.setattr(match, "pieces", checked)
    files = sources.of_table(spark.range(0, n, 1, 1).selectExpr("id", f"concat('{text}', id % 10) text"), queries.F.format_string("doc/%d.txt", "id"), "text")
    assert match.custom_rules(files, list(queries.USER_RULES)).where("rule_id = 'email-address'").select("file").distinct().count() == n


def test_many_findings_of_one_text_leave_in_small_batches(monkeypatch):
    got = {}
    monkeypatch.setattr(match, "mapped", lambda df, run, schema: got.update(run=run))

    class Files:
        def select(self, *_):
            return self

    match.custom_rules(Files(), list(queries.USER_RULES))
    text = "\n".join(f"user{i}@mail.example" for i in range(2500))
    one = pa.RecordBatch.from_arrays([pa.array([x]) for x in ("doc/1.txt", "1.txt", ".txt", text)], names=["file", "basename", "ext", "content"])
    out = list(got["run"](iter([one])))
    assert [b.num_rows for b in out] == [1000, 1000, 500]
    assert [x for b in out for x in b.column(6).to_pylist()] == list(range(1, 2501)) and [x for b in out for x in b.column(19).to_pylist()] == list(range(2500))
    assert not list(batched([], [pa.int64()], ["a"]))


def test_fixed_tables_start_no_python(spark):
    rows = [("a", (1.5, "x"), ["p", None]), ("b", None, []), (None, (None, None), None)]
    got = fixed_rows(spark, rows, "k string, s struct<v:double,w:string>, l array<string>")
    assert [tuple(tuple(x) if isinstance(x, tuple) else x for x in r) for r in got.collect()] == rows
    scored = findings.enrich(conformed(spark.range(1).selectExpr("'sql-injection' rule_id", "'CWE-89' cwe")))
    assert tuple(scored.first()["cvss"]) == cvss.score(cvss.DEFAULT_VECTORS["sql-injection"])
    for df in (got, scored, deps.offline_advisories(spark)):
        assert "ExistingRDD" not in df._jdf.queryExecution().executedPlan().toString()
