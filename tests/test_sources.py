"""Walks that meet what real folders hold, secrets at every place, state that outlives a broken write."""

import subprocess

import pytest
from pyspark.sql import functions as F

from quarrylight import api
from quarrylight.functions import cvss, scalar
from quarrylight.operators import catalog, findings, secrets, structural
from quarrylight.plans import diff, incremental
from quarrylight.plans.scan import ScanOptions
from quarrylight.sources import files, state

FAST = ScanOptions(taint=False, deps=False, entropy=False)
PNG = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR\xff\xfe"


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.js").write_text("el.innerHTML = x;\n")
    (tmp_path / "src" / "old.js").write_bytes(b"// caf\xe9\nel.innerHTML = y;\n")
    (tmp_path / "logo.png").write_bytes(PNG)
    (tmp_path / "Rakefile").write_text("task :a\n")
    (tmp_path / "node_modules" / "b.js").write_text("el.innerHTML = z;\n")
    return tmp_path


def test_a_folder_with_binary_files(spark, tree):
    got = {r.basename: r.content for r in files.of_directory(spark, str(tree)).collect()}
    assert set(got) == {"a.js", "old.js", "Rakefile"} and got["old.js"].startswith("// caf�\n")
    assert {r.basename for r in files.of_directory(spark, str(tree), extensions=[".js"]).collect()} == {"a.js", "old.js", "Rakefile"}
    named = files.of_paths(spark, [str(tree / "logo.png"), str(tree / "node_modules" / "b.js"), str(tree / "nothing.js")])
    assert [r.basename for r in named.collect()] == ["b.js"]
    assert {(r.file.rsplit("/", 1)[-1], r.line) for r in api.scan_paths(spark, [str(tree)], FAST).where("rule_id = 'xss'").collect()} == {("a.js", 1), ("old.js", 2)}


def test_a_diff_walks_both_sides_alike(spark, tree):
    def git(*args):
        subprocess.run(["git", "-C", str(tree), "-c", "user.name=t", "-c", "user.email=t@localhost", *args], check=True, capture_output=True)

    git("init", "-q")
    git("add", "-f", ".")
    git("commit", "-qm", "one")
    assert {r.file for r in files.of_revision(spark, str(tree), "HEAD").collect()} == {"src/a.js", "src/old.js", "Rakefile"}
    assert {r.file for r in files.of_revision(spark, str(tree / "src"), "HEAD", max_size=20).collect()} == {"a.js"}
    assert {r.classification for r in api.diff(spark, str(tree), "HEAD", FAST).collect()} == {"persisted"}
    (tree / "src" / "a.js").write_text("el.textContent = x;\n")
    assert [r.file for r in files.changed_files(spark, str(tree / "src")).collect()] == [f"{tree}/src/a.js"]
    assert [(r.file, r.classification) for r in api.diff(spark, str(tree), "HEAD", FAST).collect() if r.classification != "persisted"] == [("src/a.js", "resolved")]


def test_secrets_at_every_place(spark):
    secret = "aB3dE5gH7jK9mN1pQ2rS4tU6vW8x"
    text = f"// one\nconst token = \"{secret}\";\nconst b = 'x' + `\n` + \"{secret}\"; const c = \"{secret}\";\n"
    found = secrets.findings(files.of_rows(spark, [("src/a.js", text), ("src/b.js", "no secret")]))
    places = {(r.line, r.col) for r in found.where("rule_id <> 'entropy-password'").collect()}
    lines = text.split("\n")
    expected = {(i + 1, j + 1) for i, t in enumerate(lines) for j in range(len(t)) if t.startswith(f'"{secret}"', j)}
    assert places == expected and len(expected) == 3
    assert {(r.line, r.col) for r in found.where("rule_id = 'entropy-password'").collect()} == {(2, 7)}


def test_hits_are_placed_as_by_hand(spark):
    text = 'a "bc" d\n\n"ef\n" `x\ny` "g"\n"h"'
    regex = r"\"[^\"]*\"|`[^`]*`"
    import re

    expected = []
    for m in re.finditer(regex, text):
        before = text[: m.start()]
        expected.append((m[0], before.count("\n") + 1, m.start() - before.rfind("\n")))
    got = secrets.hits(files.of_rows(spark, [("f.js", text)]), regex, placed=True).orderBy("seq").collect()
    assert [(r.hit, r.line, r.col) for r in got] == expected


def test_state_is_the_old_table_or_the_new_one(spark, tmp_path):
    path = str(tmp_path / "table")
    assert state.read(spark, path, "a int").count() == 0
    for n in range(4):
        state.replace(spark.range(n).select(F.col("id").cast("int").alias("a")).unionByName(state.read(spark, path, "a int")), path)
    assert state.read(spark, path, "a int").count() == 6
    (tmp_path / "table" / "v-broken").mkdir()  # a write that never ended
    assert state.read(spark, path, "a int").count() == 6
    (tmp_path / "table" / state.POINTER).write_text("v-gone")
    with pytest.raises(Exception):
        state.read(spark, path, "a int").count()


def test_any_edit_of_a_rule_is_another_catalog(monkeypatch):
    import dataclasses

    before = incremental.rules_hash(FAST)
    rule = catalog.RULES[0]
    for field, value in (("confidence", "low"), ("cwe", "CWE-1"), ("severity", "info")):
        monkeypatch.setattr(catalog, "RULES", [dataclasses.replace(rule, **{field: value}), *catalog.RULES[1:]])
        assert incremental.rules_hash(FAST) != before, field
    monkeypatch.setattr(catalog, "RULES", [dataclasses.replace(rule, patterns=(dataclasses.replace(rule.patterns[0], fp_risk="high" if rule.patterns[0].fp_risk != "high" else "low"), *rule.patterns[1:])), *catalog.RULES[1:]])
    assert incremental.rules_hash(FAST) != before


def test_prose_words_are_taken_without_signs(spark):
    rows = [("the, and.",), ("xx the, and.",), ("a1b2 c3d4 e5f6",), (" with (this)",)]
    got = [r.p for r in spark.createDataFrame(rows, "t string").select(scalar.is_prose(F.col("t")).alias("p")).collect()]
    assert got == [False, True, False, True]


def test_scores_and_categories_of_the_fixed_tables():
    assert cvss.score(cvss.DEFAULT_VECTORS["xss"])[0] == 6.1 and cvss.score(cvss.DEFAULT_VECTORS["sql-injection"])[0] == 9.8
    assert cvss.score(cvss.DEFAULT_VECTORS["clickjacking"])[0] == 5.4 and "docker-root" in cvss.DEFAULT_VECTORS
    assert cvss.CWE_OWASP["CWE-117"] == "A09" and cvss.CWE_OWASP["CWE-434"] == "A04" and cvss.CWE_OWASP["CWE-1395"] == "A06"


def test_rules_are_numbered_in_the_order_of_the_report(spark):
    rows = [("b.js", "xss", "high", 3, 0), ("a.js", "csrf", "medium", 1, 0), ("c.js", "sql-injection", "critical", 9, 0), ("a.js", "xss", "high", 7, 1)]
    f = spark.createDataFrame([(r, f, s, n, q, "x = 1") for f, r, s, n, q in rows], "rule_id string, file string, severity string, line int, seq long, snippet string")
    got = {(r.rule_id, r.file): (r.rule_index, r.occurrence) for r in findings.rule_index(f).collect()}
    assert {k: v[0] for k, v in got.items()} == {("sql-injection", "c.js"): 0, ("xss", "a.js"): 1, ("xss", "b.js"): 1, ("csrf", "a.js"): 2}


def test_matching_of_a_diff_is_greedy(spark):
    schema = "file string, rule_id string, line int, severity string, seq long"
    before = spark.createDataFrame([("f", "r", 10, "high", 0), ("f", "r", 14, "low", 1), ("f", "r", 90, "low", 2), ("f", "r", 90, "low", 3), ("g", "r", 1, "low", 0)], schema)
    after = spark.createDataFrame([("f", "r", 13, "high", 0), ("f", "r", 14, "high", 1), ("f", "r", 40, "low", 2), ("h", "r", 1, "low", 0)], schema)
    got = {(r.file, r.line, r.before_line, r.classification) for r in diff.compare(before, after).collect()}
    assert got == {("f", 13, 14, "worsened"), ("f", 14, 10, "persisted"), ("f", 40, None, "introduced"), ("f", None, 90, "resolved"), ("g", None, 1, "resolved"), ("h", 1, None, "introduced")}


def test_an_argument_list_of_many_lines(spark):
    inner = "".join(f"  // {k}\n" for k in range(40))
    text = "db.query(\n" + inner + "  `SELECT * FROM t WHERE id = ${id}`\n);\n"
    found = structural.structural(files.of_rows(spark, [("src/a.js", text)])).collect()
    assert any(r.rule_id == "sql-injection" and r.line == 1 for r in found)


def test_advisories_of_a_table_and_a_patch_that_is_scanned_again(spark, tmp_path):
    import json

    (tmp_path / "package.json").write_text('{"dependencies": {"ownpackage": "1.0.0"}}')
    (tmp_path / "advisories.jsonl").write_text(json.dumps({"ecosystem": "npm", "pkg": "ownpackage", "id": "OWN-1", "aliases": [], "summary": "Authentication bypass", "cvss": 8.0, "fixed_version": "1.0.1"}) + "\n")
    table = api.read_advisories(spark, str(tmp_path / "advisories.jsonl"))
    found = api.scan_paths(spark, [str(tmp_path / "package.json")], ScanOptions(taint=False, entropy=False), advisories=table).collect()
    assert [(r.rule_id, r.severity, r.cwe) for r in found] == [("dep-cve", "high", "CWE-287")]
    (tmp_path / "a.js").write_text("const a = 1;\nel.innerHTML = x;\n")
    done = api.apply_fix(str(tmp_path / "a.js"), "el.innerHTML = x;", "el.textContent = x;", 2, spark)
    assert done["line"] == 2 and done["remaining"] == 0
