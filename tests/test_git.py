"""Revisions and changed files of a throwaway repository."""

import subprocess

from quarrylight import api
from quarrylight.plans.scan import ScanOptions
from quarrylight.sources import files


def test_git(spark, tmp_path):
    def git(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@localhost", *args], check=True, capture_output=True)

    git("init", "-q")
    (tmp_path / "a.js").write_text("el.innerHTML = x;\n")
    (tmp_path / "b.js").write_text("const a = 1;\n")
    git("add", ".")
    git("commit", "-qm", "one")
    (tmp_path / "a.js").write_text("const b = 2;\n")
    (tmp_path / "b.js").write_text("exec(`ls ${d}`);\n")
    assert files.is_repository(str(tmp_path)) and files.resolve_revision(str(tmp_path), "HEAD") and not files.resolve_revision(str(tmp_path), "nothing")
    assert files.changed_files(spark, str(tmp_path)).count() == 2
    d = api.diff(spark, str(tmp_path), "HEAD", ScanOptions(taint=False, deps=False, entropy=False))
    got = {(r.file, r.rule_id, r.classification) for r in d.collect()}
    assert ("a.js", "xss", "resolved") in got and ("b.js", "command-injection", "introduced") in got
