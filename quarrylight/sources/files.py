"""Source corpora as tables of files: directories, tables, rows, revisions and changed files of a repository."""

from __future__ import annotations

import subprocess
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FILES

MAX_SIZE = 10 * 1024 * 1024
#: Folders and name patterns that are left out unless named explicitly.
EXCLUDED = (
    "node_modules .git .svn .hg dist build out target vendor bower_components __pycache__ .venv venv env .tox .mypy_cache "
    ".pytest_cache .next .nuxt .cache coverage .nyc_output .gradle .idea .vscode tmp .terraform *.min.js *.min.css *.bundle.js "
    "*.map *.lock"
).split()
#: Names that are read whatever the extensions asked for.
SPECIAL = ("dockerfile", ".dockerfile", ".dockerignore", "makefile", "jenkinsfile", "gemfile", "rakefile", "pipfile", "vagrantfile")


def _columns(path: Column, content: Column, size: Column) -> list[Column]:
    base = F.regexp_extract(path, r"([^/\\]*)$", 1)
    ext = F.when(base.rlike(r".\.[^.]*$"), F.lower(F.regexp_extract(base, r"(\.[^.]*)$", 1))).otherwise("")
    return [path.alias("file"), base.alias("basename"), ext.alias("ext"), content.alias("content"), size.cast("bigint").alias("size"), F.sha2(content, 256).alias("sha256")]


def excluded(path: Column, patterns: Iterable[str], root: str = "") -> Column:
    """Is a path below root excluded? A pattern with a star is matched against the name, a plain one against any component.
    Only the part below root counts, so that an explicitly named root may lie in an excluded folder."""
    import re

    below = F.when(F.startswith(path, F.lit(root)), F.substr(path, F.lit(len(root) + 1))).otherwise(path) if root else path
    parts = F.split(F.replace(below, F.lit("\\"), F.lit("/")), "/")
    plain = [p for p in patterns if "*" not in p]
    out = F.exists(parts, lambda x: x.isin(plain)) if plain else F.lit(False)
    for p in patterns:
        if "*" in p:
            out = out | F.element_at(parts, -1).rlike(".*".join(map(re.escape, p.split("*"))))
    return out


def chosen(path: Column, size: Column, root: str, extensions: Iterable[str] = (), exclude: Iterable[str] = (), max_size: int = MAX_SIZE) -> Column:
    """Is a file below root read? Every walk, of a folder or of a revision, asks this."""
    base = F.lower(F.regexp_extract(path, "([^/]*)$", 1))
    keep = (size <= max_size) & ~excluded(path, [*EXCLUDED, *exclude], root)
    exts = [e.lower() for e in extensions]
    return keep & (F.regexp_extract(base, r".(\.[^.]*)$", 1).isin(exts) | base.isin(list(SPECIAL))) if exts else keep


def text_of(content: Column) -> Column:
    """Bytes as text; null if a zero byte says that they are none. Bytes that are not UTF-8 are replaced."""
    return F.when(~F.contains(content, F.lit(b"\0")), F.make_valid_utf8(content.cast("string")))


def _texts(raw: DataFrame, path: Column) -> DataFrame:
    """Binary files as rows of text; files that are no text are left out."""
    return raw.withColumn("text", text_of(F.col("content"))).where("text is not null").select(*_columns(path, F.col("text"), F.col("length")))


def _local(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/*", "/")


def of_directory(spark: SparkSession, root: str, extensions: Iterable[str] = (), exclude: Iterable[str] = (), max_size: int = MAX_SIZE) -> DataFrame:
    """Files below a directory. Size and name are filtered in the scan, before contents are read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= max_size)
    path = _local(F.col("path"))
    top = root.rstrip("/") + "/" if "://" in root else "/" + root.removeprefix("file:").strip("/") + "/"
    return _texts(raw.where(chosen(path, F.col("length"), top, extensions, exclude, max_size)), path)


def of_paths(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """Named files, excluded folders or not; named directories are walked. Names are looked up by Spark's file systems, so that
    they may lie in any store."""
    parts, named = [], []
    for p in paths:
        name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        fs = name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(name):
            if fs.getFileStatus(name).isDirectory():
                parts.append(of_directory(spark, p, **options))
            else:
                named.append(p)
    if named:
        raw = spark.read.format("binaryFile").load(named).where(F.col("length") <= options.get("max_size", MAX_SIZE))
        parts.append(_texts(raw, _local(F.col("path"))))
    out = spark.createDataFrame([], FILES)
    for p in parts:
        out = out.unionByName(p)
    return out.dropDuplicates(["file"])


def of_table(df: DataFrame, file: Column, content: str) -> DataFrame:
    """A text column of a table as files. A null text is no file."""
    return df.where(F.col(content).isNotNull()).select(*_columns(file, F.col(content), F.octet_length(F.col(content))))


def of_rows(spark: SparkSession, rows: Iterable[tuple[str, str]]) -> DataFrame:
    """Snippets: (file name, code)."""
    return of_table(spark.createDataFrame(list(rows), "name string, code string"), F.col("name"), "code")


def lines(files: DataFrame) -> DataFrame:
    """1-based lines; a trailing line feed is followed by an empty line."""
    cut = files.select("file", F.posexplode(F.split("content", "\n", -1)).alias("line", "text"))
    return cut.select("file", (F.col("line") + 1).alias("line"), "text")


def _git(folder: str, *args: str) -> str:
    return _git_bytes(folder, *args).decode("utf-8", "surrogateescape")


def _git_bytes(folder: str, *args: str, given: bytes | None = None) -> bytes:
    return subprocess.run(["git", "-C", folder, *args], input=given, capture_output=True, check=True, timeout=600).stdout


def is_repository(folder: str) -> bool:
    try:
        return _git(folder, "rev-parse", "--is-inside-work-tree").strip() == "true"
    except (subprocess.SubprocessError, OSError):
        return False


def resolve_revision(folder: str, revision: str) -> str | None:
    try:
        return _git(folder, "rev-parse", "--verify", f"{revision}^{{commit}}").strip()
    except (subprocess.SubprocessError, OSError):
        return None


def changed_files(spark: SparkSession, folder: str, base: str = "HEAD", target: str | None = None, staged: bool = False) -> DataFrame:
    """Paths added, copied, modified or renamed against a revision (or staged), as a table to semi-join files with. Names are
    those below `folder`, which may lie inside a repository."""
    args = ["diff", "--relative", "-z", "--name-only", "--diff-filter=ACMR", *(["--cached"] if staged else [base]), *([target] if target else [])]
    names = [(f"{folder.rstrip('/')}/{n}",) for n in _git(folder, *args).split("\0") if n]
    return spark.createDataFrame(names, "file string")


def diff_stat(folder: str, base: str, target: str = "HEAD") -> str:
    return _git(folder, "diff", "--stat", base, target)


def of_revision(spark: SparkSession, folder: str, revision: str, extensions: Iterable[str] = (), exclude: Iterable[str] = (), max_size: int = MAX_SIZE) -> DataFrame:
    """Files of a revision below folder, by the same choice as of_directory. Names, sizes and texts come from the object store; the
    working tree is not touched. Only chosen files are read, all by one process."""
    listed = [x.split("\t", 1) for x in _git(folder, "ls-tree", "-r", "-l", "-z", revision).split("\0") if x]
    rows = [(*meta.split()[1:], name) for meta, name in listed]
    blobs = spark.createDataFrame([(name, oid, int(size)) for kind, oid, size, name in rows if kind == "blob"], "name string, oid string, size long")
    wanted = [(r["name"], r["oid"]) for r in blobs.where(chosen(F.col("name"), F.col("size"), "", extensions, exclude, max_size)).select("name", "oid").collect()]
    said = _git_bytes(folder, "cat-file", "--batch", given="".join(f"{oid}\n" for _, oid in wanted).encode())
    out, at = [], 0
    for name, _ in wanted:
        head = said.index(b"\n", at)
        size = int(said[at:head].split()[2])
        out.append((name, said[head + 1 : head + 1 + size], size))
        at = head + size + 2
    return _texts(spark.createDataFrame(out, "name string, content binary, length long"), F.col("name"))
