"""Every registered query against its SQL in DuckDB."""

import math

import duckdb
import pytest

from quarrylight.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(df):
    def of(v):
        if v is None or isinstance(v, float) and math.isnan(v) or str(v) in ("NaT", "<NA>"):
            return "null"
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(of, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE:
        expected = duck.execute(ORACLE[name]).fetchdf()
        assert sorted(got.columns) == sorted(expected.columns)
        assert canonical(got) == canonical(expected)
    else:
        assert len(got.columns)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_html_escape_of_whole_pages(spark, tmp_path):
    import hashlib
    import html

    pages = [(1, "x" * 200 + "<a href=\"b\">'c' & d</a>"), (2, None), (3, "")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.n_chars, r.escaped_sha256) for r in QUERIES["html_escape"](spark, str(tmp_path)).collect()}
    for k, text in pages:
        e = text and html.escape(text).replace("&#x27;", "&#39;")
        assert got[k] == ((None, None) if e is None else (len(e), hashlib.sha256(e.encode()).hexdigest()))


def test_queries_over_every_listed_table(spark, tmp_path):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))

    secret = "aB3dE5gH7jK9mN1pQ2rS4tU6"
    put("documents", [(1, f'x = "{secret}"'), (2, "this is the text of a document"), (3, None)], "doc_id long, text string")
    put("pages", [(1, f"<a b='{secret}'>")], "page_id long, html string")
    put("conversations", [(1, 2, "x y")], "conv_id long, turn long, text string")
    put("lineitem", [(1, 5, 1), (2, 6, 3)], "l_partkey long, l_suppkey long, l_linenumber int")
    put("part", [(1, "A"), (2, "B")], "p_partkey long, p_brand string")
    got = {n: {tuple(r) for r in QUERIES[n](spark, str(tmp_path)).collect()} for n in ("generic_secret_literals", "natural_language_docs", "points_to_fixpoint")}
    assert {r[:2] for r in got["generic_secret_literals"]} == {("doc/1.txt", secret), ("page/1.html", secret)}
    assert {("doc/2", True), ("turn/1/2", False)} <= got["natural_language_docs"] and len(got["natural_language_docs"]) == 3
    assert ("s6", "bB") in got["points_to_fixpoint"]
