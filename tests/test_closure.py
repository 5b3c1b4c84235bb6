"""The closure of a graph against a plain search, with long paths, cycles, nulls and crowded nodes."""

import random

import pytest

from quarrylight.operators import callgraph


def plain(edges):
    nodes = {x for e in edges for x in e}
    out = set()
    for n in nodes:
        seen, todo = {n}, [n]
        while todo:
            at = todo.pop()
            for a, b in edges:
                if a == at and a is not None and b not in seen:
                    seen.add(b)
                    todo.append(b)
        out |= {(n, x) for x in seen}
    return out


def _random(seed, nodes, n):
    r = random.Random(seed)
    return [(f"v{r.randrange(nodes)}", f"v{r.randrange(nodes)}") for _ in range(n)]


@pytest.mark.parametrize(
    "edges",
    [
        [(f"v{i}", f"v{i + 1}") for i in range(37)],
        [("a", "b"), ("b", "c"), ("c", "a"), ("c", "c"), ("a", "b")],
        [("a", "b"), ("b", None), (None, "a"), (None, None), ("x", "a")],
        [(f"o{i}", f"c{i % 7}") for i in range(40)] + [(f"c{i}", f"n{i % 2}") for i in range(7)] + [("n0", "r"), ("n1", "r")],
        _random(1, 30, 45),
    ],
)
def test_closure_equals_a_plain_search(spark, monkeypatch, edges):
    monkeypatch.setattr(callgraph, "HUB_ROWS", 3)
    got = [tuple(r) for r in callgraph.reachable(spark.createDataFrame(edges, "src string, dst string")).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(edges)


def test_crowded_nodes_are_dealt_out(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(callgraph, "HUB_ROWS", 100)
    reach = spark.range(4000).selectExpr("concat('o', id) src", "'n' dst", "1 far")
    j = callgraph._through(reach, spark.createDataFrame([("n", "r", 1)], "src string, dst string, far int"), 1, 8)
    assert j.count() == 4000
    # the pairs of the one node are joined in many tasks: none has the greater part of them
    left = [x for x in j._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RepartitionByExpression" in x]
    assert any("share" in x for x in left)
    assert j.select("src").distinct().count() == 4000 and j.where(F.col("far") != 2).count() == 0
