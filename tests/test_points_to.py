"""Points-to sets: constraints are read once, whatever the number of rounds."""


def test_constraints_are_read_once(spark, monkeypatch):
    from quarrylight.operators import ssa

    seen = spark.sparkContext.accumulator(0)

    def told(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    monkeypatch.setattr(ssa, "TASK_ROWS", 3)
    rows = [("addr", "v0", "o")] + [("copy", f"v{i + 1}", f"v{i}") for i in range(4)]
    c = spark.createDataFrame(rows, "kind string, lhs string, rhs string").coalesce(1).mapInArrow(told, "kind string, lhs string, rhs string")
    got = {tuple(r) for r in ssa.points_to(c).collect()}
    assert got == {("o", "o"), *((f"v{i}", "o") for i in range(5))}
    # copy once and addr (twice, in a union) before the rounds; load and store in each of 5 rounds
    assert seen.value <= len(rows) * (3 + 2 * 5)
