"""What a text must hold for a pattern to match in it, read from the pattern itself; and batches of bounded size, in and out of Python."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import islice
from re import _constants as op
from re import _parser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: One alternative of each clause stands in every text that matches.
Clauses = tuple[tuple[str, ...], ...]
#: Rows and bytes that are turned into Python's objects at a time. One row may be larger.
PIECE_ROWS, PIECE_BYTES = 256, 4 << 20
#: Rows and bytes of a batch that Spark hands to Python (10,000 and 64 MB by its defaults). One row may be larger.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20
#: Rows of a batch that goes back.
OUT_ROWS = 1000


def clauses(regex: str, flags: int = 0) -> Clauses:
    """Texts that every match holds; in lower case where case is ignored, to be sought in the lower-cased text."""
    tree = _parser.parse(regex, flags)
    all_flags = tree.state.flags
    folded = bool(all_flags & re.I)
    if folded and not all_flags & re.A:  # letters outside ASCII match some of its letters
        return ()

    def walk(seq) -> list[tuple[str, ...]]:
        out: list[tuple[str, ...]] = []
        run: list[str] = []

        def end() -> None:
            if run:
                out.append(("".join(run),))
                run.clear()

        for kind, arg in seq:
            if kind is op.LITERAL and (arg < 128 or not folded):
                run.append(chr(arg).lower() if folded else chr(arg))
            elif kind in (op.AT, op.ASSERT, op.ASSERT_NOT):  # of no width: what is before and after it is next to each other
                continue
            else:
                end()
                if kind is op.SUBPATTERN and not arg[1] and not arg[2]:
                    out += walk(arg[3])
                elif kind is op.ATOMIC_GROUP:
                    out += walk(arg)
                elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and arg[0] > 0:
                    out += walk(arg[2])
                elif kind is op.BRANCH:
                    said = [walk(b) for b in arg[1]]
                    if all(said):
                        out.append(tuple(dict.fromkeys(x for b in said for x in max(b, key=lambda c: min(map(len, c))))))
        end()
        return out

    return tuple(dict.fromkeys(walk(tree)))


def possible(needed: Clauses, text: str) -> bool:
    """May a pattern of these clauses match in the text? The text is lower-cased where case is ignored."""
    for clause in needed:
        for x in clause:
            if x in text:
                break
        else:
            return False
    return True


def pieces(batches: Iterable[pa.RecordBatch], rows: int = PIECE_ROWS, size: int = PIECE_BYTES) -> Iterator[Sequence[list]]:
    """The columns of each batch as lists, a bounded number of rows and bytes of text at a time."""
    for batch in batches:
        lengths = [0] * batch.num_rows
        for c in batch.columns:
            if pa.types.is_string(c.type) or pa.types.is_large_string(c.type):
                lengths = [a + (b or 0) for a, b in zip(lengths, pc.binary_length(c).to_pylist(), strict=True)]
        at = held = 0
        for i, n in enumerate(lengths):
            if i > at and (i - at >= rows or held + n > size):
                yield [c.to_pylist() for c in batch.slice(at, i - at).columns]
                at, held = i, 0
            held += n
        if at < batch.num_rows:
            yield [c.to_pylist() for c in batch.slice(at).columns]


def batched(rows: Iterable[tuple], types: Sequence[pa.DataType], names: Sequence[str], size: int = OUT_ROWS) -> Iterator[pa.RecordBatch]:
    """Rows as batches, a bounded number of them at a time, however many come from one text."""
    rows = iter(rows)
    while out := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches of bounded size, so that a worker's memory does not grow with its share of the rows. Spark reads the
    bounds when the plan runs, so they stay on the session."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, schema)
