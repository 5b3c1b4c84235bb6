"""Document classifiers on subword embeddings: quality and toxicity.

A bounded sample of labelled rows trains the model on the driver; every whole text is then scored where it lies. The sample is
the rows with the smallest hash of doc_id, so it is the same on every run. Labels, lang, source and doc_id are no inputs.

Defined results: null and empty texts get the model's score of a text that says nothing; repeated rows are scored one by one;
without labelled rows, or with one label only, the score is that label's share (a half if there are none); a null doc_id is not
held out; where a doc_id comes with several texts, its label goes with the least of them; texts of any length are scored whole, batch
by batch; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, small_batches
from .subwords import Model, Shape, train

QUALITY = Shape(bits=18, least=3, most=4, lower=False, forms=True, once=False, echoes=True)
TOXICITY = Shape(bits=18, least=3, most=5, lower=True, once=True)
#: Labelled rows a model is trained on: of both labels together, or of each label.
QUALITY_ROWS = 3000
TOXIC_ROWS = {0: 2500, 1: 2000}
#: Longer texts are scored, but not trained on, so that the sample is bounded in bytes too.
SAMPLE_CHARS = 200_000
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, rows: int | dict[int, int]) -> list[tuple[str | None, int]]:
    """At most `rows` labelled texts outside the held-out part (rows: a bound for all, or one for each label)."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", modulus, remainder)).select("doc_id", F.col(label).cast("int").alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("y")]
    if isinstance(rows, dict):
        parts = [known.where(F.col("y") == y).orderBy(*order).limit(n) for y, n in rows.items()]
        chosen = parts[0]
        for p in parts[1:]:
            chosen = chosen.union(p)
    else:
        chosen = known.orderBy(*order).limit(rows)
    # the sample's bound is what makes the broadcast safe
    short = docs.where(F.length(F.coalesce("text", F.lit(""))) <= SAMPLE_CHARS)
    got = short.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()
    got = sorted(got, key=lambda r: (r["doc_id"], r["y"], r["text"] or ""))
    return [(r["text"], r["y"]) for r in got]


def fit(docs: DataFrame, labels: DataFrame, label: str, shape: Shape, modulus: int, remainder: int, rows: int | dict[int, int], **options) -> Model:
    got = sample(docs, labels, label, modulus, remainder, rows)
    return train([t for t, _ in got], [y for _, y in got], shape, **options)


def score(docs: DataFrame, model: Model, threshold: float, modulus: int, remainder: int) -> DataFrame:
    """Every document with its score."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.scores(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype("int32"), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(held_out("doc_id", modulus, remainder), F.lit(False)).alias("held_out")
    return docs.select("doc_id", held, "text").mapInArrow(run, SCHEMA)


def quality(docs: DataFrame, labels: DataFrame, rows: int = QUALITY_ROWS) -> DataFrame:
    model = fit(docs, labels, "quality", QUALITY, 4, 2, rows, epochs=4)
    return score(docs, model, 0.7, 4, 2)


def toxicity(docs: DataFrame, labels: DataFrame, rows: dict[int, int] | None = None) -> DataFrame:
    model = fit(docs, labels, "toxic", TOXICITY, 5, 0, rows or TOXIC_ROWS, epochs=5)
    return score(docs, model, 0.5, 5, 0)
