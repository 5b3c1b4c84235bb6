"""Reading and Arrow plumbing that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch handed to Python. A batch of very long texts stays small enough for two workers per executor.
BATCH_ROWS = 512

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\v\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Python worker holds at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. One is made only where Spark runs in one process and none is set, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="quarrylight-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as Parquet into the shared folder and read it again."""
    import uuid

    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a written table that nothing will read again."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written_to)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def map_rows(df: DataFrame, columns: list[str], schema: str, rows: Callable[[], Callable[[list], Iterable[tuple]]]) -> DataFrame:
    """mapInArrow over the given columns only. rows() runs once per task and returns a function from a batch's columns
    (lists) to output tuples in the order of schema."""
    small_batches(df.sparkSession)
    chosen = df.select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = rows()
        for batch in batches:
            out = list(work([c.to_pylist() for c in batch.columns]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types, strict=True)], names=names)

    empty = df.sparkSession.createDataFrame([], schema)
    from pyspark.sql.pandas.types import to_arrow_type

    names = empty.columns
    types = [to_arrow_type(f.dataType) for f in empty.schema.fields]
    return chosen.mapInArrow(run, schema)


def held_out(doc_id: str, modulus: int, remainder: int):
    """Rows kept from training by a stable hash of the id."""
    return (F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus) == remainder
