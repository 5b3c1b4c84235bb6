"""State that outlives a run: verdicts, manifests, per-file findings, snapshots; and the folder that cuts lineage.

A state table is a folder of versions and a small file that names the current one. A new version is written beside the others and
then named in one rename, so that a plan may read what it replaces and a lost driver leaves the old table or the new one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER = "CURRENT"
#: Versions before the current one that stay, for plans that still read them.
KEPT = 1


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. One is made only where Spark runs in one process and none is set, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="quarrylight-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """The name of a fresh folder in the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def _files(spark: SparkSession, path: str):
    """(file system, path) of a name, whatever store it is in."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def current(spark: SparkSession, path: str) -> str | None:
    """The current version's name; None where nothing has been written yet. Any other trouble raises."""
    fs, p = _files(spark, f"{path}/{POINTER}")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode().strip()
    finally:
        stream.close()


def read(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """A state table; one that was never written is empty."""
    version = current(spark, path)
    return spark.read.schema(schema).format(fmt).load(f"{path}/{version}") if version else spark.createDataFrame([], schema)


def replace(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a new version of a table and make it the current one."""
    spark = df.sparkSession
    old = current(spark, path)
    version = f"v-{uuid.uuid4().hex}"
    df.write.format(fmt).save(f"{path}/{version}")
    fs, beside = _files(spark, f"{path}/{POINTER}.{version}")
    stream = fs.create(beside, True)
    try:
        stream.write(bytearray(version.encode()))
    finally:
        stream.close()
    options = spark.sparkContext._jvm.org.apache.hadoop.fs
    kinds = spark.sparkContext._gateway.new_array(options.Options.Rename, 1)
    kinds[0] = options.Options.Rename.OVERWRITE
    _, at = _files(spark, f"{path}/{POINTER}")
    options.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(beside, at, kinds)
    versions = [x for x in fs.listStatus(_files(spark, path)[1]) if x.getPath().getName().startswith("v-") and x.getPath().getName() not in (version, old)]
    for x in sorted(versions, key=lambda x: -x.getModificationTime())[KEPT - 1 :]:
        fs.delete(x.getPath(), True)


def clear(spark: SparkSession, path: str) -> None:
    fs, p = _files(spark, path)
    fs.delete(p, True)
