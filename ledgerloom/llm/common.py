"""Shared helpers: table reading, lineage cuts and Arrow batch limits."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes that one Arrow batch to a Python worker may hold; long texts make the bytes bind first.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def tune(spark: SparkSession) -> None:
    """Bound what one Arrow batch brings into a Python worker, in the session: operators that hand rows to Python call it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a local master has a temporary one; a cluster has none and it is an error."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"{tempfile.gettempdir()}/ledgerloom-{spark.sparkContext.applicationId}"
    return folder.rstrip("/")


_scopes: list[list[str]] = []


@contextmanager
def scope() -> Iterator[list[str]]:
    """The folders of the cuts made inside, for release()."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes.pop()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder as Parquet and read it again: its lineage ends there, losing an executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for made in _scopes:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_cut(df: DataFrame) -> None:
    """Remove the files of a cut() that no later plan reads."""
    for file in df.inputFiles()[:1]:
        folder = file.rsplit("/", 1)[0]
        if re.fullmatch(r"cut-[0-9a-f]{32}", folder.rsplit("/", 1)[-1]):
            _delete(df.sparkSession, folder)


def release(spark: SparkSession, made: list[str], *kept: DataFrame) -> None:
    """Remove the cuts of a scope but those that `kept` read: what a result needs that is yet to be computed."""
    needed = {file.rsplit("/", 1)[0].rsplit("/", 1)[-1] for df in kept for file in df.inputFiles()}
    for folder in made:
        if folder.rsplit("/", 1)[-1] not in needed:
            _delete(spark, folder)


def batches(schema: pa.Schema, rows: Iterable[tuple], size: int = 8192) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most size rows from tuples."""
    kept: list[tuple] = []
    for row in rows:
        kept.append(row)
        if len(kept) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*kept), schema)], schema=schema)
            kept = []
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*kept), schema)], schema=schema)
