"""Plumbing shared by the training-data operators: inputs, shared storage, Arrow batches."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..storage import shared_dir

# The only white space that separates words in the contracts: space and \t \n \v \f \r.
WORD_BREAK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def narrow(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns an operator reads, so that further columns can never clash with its own."""
    return df.select(*[F.col(n) for n in names])


def small_batches(spark: SparkSession, rows: int = 512, mb: int = 4) -> None:
    """Lower what Spark sends to a worker at once, so that very long texts cannot pile up there.

    The settings are the session's and hold for later queries too, as Spark reads them when a query runs; they are only
    ever lowered, to the same values.  Sizes may have a unit, as Spark takes them.
    """
    size_of = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", mb << 20)):
        now = size_of(spark.conf.get(f"spark.sql.execution.arrow.{name}")) if name == "maxBytesPerBatch" else int(spark.conf.get(f"spark.sql.execution.arrow.{name}"))
        if not 0 < now <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, whatever a session that raised its settings again sends."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` once as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quill/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of tables that nothing refers to any more, which it does when the driver collects garbage."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def map_texts(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str | StructType
) -> DataFrame:
    """``mapInArrow`` with per-task set-up: ``make()`` runs once in a task and returns the batch function.

    A function that keeps the columns as they are is given by the table's own schema; columns then may have any name.
    """

    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in slices(batches):
            out = step(batch)
            if out is not None and out.num_rows:
                yield out

    if isinstance(schema, StructType):
        plain = StructType([StructField(f"c{n}", f.dataType, f.nullable) for n, f in enumerate(schema)])
        return df.toDF(*plain.names).mapInArrow(run, plain).toDF(*schema.names)
    return df.mapInArrow(run, schema)
