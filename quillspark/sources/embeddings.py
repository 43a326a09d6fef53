"""Embeddings that have been paid for, by content: a text is embedded once for a model and task, whatever holds it.

The table is appended to before an index is written, so a sync that fails later asks for nothing again.  Two syncs may add
the same text at the same time; a reader takes one of the two.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Store, joined

SCHEMA = "key string, embedding array<double>"


class Embeddings:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, str(folder)

    def _path(self, model: str, task: str) -> str:
        return joined(self.folder, hashlib.sha256(f"{model}\n{task}".encode()).hexdigest()[:16])

    def known(self, model: str, task: str) -> DataFrame:
        """(key, embedding): one row for each text, named by its SHA-256."""
        path = self._path(model, task)
        if not Store(self.spark, path).entries():
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(path).groupBy("key").agg(F.first("embedding").alias("embedding"))

    def embedded(self, texts: DataFrame, embed: Callable[[str], Column], model: str, task: str = "RETRIEVAL_DOCUMENT") -> DataFrame:
        """``texts`` with ``embedding``; ``embed`` is asked for the distinct texts that are not known, and these are written first."""
        keyed = texts.withColumn("key", F.sha2("text", 256))
        fresh = keyed.groupBy("key").agg(F.first("text").alias("text")).join(self.known(model, task).select("key"), "key", "left_anti")
        fresh.select("key", embed("text").alias("embedding")).where("embedding is not null").write.mode("append").parquet(self._path(model, task))
        return keyed.join(self.known(model, task), "key", "left").select(*texts.columns, "embedding")
