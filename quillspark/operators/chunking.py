"""Texts to overlapping chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def raw_chunks(docs: DataFrame, size: int = 1000, overlap: int = 150) -> DataFrame:
    """Adds ``pieces``: packed paragraphs without overlap.  Map-only; null and blank texts have none."""
    T.check_sizes(size, overlap)
    return docs.withColumn("pieces", T.packed(T.paragraphs(F.coalesce("text", F.lit(""))), size, overlap))


def chunks(docs: DataFrame, size: int = 1000, overlap: int = 150, source: str = "source") -> DataFrame:
    """(source, chunk_index, text) of every chunk; indexes start at 0."""
    cut = raw_chunks(docs.select(source, "text"), size, overlap)
    each = cut.select(source, F.posexplode(T.overlapped(F.col("pieces"), overlap)).alias("chunk_index", "text"))
    return each.select(F.col(source), "chunk_index", "text")


def chunks_by_lag(docs: DataFrame, size: int = 1000, overlap: int = 150, source: str = "source") -> DataFrame:
    """The same chunks with the overlap taken by a window function."""
    raw = raw_chunks(docs.select(source, "text"), size, overlap).select(source, F.posexplode("pieces").alias("chunk_index", "piece"))
    before = F.lag("piece").over(Window.partitionBy(source).orderBy("chunk_index"))
    tail = F.concat(F.right(before, F.lit(overlap)), F.lit("\n"), F.col("piece"))
    return raw.select(source, "chunk_index", F.when(before.isNull(), F.col("piece")).otherwise(tail).alias("text"))


SEPARATORS = ("\n\n", "\n", " ", "")


def split_recursively(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` where the separators allow, merged greedily with up to ``overlap`` of the piece before."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, finer = separators[at], separators[at + 1 :]
    if sep:
        first, *more = text.split(sep)
        parts = [x for x in [first, *(sep + m for m in more)] if x]
    else:
        parts = list(text)
    out: list[str] = []
    window: list[str] = []
    held = 0

    def emit() -> None:
        if joined := "".join(window).strip():
            out.append(joined)

    for part in parts:
        if len(part) > size and finer:
            emit()
            window, held = [], 0
            out += split_recursively(part, size, overlap, finer)
            continue
        if held + len(part) > size and window:
            emit()
            while window and (held > overlap or held + len(part) > size):
                held -= len(window.pop(0))
        window.append(part)
        held += len(part)
    emit()
    return out


def recursive_chunks(docs: DataFrame, size: int = 1000, overlap: int = 150, source: str = "source") -> DataFrame:
    """(source, chunk_index, text) by recursive separators; the columns of a document are copied to its pieces."""
    T.check_sizes(size, overlap)

    @F.pandas_udf("array<string>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: split_recursively(t, size, overlap) if t else [])

    return docs.select(source, F.posexplode(split("text")).alias("chunk_index", "text"))
