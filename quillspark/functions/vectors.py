"""Vector expressions on arrays of doubles."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import tokens


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _products(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the shorter length; vectors of one length are not copied."""
    n = F.least(F.size(a), F.size(b))
    return F.when(F.size(a) == F.size(b), _products(a, b)).otherwise(_products(F.slice(a, 1, n), F.slice(b, 1, n)))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x * x)))


def cosine_of(d: Column, na: Column, nb: Column) -> Column:
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(d / (na * nb))


def cosine(a: Column, b: Column) -> Column:
    """Cosine with full norms; 0 if either norm is 0."""
    return cosine_of(dot(a, b), norm(a), norm(b))


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


MEMO = 1_000_000  # tokens that a worker process remembers
_BUCKETS: dict[int, dict[str, int]] = {}


def _counts(line: str | None, dim: int, memo: dict[str, int]) -> np.ndarray | None:
    if line is None:
        return None
    words = line.split(" ") if line else []
    try:
        at = [memo[w] for w in words]
    except KeyError:
        if len(memo) > MEMO:
            memo.clear()
        memo.update((w, int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim) for w in set(words).difference(memo))
        at = [memo[w] for w in words]
    return np.bincount(at, minlength=dim).astype(float) if at else np.zeros(dim)


def hashed_embedding(text: Column | str, dim: int) -> Column:
    """Counts of the text's tokens in ``dim`` buckets: the offline embedder.

    Built-in functions find the tokens; they are hashed and counted in Arrow batches, where a worker hashes a word once
    (with built-in functions, hashing and counting every occurrence took four times as long).
    """

    @F.pandas_udf("array<double>")
    def count(lines: pd.Series) -> pd.Series:
        memo = _BUCKETS.setdefault(dim, {})
        return pd.Series([_counts(line, dim, memo) for line in lines], dtype=object)

    return count(F.array_join(tokens(text), " "))
