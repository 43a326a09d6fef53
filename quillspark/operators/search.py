"""Exact vector search."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V

QUESTIONS = 4096  # that are set against all vectors in one pass, at most
QUESTION_BYTES = 32 << 20  # of their vectors
ROWS = 1024  # vectors that a task scores at once


def scored(vectors: DataFrame, query: list[float], vector: str = "embedding") -> DataFrame:
    """Adds ``score``, the cosine with one query; its norm is computed once, here."""
    size = sum(x * x for x in query) ** 0.5
    q = F.array(*[F.lit(float(x)) for x in query]).cast("array<double>")
    own = V.doubles(vector)
    norm = F.col("norm") if "norm" in vectors.columns else V.norm(own)
    return vectors.withColumn("score", V.cosine_of(V.dot(q, own), norm, F.lit(float(size))))


def passes(score: Column | str, least: float) -> Column:
    """Inclusive; a NaN passes no threshold."""
    score = F.col(score) if isinstance(score, str) else score
    return (score >= least) & ~F.isnan(score)


def top(vectors: DataFrame, query: list[float], k: int = 5, least: float = 0.0, order: str | Sequence[str] = "seq", vector: str = "embedding") -> DataFrame:
    """The ``k`` best of one query at or over the threshold; equals in the order of ``order``."""
    if k < 0:
        raise ValueError("k must not be negative")
    found = scored(vectors, query, vector).where(passes("score", least))
    return found.orderBy(F.desc("score"), *([order] if isinstance(order, str) else order)).limit(k)


class _Best:
    """A task's ``k`` best of every question so far, in Arrow columns (qid number, score, and what a vector carries)."""

    def __init__(self, n: int, k: int, order: Sequence[str]) -> None:
        self.n, self.k = n, k
        self.keys = [("_q", "ascending"), ("_score", "descending"), *((c, "ascending") for c in order)]
        self.least = np.full(n, -np.inf)  # no score below can still be among the best
        self.parts: list[pa.Table] = []
        self.held = self.full = 0

    def add(self, scores: np.ndarray, ok: np.ndarray, rows: pa.RecordBatch, questions: np.ndarray | None = None) -> None:
        """Scores (vectors x questions) of rows that lie in the tie order; ``ok`` marks those that count.

        ``questions`` numbers the columns, if they are not all questions.
        """
        if not self.k:
            return
        s = np.where(ok & (scores >= (self.least if questions is None else self.least[questions])), scores, -np.inf)
        if len(s) > self.k:
            bar = np.partition(s, len(s) - self.k, axis=0)[len(s) - self.k]
            above, level = s > bar, s == bar
            take = above | (level & (np.cumsum(level, axis=0) <= self.k - above.sum(axis=0)))
        else:
            take = np.ones(s.shape, bool)
        at, q = np.nonzero(take & (s > -np.inf))
        if len(at):
            table = pa.Table.from_batches([rows]).take(pa.array(at))
            number = q if questions is None else questions[q]
            self.parts.append(table.append_column("_q", pa.array(number, pa.int64())).append_column("_score", pa.array(s[at, q])))
            self.held += len(at)
            if self.held > 2 * self.full + 4096:
                self.settle()

    def settle(self) -> pa.Table | None:
        """The ``k`` best of each question of all parts; equals in the tie order."""
        if not self.parts:
            return None
        table = pa.concat_tables(self.parts)
        # sort_by puts nulls last; Spark's ascending order has them first
        table = table.take(pc.sort_indices(table, sort_keys=self.keys, null_placement="at_start"))
        q = table["_q"].to_numpy()
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        kept = table.filter(pa.array(rank < self.k))
        last = rank == self.k - 1
        self.least[q[last]] = table["_score"].to_numpy()[last]
        self.parts, self.held = [kept], len(kept)
        self.full = len(kept)
        return kept


def _matrix(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(matrix, norms, valid): vectors cut or filled with zeros to ``dim``; norms are of the whole vectors."""
    n = len(vectors)
    whole = vectors.is_valid().to_numpy(zero_copy_only=False)
    flat = vectors.flatten()
    if flat.null_count:
        owner = np.repeat(np.arange(n), np.nan_to_num(pc.list_value_length(vectors).to_numpy(zero_copy_only=False)).astype(int))
        whole[owner[flat.is_null().to_numpy(zero_copy_only=False)]] = False
    flat = flat.to_numpy(zero_copy_only=False).astype("f8", copy=False)
    sizes = np.nan_to_num(pc.list_value_length(vectors).to_numpy(zero_copy_only=False)).astype(int)
    if (sizes == dim).all():
        m = flat.reshape(n, dim)
        return m, np.sqrt((m * m).sum(axis=1)), whole
    ends = np.cumsum(sizes)
    row = np.repeat(np.arange(n), sizes)
    col = np.arange(len(flat)) - np.repeat(ends - sizes, sizes)
    m, norms = np.zeros((n, dim)), np.zeros(n)
    np.add.at(norms, row, flat * flat)
    inside = col < dim
    m[row[inside], col[inside]] = flat[inside]
    return m, np.sqrt(norms), whole


def _blocks(questions: DataFrame, key: str, limit: int) -> Iterator[pa.Table]:
    """Questions in blocks of about ``limit``, each brought to the driver alone."""
    n = -(-questions.count() // limit) or 1
    for i in range(n):
        yield (questions if n == 1 else questions.where(F.pmod(F.xxhash64(key), F.lit(n)) == i)).toArrow()


def blocks(questions: DataFrame, key: str = "qid") -> Iterator[pa.Table]:
    """Questions (key, query) in blocks of ``QUESTIONS`` and ``QUESTION_BYTES`` at most."""
    widest = questions.agg(F.max(F.size("query"))).first()[0] or 1
    return _blocks(questions, key, max(1, min(QUESTIONS, QUESTION_BYTES // (8 * max(1, widest)))))


def _rounded(scores: np.ndarray, digits: int | None) -> np.ndarray:
    if digits is None:
        return scores
    return np.sign(scores) * np.floor(np.abs(scores) * 10.0**digits + 0.5) / 10.0**digits


def batch_top(
    vectors: DataFrame, questions: DataFrame, k: int = 5, least: float = 0.0, key: str = "qid", order: str | Sequence[str] = "seq", digits: int | None = None,
    limit: int = QUESTIONS,
) -> DataFrame:
    """For every question (key, query) its ``k`` best vectors: their columns, the question's key, score and rank from 1.

    Equals are taken in the order of the columns ``order``.  Questions come to the driver and to the executors in blocks
    of at most ``limit`` and of bounded bytes; a task scores a block by matrix products and keeps ``k`` vectors of a
    question, so ``k`` rows a question and task are shuffled, and neither vectors nor pairs.  Null vectors and vectors
    with null elements have no score.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    order = [order] if isinstance(order, str) else list(order)
    asked = questions.select(key, V.doubles("query").alias("query"))
    carried = [c for c in vectors.columns if c not in ("embedding", "norm")]
    own = vectors.select(*carried, V.doubles("embedding").alias("embedding"), *(["norm"] if "norm" in vectors.columns else []))
    widest = asked.agg(F.max(F.size("query"))).first()[0] or 1
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*own.select(*carried).schema, *asked.select(key).schema]) + ", score double"
    out = None
    for block in _blocks(asked, key, max(1, min(limit, QUESTION_BYTES // (8 * widest)))):
        # a block is bounded by its rows and bytes
        sent = questions.sparkSession.sparkContext.broadcast(block.combine_chunks())
        part = own.mapInArrow(_scorer(sent, key, carried, order, k, least, widest, digits), schema)
        out = part if out is None else out.unionByName(part)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), *order))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def _scorer(sent, key: str, carried: list[str], order: list[str], k: int, least: float, dim: int, digits: int | None):
    def run(batches):
        block = sent.value
        if not len(block):
            return
        queries, query_norms, asked = _matrix(block["query"].combine_chunks(), dim)
        best = _Best(len(block), k, order)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                rows = whole.slice(at, ROWS)
                rows = rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in order], null_placement="at_start"))
                m, norms, whole_rows = _matrix(rows.column("embedding"), dim)
                if "norm" in rows.schema.names:
                    given = rows.column("norm").to_numpy(zero_copy_only=False).astype("f8")
                    norms = np.where(np.isnan(given), norms, given)
                sizes = norms[:, None] * query_norms
                with np.errstate(all="ignore"):
                    scores = np.where((norms[:, None] == 0) | (query_norms == 0), 0.0, m @ queries.T / sizes)
                    scores = _rounded(scores, digits)
                    best.add(scores, (scores >= least) & whole_rows[:, None] & asked, rows.select(carried))
        found = best.settle()
        if found is not None and len(found):
            named = found.select(carried).append_column(key, block[key].take(found["_q"])).append_column("score", found["_score"])
            yield from named.combine_chunks().to_batches()

    return run


def nearest(vectors: DataFrame, query: list[float], k: int = 4, order: str | Sequence[str] = "seq", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest by squared distance, without a threshold."""
    q = F.array(*[F.lit(float(x)) for x in query]).cast("array<double>")
    return vectors.withColumn("distance", V.squared_distance(V.doubles(vector), q)).orderBy("distance", *([order] if isinstance(order, str) else order)).limit(k)
