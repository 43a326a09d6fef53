"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)), in time linear in
the features.  Features are the document's distinct words hashed to ``WORDS`` slots (weights are
log-counts, scaled to unit length), one-hot levels of structure statistics, and the level of the
character count that the table holds (its metadata).  Labels, language, source and doc_id are no features.

The machine is fitted on at most ``SAMPLE`` labelled rows, those with the smallest hash of doc_id; scores are
computed for all rows from whole texts.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, narrow

SAMPLE = 4000
WORDS = 1 << 14
RANK = 8
THRESHOLD = 0.3
LEVELS = 12
STATISTICS = ("mean word", "symbols", "upper case", "distinct words", "distinct pairs", "stops", "separators", "digits", "words", "line")
DIM = WORDS + LEVELS * (len(STATISTICS) + 1)
_SYMBOLS = re.compile(r"[#*$%&|<>!]")


@functools.lru_cache(maxsize=400_000)
def _slot(word: bytes) -> int:
    return zlib.crc32(word) % WORDS


def _level(share: float) -> int:
    return min(LEVELS - 1, max(0, int(share * LEVELS)))


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted feature numbers and their values; an empty text has its statistics and metadata only."""
    text = text or ""
    words = text.lower().encode("utf-8", "surrogatepass").split()
    n, size = max(1, len(words)), max(1, len(text))
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    stats = (
        size / n / 16,
        len(_SYMBOLS.findall(text)) / n / 2,
        2 * upper / size,
        len(set(words)) / n,
        len(set(zip(words, words[1:]))) / n,
        text.count(".") / n * 4,
        text.count("|") / n * 2,
        4 * sum(map(text.count, "0123456789")) / size,
        np.log2(n + 1) / 16,
        np.log2(size / (text.count("\n") + 1) + 1) / 16,
        np.log2((n_chars if n_chars is not None and n_chars > 0 else 0) + 1) / 20,
    )
    slots, counts = np.unique(np.fromiter(map(_slot, words), np.int64, len(words)), return_counts=True)
    value = np.log1p(counts)
    norm = np.sqrt((value**2).sum()) or 1.0
    extra = np.array([WORDS + LEVELS * i + _level(s) for i, s in enumerate(stats)])
    return np.concatenate([slots, extra]), np.concatenate([value / norm, np.full(len(extra), 0.5)])


class Machine:
    """Weights and factors, fitted by Adam on the log loss."""

    def __init__(self, rank: int = RANK, seed: int = 7) -> None:
        self.bias, self.w = 0.0, np.zeros(DIM)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (DIM, rank))

    def margins(self, ids: np.ndarray, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Raw scores of rows that lie one after another, and each row's factor sums."""
        vx = self.v[ids] * x[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        pairs = 0.5 * ((sums**2).sum(axis=1) - np.add.reduceat((vx**2).sum(axis=1), starts))
        return self.bias + np.add.reduceat(self.w[ids] * x, starts) + pairs, sums

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, rate: float = 0.02, decay: float = 1e-4) -> "Machine":
        rng = np.random.default_rng(11)
        m = [np.zeros_like(self.w), np.zeros_like(self.v)]
        s = [np.zeros_like(self.w), np.zeros_like(self.v)]
        mb = sb = 0.0
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), 128):
                part = order[at : at + 128]
                ids = np.concatenate([rows[i][0] for i in part])
                x = np.concatenate([rows[i][1] for i in part])
                sizes = np.array([len(rows[i][0]) for i in part])
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                raw, sums = self.margins(ids, x, starts)
                error = (1 / (1 + np.exp(-raw)) - labels[part]) / len(part)
                each = np.repeat(error, sizes) * x
                gw = np.bincount(ids, each, DIM) + decay * self.w
                gv = decay * self.v
                inner = each[:, None] * (np.repeat(sums, sizes, axis=0) - self.v[ids] * x[:, None])
                gv = gv + np.stack([np.bincount(ids, inner[:, f], DIM) for f in range(inner.shape[1])], axis=1)
                step += 1
                for k, (param, grad) in enumerate(((self.w, gw), (self.v, gv))):
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    s[k] = 0.999 * s[k] + 0.001 * grad**2
                    param -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
                gb = error.sum()
                mb, sb = 0.9 * mb + 0.1 * gb, 0.999 * sb + 0.001 * gb**2
                self.bias -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(sb / (1 - 0.999**step)) + 1e-8)
        return self

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        sizes = np.array([len(r[0]) for r in rows])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        raw, _ = self.margins(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), starts)
        return 1 / (1 + np.exp(-np.clip(raw, -500, 500)))


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """A machine from at most ``sample`` labelled rows that are not held out.

    Labels that are null or whose document is missing teach nothing.  A repeated label is kept once, the
    larger if they differ.  With no label at all every text scores one half.
    """
    chosen = (
        narrow(labels, "doc_id", "quality")
        .where("doc_id is not null and quality is not null")
        .where(~held_out())
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    # at most ``sample`` pairs of integers: bounded, whatever the tables hold
    rows = narrow(docs, "doc_id", "text", "n_chars").join(F.broadcast(chosen), "doc_id")
    # repeated documents of a label would grow with the corpus: the least of each teaches
    rows = rows.groupBy("doc_id", "quality").agg(F.min(F.struct("text", "n_chars")).alias("d")).select("doc_id", "d.text", "d.n_chars", "quality")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = [features(t, n) for t, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([m[0] for m in made], pa.list_(pa.int32())),
                    pa.array([m[1] for m in made], pa.list_(pa.float32())),
                    batch.column(3).cast(pa.int32()),
                ],
                ["doc_id", "ids", "x", "quality"],
            )

        return step

    taught = map_texts(rows, make, "doc_id long, ids array<int>, x array<float>, quality int")
    got = taught.toArrow().combine_chunks().sort_by("doc_id")
    if not got.num_rows:
        return Machine()
    ids, xs, y = got["ids"], got["x"], got["quality"].to_numpy()
    data = [(np.array(ids[i].as_py(), np.int64), np.array(xs[i].as_py(), np.float64)) for i in range(len(y))]
    return Machine().fit(data, (y >= 1).astype(float))


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score) for every row, from whole texts; null text counts as empty."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = [features(t, n) for t, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(machine.scores(made))], ["doc_id", "score"])

        return step

    return map_texts(narrow(docs, "doc_id", "text", "n_chars"), make, "doc_id long, score double")


def assess(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Repeated rows are returned as they come and score alike; a null doc_id is not held out; an empty table
    gives an empty result; further columns are ignored.
    """
    out = scored(docs, train(docs, labels))
    return out.select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score below the threshold; all columns are kept as they are."""
    machine = train(docs, labels)
    text, n_chars = docs.columns.index("text"), docs.columns.index("n_chars")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = [features(t, n) for t, n in zip(batch.column(text).to_pylist(), batch.column(n_chars).to_pylist())]
            return batch.filter(pa.array(machine.scores(made) >= threshold))

        return step

    return map_texts(docs, make, docs.schema)
