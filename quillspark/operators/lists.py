"""Vectors in inverted lists: a coarse centroid a list, lists as partition folders, searched by probes or by bounds.

Centroids are fitted on a bounded sample, every vector is put into the list of its nearest centroid, and a list keeps
its radius, the largest distance of a member from the centroid.  A search knows from centroids and radii how near a
list's members can be at best.

* ``probe`` reads the lists whose centroids are nearest to each question, as many as reached ``RECALL`` on the sample, and
  scores their members exactly.
* ``exact`` reads the same lists first; then it knows a question's kth best score and reads of the others only those
  that can hold a better one.  Its rows are those of a search over all vectors, and at worst it scores all of them.

For cosines, centroids and distances are those of unit vectors: a cosine is 1 - d * d / 2.  Vectors without a direction
(null, empty, zero, or with a null or NaN element) lie in list -1, which every search reads.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..storage import Store, joined
from .search import QUESTION_BYTES, QUESTIONS, ROWS, _Best, _blocks, _matrix, _rounded

LISTS = 1024  # at most
SAMPLE = 20_000  # vectors that centroids are fitted on, at most
SAMPLE_BYTES = 64 << 20
ROUNDS = 12
RECALL = 0.97  # of the sample's nearest TOP, that the number of probes must reach
TOP = 5
CHECKED = 300  # vectors of the sample that are searched to find it
NONE = -1


def _units(m: np.ndarray) -> np.ndarray:
    size = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(size == 0, 1.0, size)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of both."""
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T), 0.0)


def fitted(sample: np.ndarray, lists: int, seed: int = 42) -> np.ndarray:
    """Centroids by Lloyd's rounds; a centroid without members moves to the vector that is farthest from its own."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)].copy()
    for _ in range(ROUNDS):
        d = _squared(sample, centres)
        own = d.argmin(axis=1)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        empty = np.flatnonzero(counts == 0)
        if len(empty):
            centres[empty] = sample[np.argsort(-d.min(axis=1), kind="stable")[: len(empty)]]
    return centres


def probes_for(sample: np.ndarray, centres: np.ndarray, recall: float = RECALL, top: int = TOP) -> int:
    """The fewest probes by which vectors of the sample find that share of their nearest others."""
    asked = sample[:: max(1, len(sample) // CHECKED)]
    own = _squared(sample, centres).argmin(axis=1)
    near = np.argsort(_squared(asked, sample), axis=1, kind="stable")[:, : top + 1]
    place = np.argsort(np.argsort(_squared(asked, centres), axis=1, kind="stable"), axis=1)
    ranks = np.take_along_axis(place, own[near], axis=1)
    return int(np.quantile(ranks, recall, method="higher")) + 1


@dataclass
class Head:
    """What a search must know of the lists: bounded by ``LISTS`` centroids."""

    metric: str
    dim: int
    probes: int
    names: np.ndarray  # of the lists that have members
    centres: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray
    loose: int  # members of list -1
    schema: str


class VectorLists:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, str(folder)

    def build(self, vectors: DataFrame, metric: str = "cosine", lists: int | None = None, seed: int = 42) -> Head:
        """Write the lists of all rows of ``vectors``; its columns but ``list`` are kept.  ``lists`` is about the root of their number."""
        if metric not in ("cosine", "l2"):
            raise ValueError(f"unknown metric: {metric}")
        own = vectors.withColumn("embedding", V.doubles("embedding"))
        n, dim = own.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
        dim = max(1, dim)
        lists = max(1, min(lists or round(n**0.5), LISTS, SAMPLE_BYTES // (8 * dim)))
        most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
        sample = self._sample(own, n, most, dim, metric)
        centres = fitted(sample, lists, seed) if len(sample) else np.zeros((1, dim))
        probes = probes_for(sample, centres) if len(sample) else 1
        # the centroids' size is bounded by SAMPLE_BYTES
        sent = self.spark.sparkContext.broadcast(centres)
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
        placed = own.mapInArrow(_placer(sent, dim, metric), f"{fields}, list int, apart double")
        # lists of any size: files are split where a list is large
        placed.hint("rebalance", "list").write.partitionBy("list").parquet(joined(self.folder, "vectors"))
        schema = f"{fields}, apart double, list int"
        head = self._stored(schema).groupBy("list").agg(F.max("apart").alias("radius"), F.count("*").alias("n"))
        rows = sorted((r.list, r.radius, r.n) for r in head.collect())  # a row a list
        text = {
            "metric": metric, "dim": dim, "probes": probes, "schema": schema,
            "lists": [[name, centres[name].tolist(), radius, size] for name, radius, size in rows if name != NONE],
            "loose": sum(size for name, _, size in rows if name == NONE),
        }
        Store(self.spark, self.folder).write_text("HEAD", json.dumps(text))
        return self.head()

    @staticmethod
    def _sample(own: DataFrame, n: int, most: int, dim: int, metric: str) -> np.ndarray:
        share = own if n <= most else own.where(F.pmod(F.xxhash64("embedding"), F.lit(1_000_003)) < int(1_000_003 * min(1.0, 1.2 * most / n)) + 1)
        table = share.select("embedding").where("embedding is not null").limit(most).toArrow()
        if not len(table):
            return np.zeros((0, dim))
        m, norms, whole = _matrix(table["embedding"].combine_chunks(), dim)
        m = m[whole & np.isfinite(norms) & ((norms > 0) | (metric == "l2"))]
        return _units(m) if metric == "cosine" else m

    def head(self) -> Head:
        text = json.loads(Store(self.spark, self.folder).read_text("HEAD"))
        names, centres, radii, sizes = (np.array(list(x)) for x in zip(*text["lists"])) if text["lists"] else (np.zeros(0, int), np.zeros((0, text["dim"])), np.zeros(0), np.zeros(0, int))
        return Head(text["metric"], text["dim"], text["probes"], names, centres, radii, sizes, text["loose"], text["schema"])

    def _stored(self, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(joined(self.folder, "vectors"))

    def vectors(self, lists: Sequence[int] | None = None, head: Head | None = None) -> DataFrame:
        """The members of some lists, or of all; only these lists' folders are read."""
        read = self._stored((head or self.head()).schema).drop("apart")
        return read if lists is None else read.where(F.col("list").isin([int(x) for x in lists]))

    def probe(self, questions: DataFrame, k: int = 5, least: float | None = None, probes: int | None = None, order: str | Sequence[str] = "seq", key: str = "qid", digits: int | None = None) -> DataFrame:
        """For every question (key, query) the ``k`` best members of its nearest lists, with score and rank.

        Scores are cosines, or squared distances where these are the metric (smaller is better).  ``least`` bounds cosines
        from below.  Questions come in blocks of bounded rows and bytes.
        """
        return self._search(questions, k, least, probes, order, key, digits, exact=False)[0]

    def exact(self, questions: DataFrame, k: int = 5, least: float | None = None, order: str | Sequence[str] = "seq", key: str = "qid", digits: int | None = None) -> tuple[DataFrame, float]:
        """The ``k`` best of all vectors, and the share of (question, vector) pairs that need no score."""
        return self._search(questions, k, least, None, order, key, digits, exact=True)

    def _search(self, questions, k, least, probes, order, key, digits, exact) -> tuple[DataFrame, float]:
        if k < 0:
            raise ValueError("k must not be negative")
        head, order = self.head(), [order] if isinstance(order, str) else list(order)
        asked = questions.select(key, V.doubles("query").alias("query"))
        limit = max(1, min(QUESTIONS, QUESTION_BYTES // (8 * max(head.dim, len(head.names), 1))))
        out, scored, pairs = None, 0, 0
        for block in _blocks(asked, key, limit):
            block = block.combine_chunks()
            reach = _reach(head, block)
            first = _nearest(reach, min(probes or head.probes, len(head.names)))
            part = self._scored(head, block, first, key, order, k, least, digits)
            if exact:
                kth = self._kth(part, block, key, order, k, least, head.metric)
                slack = 1e-9 if digits is None else 10.0**-digits
                # a list can hold a better vector, or an equal one that comes before in order
                rest = (_bound(reach, head) >= kth[:, None] - slack - 1e-9 * np.abs(kth)[:, None]) & ~first
                if rest.any():
                    part = part.unionByName(self._scored(head, block, rest, key, order, k, least, digits, loose=False))
                first = first | rest
            out = part if out is None else out.unionByName(part)
            scored += int((first @ head.sizes).sum()) + head.loose * len(block)
            pairs += len(block) * (int(head.sizes.sum()) + head.loose)
        best = F.desc("score") if head.metric == "cosine" else F.asc("score")
        rank = F.row_number().over(Window.partitionBy(key).orderBy(best, *order))
        return out.withColumn("rank", rank).where(F.col("rank") <= k), 1 - scored / pairs if pairs else 0.0

    def _scored(self, head: Head, block: pa.Table, wanted: np.ndarray, key: str, order: list[str], k: int, least, digits, loose: bool = True) -> DataFrame:
        names = [int(x) for x in head.names[wanted.any(axis=0)]] + ([NONE] if loose else [])
        read = self.vectors(names, head)
        carried = [c for c in read.columns if c not in ("embedding", "norm", "list")]
        ask = {int(name): np.flatnonzero(column) for name, column in zip(head.names, wanted.T)}
        # bounded by a block's questions times LISTS
        sent = self.spark.sparkContext.broadcast((block, ask))
        kinds = {f.name: f.dataType.simpleString() for f in read.schema}
        schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carried), f"`{key}` {_kind(block.schema.field(key).type)}", "score double"])
        return read.select(*carried, "embedding", "list").mapInArrow(_scorer(sent, key, carried, order, k, least, head, digits), schema)

    @staticmethod
    def _kth(part: DataFrame, block: pa.Table, key: str, order: list[str], k: int, least, metric: str) -> np.ndarray:
        """Each question's kth best score so far, as a number that grows with quality; one row a question comes to the driver."""
        good = F.col("score") if metric == "cosine" else -F.col("score")
        rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("good"), *order))
        found = part.select(key, *order, good.alias("good")).withColumn("rank", rank).where(F.col("rank") == k).select(key, "good")
        known = {r[0]: r[1] for r in found.toLocalIterator()}
        floor = -np.inf if least is None or metric != "cosine" else least
        return np.array([max(known.get(q, -np.inf), floor) for q in block[key].to_pylist()])


def _kind(t: pa.DataType) -> str:
    return {"int64": "bigint", "int32": "int", "string": "string", "large_string": "string"}[str(t)]


def _placer(sent, dim: int, metric: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                rows = whole.slice(at, ROWS)
                m, norms, valid = _matrix(rows.column(rows.schema.get_field_index("embedding")), dim)
                known = valid & np.isfinite(norms) & ((norms > 0) | (metric == "l2"))
                m = np.where(known[:, None], m, 0.0)
                d = _squared(_units(m) if metric == "cosine" else m, centres)
                name = d.argmin(axis=1)
                apart = np.sqrt(d[np.arange(len(d)), name])
                columns = [*rows.columns, pa.array(np.where(known, name, NONE), pa.int32()), pa.array(np.where(known, apart, 0.0))]
                yield pa.RecordBatch.from_arrays(columns, [*rows.schema.names, "list", "apart"])

    return run


def _queries(head: Head, block: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _matrix(block["query"].combine_chunks() if isinstance(block["query"], pa.ChunkedArray) else block["query"], head.dim)


def _reach(head: Head, block: pa.Table) -> np.ndarray:
    """Distance of each question from each centroid."""
    q, norms, _ = _queries(head, block)
    q = np.where(np.isfinite(norms)[:, None], q, 0.0)
    return np.sqrt(_squared(_units(q) if head.metric == "cosine" else q, head.centres))


def _nearest(reach: np.ndarray, probes: int) -> np.ndarray:
    wanted = np.zeros(reach.shape, bool)
    np.put_along_axis(wanted, np.argsort(reach, axis=1, kind="stable")[:, :probes], True, axis=1)
    return wanted


def _bound(reach: np.ndarray, head: Head) -> np.ndarray:
    """The best score that a member of a list can have, growing with quality."""
    apart = np.maximum(reach - head.radii - 1e-9, 0.0)
    return 1 - apart * apart / 2 if head.metric == "cosine" else -(apart * apart)


def _scorer(sent, key: str, carried: list[str], order: list[str], k: int, least, head: Head, digits: int | None):
    metric = head.metric

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ask = sent.value
        if not len(block):
            return
        queries, query_norms, asked = _queries(head, block)
        everyone, best = np.arange(len(block)), _Best(len(block), k, order)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                part = whole.slice(at, ROWS)
                part = part.take(pc.sort_indices(part, sort_keys=[("list", "ascending"), *((c, "ascending") for c in order)], null_placement="at_start"))
                lists = part.column("list").to_numpy()
                edges = np.flatnonzero(np.diff(lists, prepend=lists[:1] - 1))
                for low, high in zip(edges, [*edges[1:], len(lists)]):
                    q = everyone if lists[low] == NONE else ask[int(lists[low])]
                    if not len(q):
                        continue
                    rows = part.slice(low, high - low)
                    m, norms, valid = _matrix(rows.column("embedding"), head.dim)
                    with np.errstate(all="ignore"):
                        if metric == "cosine":
                            scores = np.where((norms[:, None] == 0) | (query_norms[q] == 0), 0.0, m @ queries[q].T / (norms[:, None] * query_norms[q]))
                            scores = _rounded(scores, digits)
                            ok = scores >= (-np.inf if least is None else least)
                        else:
                            scores = -_rounded(((m[:, None, :] - queries[q][None]) ** 2).sum(axis=2), digits)
                            ok = ~np.isnan(scores)
                    best.add(scores, ok & valid[:, None] & asked[q], rows.select(carried), q)
        found = best.settle()
        if found is not None and len(found):
            score = found["_score"] if metric == "cosine" else pc.negate(found["_score"])
            named = found.select(carried).append_column(key, block[key].take(found["_q"])).append_column("score", score)
            yield from named.combine_chunks().to_batches()

    return run
