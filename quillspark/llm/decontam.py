"""Benchmark decontamination: size-partitioned MinHash containment search.

Documents are partitioned by the power of two above their number of shingles.  Each partition has its
own number of MinHash bins (one permutation, one row a band), at least four times the larger of the
partition's size bound and the longest item.  A shingle then keeps its place as minimum of its bin
with probability >= 0.88 on either side, so an item of which at least ten shingles lie in a
document shares no bin with it with probability below 1e-6.  Items with fewer than ``SHORT``
shingles have all their shingles as bands, an exact way; an item of fewer than five words is one shingle of
its own width, which is looked up among all a document's runs of as many words.  Every candidate is verified by the exact
share of the item's word shingles in the whole document.

The pass over the documents is map-only: no document row is shuffled.  Items are set against all rows in
blocks of at most ``BLOCK`` items, so what a worker holds is bounded however large the benchmark is.  The driver
holds one block at a time; a broadcast block lies on disk.
"""

from __future__ import annotations

import re
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, narrow

SHINGLE = 5
THRESHOLD = 0.8
BLOCK = 50_000  # items of a block
BLOCK_BYTES = 16 << 20  # of their texts
SHORT = 12
# letters and digits of ASCII and everything beyond ASCII
_WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_KEEP = np.array([(48 <= b <= 57) or (97 <= b <= 122) or b >= 128 for b in range(256)])
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = [np.uint64(pow(0xD6E8FEB86659FD93, k, 1 << 64)) for k in range(SHINGLE)]


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingles_of(words: list[str]) -> set[tuple[str, ...]]:
    """Five-word shingles; the whole sequence if there are fewer words, none if there is no word."""
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


class _Powers:
    """Powers of the hash base and of its inverse, grown as longer texts come."""

    def __init__(self) -> None:
        self.up, self.down = _powers(_BASE, 1 << 16), _powers(_INVERSE, 1 << 16)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << (n - 1).bit_length()
            self.up, self.down = _powers(_BASE, size), _powers(_INVERSE, size)
        return self.up[:n], self.down[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(text: str | None, powers: _Powers, widths: tuple[int, ...] = (SHINGLE,)) -> list[np.ndarray]:
    """64-bit hashes of the text's runs of each number of words, in order, without building a word string.

    A text of fewer words than ``SHINGLE`` has one run for it: all its words.
    """
    data = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
    inside = _KEEP[data]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return [np.zeros(0, np.uint64)] * len(widths)
    up, down = powers.get(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=total[1:])
    word = _mix((total[end] - total[start]) * down[start])
    return [_runs(word, min(w, len(word)) if w == SHINGLE else w) for w in widths]


def _runs(word: np.ndarray, width: int) -> np.ndarray:
    n = len(word)
    if n < width:
        return np.zeros(0, np.uint64)
    out = word[: n - width + 1] * _STEP[0]
    for k in range(1, width):
        out = out + word[k : n - width + 1 + k] * _STEP[k]
    return _mix(out + np.uint64(width))


def bins_for(size: int, longest: int) -> int:
    """log2 of the number of bins for documents of up to ``size`` shingles."""
    return (max(4 * size, 4 * longest, 256) - 1).bit_length()


def minima(hashes: np.ndarray, log_bins: int) -> np.ndarray:
    """One-permutation MinHash: the smallest hash in each bin; a bin is given by a hash's top bits."""
    ordered = np.sort(hashes)
    bins = ordered >> np.uint64(64 - log_bins)
    return ordered[np.concatenate([[True], bins[1:] != bins[:-1]])]


class Index:
    """Items of one block, with one table of band keys for each size partition met so far."""

    def __init__(self, items: list[tuple[int | None, str | None]]) -> None:
        self.powers = _Powers()
        self.ids = [i for i, _ in items]
        self.shingles = [shingles_of(words_of(t)) for _, t in items]
        self.hashes = [np.unique(shingle_hashes(t, self.powers)[0]) for _, t in items]
        # words of the items under five words
        self.widths = tuple(sorted({len(x) for s in self.shingles for x in s if len(x) < SHINGLE}))
        self.longest = max([len(h) for h in self.hashes], default=1)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def table(self, size: int) -> tuple[int, np.ndarray, np.ndarray]:
        log_bins = bins_for(1 << max(0, size - 1).bit_length(), self.longest)
        if log_bins not in self.tables:
            keys = [minima(h, log_bins) if len(h) >= SHORT else h[:0] for h in self.hashes]
            self.tables[log_bins] = self._sorted(keys)
        return (log_bins, *self.tables[log_bins])

    def _sorted(self, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        order = np.argsort(flat, kind="stable")
        return flat[order], owner[order]

    def short(self) -> tuple[np.ndarray, np.ndarray]:
        if -1 not in self.tables:
            self.tables[-1] = self._sorted([h if len(h) < SHORT else h[:0] for h in self.hashes])
        return self.tables[-1]

    @staticmethod
    def _owners(keys: np.ndarray, owner: np.ndarray, probes: np.ndarray) -> set[int]:
        if not len(keys):
            return set()
        low = np.searchsorted(keys, probes, "left")
        hit = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == probes)
        high = np.searchsorted(keys, probes[hit], "right")
        return {int(o) for a, b in zip(low[hit], high) for o in owner[a:b]}

    def find(self, text: str | None, threshold: float) -> list[tuple[int, int, int]]:
        """(item number, shingles found, shingles of the item) for items contained to ``threshold``."""
        hashes, *narrower = shingle_hashes(text, self.powers, (SHINGLE, *self.widths))
        if not len(hashes):
            return []
        log_bins, keys, owner = self.table(len(hashes))
        near = self._owners(keys, owner, minima(hashes, log_bins)) | self._owners(*self.short(), np.concatenate([hashes, *narrower]))
        if not near:
            return []
        words = words_of(text)
        own = shingles_of(words).union(*({tuple(words[i : i + w]) for i in range(len(words) - w + 1)} for w in self.widths))
        found = [(i, len(self.shingles[i] & own), len(self.shingles[i])) for i in sorted(near)]
        return [x for x in found if x[2] and x[1] >= threshold * x[2] - 1e-9]


_INDEXES: OrderedDict[str, Index] = OrderedDict()


def _indexes(items: DataFrame, block: int) -> Iterator[Callable[[], Index]]:
    """For each block of items a function that gives its index in a worker.

    A block is bounded by rows and bytes, comes to the driver alone and is broadcast once; a worker process builds an
    index once and keeps the last two.
    """
    rows = narrow(items, "item_id", "text")
    n_rows, n_bytes = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(1, -(-n_rows // block), -(-n_bytes // BLOCK_BYTES))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        sent = items.sparkSession.sparkContext.broadcast([(r.item_id, r.text) for r in part.toLocalIterator()])
        name = uuid.uuid4().hex

        def index(sent=sent, name=name) -> Index:
            if name not in _INDEXES:
                _INDEXES[name] = Index(sent.value)
                while len(_INDEXES) > 2:
                    _INDEXES.popitem(last=False)
            return _INDEXES[name]

        yield index


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, n_found, n_shingles, containment): items of which a share >= threshold lies in a row.

    Words are runs of ASCII letters and digits and of characters beyond ASCII, in lower case.  Null or
    wordless texts match nothing.  Items under five words match rows in which their words stand side by side.
    Repeated rows and repeated items are all reported.  Empty inputs give an empty result.
    """
    out = None
    for index_of in _indexes(items, block):

        def make(index_of=index_of):
            index = index_of()

            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                rows = [
                    (d, index.ids[i], found, n, found / n)
                    for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    for i, found, n in index.find(t, threshold)
                ]
                cols = list(zip(*rows)) or [[]] * 5
                types = [pa.int64()] * 4 + [pa.float64()]
                return pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "item_id", "n_found", "n_shingles", "containment"]
                )

            return step

        part = map_texts(
            narrow(docs, "doc_id", "text"), make, "doc_id long, item_id long, n_found long, n_shingles long, containment double"
        )
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``docs`` without the rows that contain a benchmark item; all columns are kept as they are."""
    at = docs.columns.index("text")
    for index_of in _indexes(items, block):

        def make(index_of=index_of):
            index = index_of()

            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                return batch.filter(pa.array([not index.find(t, threshold) for t in batch.column(at).to_pylist()], pa.bool_()))

            return step

        docs = map_texts(docs, make, docs.schema)
    return docs


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+') AS ws FROM documents
), d AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w
), ds AS (SELECT DISTINCT doc_id, s FROM d),
bw AS (
  SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+') AS ws FROM benchmark
), b AS (
  SELECT DISTINCT item_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM bw
), n AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY item_id),
few AS (SELECT item_id, array_to_string(ws, ' ') AS s FROM bw WHERE len(ws) BETWEEN 1 AND 4),
f AS (SELECT doc_id, item_id, count(*) AS n_found FROM ds JOIN b USING (s) WHERE item_id NOT IN (SELECT item_id FROM few) GROUP BY doc_id, item_id
  UNION ALL SELECT doc_id, item_id, 1 FROM w JOIN few ON contains(' ' || array_to_string(w.ws, ' ') || ' ', ' ' || few.s || ' '))
SELECT doc_id, item_id, n_found, n_shingles, n_found::double / n_shingles AS containment
FROM f JOIN n USING (item_id) WHERE n_found >= 0.8 * n_shingles - 1e-9
"""
