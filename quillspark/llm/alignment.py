"""Alignment of two tokenizers' tokens over the same bytes, and how often ids are linked over the corpus.

A whole Arrow batch of texts is one run of bytes in which each document has its offset.  The ends of both tokenizers'
tokens are counted once by byte; where both occur the tokens are cut into groups, and where either occurs one
stretch ends in which exactly one token of each side lies, which is one link.  Prefix sums over the run, read at the
documents' offsets, give each document's figures.

A batch is written as one row: its documents' own figures, its distinct id pairs, and for each document which of these
pairs it holds how often.  The corpus's counts are summed by pair; they come back to a batch by a join of its
distinct pairs, so what is shuffled is bounded by a batch's distinct pairs, and no table of counts is sent to all.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, slices, small_batches, stored
from .packing import Ids, vocabulary_path
from .tokens import Counter, model_path

MEMO = 400_000
_MARK = "▁"


class Bytes:
    """The bytes of each id of a vocabulary, end to end."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def spelt(self, ids: np.ndarray) -> np.ndarray:
        n = self.length[ids]
        at = np.cumsum(n) - n
        return self.flat[np.arange(n.sum()) + np.repeat(self.start[ids] - at, n)]


class ByteSide(Ids):
    """Ids of a byte-level vocabulary; special strings are plain text."""

    def __init__(self, path: str) -> None:
        super().__init__(path, MEMO)
        self.tokenizer.encode_special_tokens = True
        self.special = []
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        words = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.bytes = Bytes([bytes(byte[c] for c in w) if all(c in byte for c in w) else w.encode() for w in words])


class PieceSide:
    """Ids of a piece model, by the units that provably count alone."""

    def __init__(self, path: str) -> None:
        self.proof = Counter(path)
        self.model = self.proof.model
        sp = self.model
        spell = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(_MARK, " ").encode()
        self.bytes = Bytes([spell(i) for i in range(sp.get_piece_size())])
        self.memo: dict[str, bytes] = {}

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        units = self.proof.units(text)
        if units is None:
            return self._packed(self.model.encode(text))
        memo = self.memo
        try:
            return b"".join(map(memo.__getitem__, units))
        except KeyError:
            if len(memo) > MEMO:
                memo.clear()
            new = [u for u in set(units) if u not in memo]
            for u, ids in zip(new, self.model.encode(new, num_threads=1)):
                # the model's own mark before a line feed is not the unit's; an empty unit is a lone mark
                memo[u] = self._packed(ids[1:] if u[:1] == "\n" else ids if u else [self.model.piece_to_id(_MARK)])
            return b"".join(map(memo.__getitem__, units))


@functools.lru_cache(maxsize=1)
def sides(byte_path: str, piece_path: str) -> tuple[ByteSide, PieceSide]:
    """Both vocabularies once for each worker process."""
    return ByteSide(byte_path), PieceSide(piece_path)


@functools.lru_cache(maxsize=1)
def _decimals(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Each id's decimal digits, padded with zero bytes and room for a separator, and their number."""
    words = [str(i).encode() for i in range(most)]
    width = len(words[-1]) + 1
    table = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(most, width)
    return table, np.array(list(map(len, words)))


def _by_document(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Differences of a prefix sum at the documents' ends."""
    return np.diff(values[ends], prepend=0)


class Aligned:
    """Tokens a and b of documents whose bytes lie end to end; every document has bytes, and both sides spell them."""

    def __init__(self, sizes: np.ndarray, a: np.ndarray, a_bytes: Bytes, b: np.ndarray, b_bytes: Bytes) -> None:
        self.a, self.b, self.ends = a, b, np.cumsum(sizes)
        n = int(self.ends[-1]) + 1 if len(sizes) else 1
        self.a_ends, self.b_ends = np.cumsum(a_bytes.length[a]), np.cumsum(b_bytes.length[b])
        is_a, is_b = np.bincount(self.a_ends, minlength=n), np.bincount(self.b_ends, minlength=n)
        self.cuts = np.cumsum(is_a & is_b)
        self.upto_a, self.upto_b = np.cumsum(is_a), np.cumsum(is_b)
        stretches = is_a | is_b
        self.stretch_ends = np.flatnonzero(stretches)
        self.n_a, self.n_b = _by_document(self.upto_a, self.ends), _by_document(self.upto_b, self.ends)
        self.n_groups, self.n_links = _by_document(self.cuts, self.ends), _by_document(np.cumsum(stretches), self.ends)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """The a and the b id of each link, in order."""
        return self.a[self.upto_a[self.stretch_ends - 1]], self.b[self.upto_b[self.stretch_ends - 1]]

    def digests(self) -> list[str]:
        """SHA-256 of each document's groups, written ``a1,a2|b1;a3|b2``."""
        group_a, group_b = self.cuts[self.a_ends - 1], self.cuts[self.b_ends - 1]
        groups = int(self.cuts[-1])
        in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        place_a = np.arange(len(self.a)) + (np.cumsum(in_b) - in_b)[group_a]
        place_b = np.arange(len(self.b)) + np.cumsum(in_a)[group_b]
        ids, after = np.empty(len(self.a) + len(self.b), np.int64), np.full(len(self.a) + len(self.b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = self.a, self.b
        after[place_a[np.cumsum(in_a) - 1]] = ord("|")
        after[place_b[np.cumsum(in_b) - 1]] = ord(";")
        table, digits = _decimals(1 << max(16, int(ids.max(initial=0)).bit_length()))
        shown, width = table[ids], digits[ids]
        shown[np.arange(len(ids)), width] = after
        flat = memoryview(np.ascontiguousarray(shown.ravel()[shown.ravel() != 0]))
        ends = np.cumsum(width + 1)[np.cumsum(self.n_a + self.n_b) - 1].tolist()
        return [hashlib.sha256(flat[at : end - 1]).hexdigest() for at, end in zip([0, *ends[:-1]], ends)]


def _agreed(raw: list[bytes], tokens: list[list[np.ndarray]], spelt: list[Bytes]) -> np.ndarray:
    """Which documents both sides spell exactly."""
    fine = np.array([len(r) > 0 for r in raw], bool)
    for side, table in zip(tokens, spelt):
        fine &= np.array([int(table.length[t].sum()) for t in side]) == np.array([len(r) for r in raw])
    at = np.flatnonzero(fine)
    if not len(at):
        return at
    sizes = np.array([len(raw[i]) for i in at])
    given, starts = np.frombuffer(b"".join(raw[i] for i in at), np.uint8), np.cumsum(sizes) - sizes
    same = np.ones(len(at), bool)
    for side, table in zip(tokens, spelt):
        same &= np.logical_and.reduceat(table.spelt(np.concatenate([side[i] for i in at])) == given, starts)
    return at[same]


_BLOCK = (
    "block long, doc_id array<{id}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
    "groups_sha256 array<string>, pair array<long>, links array<long>, held binary, n_held array<int>"
)


def encoded(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """One row for each Arrow batch of documents; see the module's text."""
    small_batches(docs.sparkSession)
    docs = narrow(docs, "doc_id", "text")
    schema = _BLOCK.format(id=dict(docs.dtypes)["doc_id"])
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_side, b_side = sides(byte_path or vocabulary_path(), piece_path or model_path())
        n_b = len(b_side.bytes.length)
        block, press = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor()
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            raw = [f" {t}".encode() if t else b"" for t in texts]
            a = [np.frombuffer(a_side(f" {t}"), "<u4") if t else np.empty(0, "<u4") for t in texts]
            b = [np.frombuffer(b_side(t), "<u4") if t else np.empty(0, "<u4") for t in texts]
            fine = _agreed(raw, [a, b], [a_side.bytes, b_side.bytes])
            figures, digests = np.zeros((5, len(texts)), np.int64), [""] * len(texts)
            pairs = links = np.empty(0, np.int64)
            held = b""
            if len(fine):
                sizes = np.array([len(raw[i]) for i in fine])
                all_a, all_b = (np.concatenate([side[i] for i in fine]).astype(np.int64) for side in (a, b))
                x = Aligned(sizes, all_a, a_side.bytes, all_b, b_side.bytes)
                left, right = x.links()
                # (document, pair) in one number: sorted, equal ones stand together
                key = np.repeat(np.arange(len(fine)), x.n_links) << 44 | (left * n_b + right)
                key.sort()
                first = np.flatnonzero(np.diff(key, prepend=-1))
                times, key = np.diff(np.append(first, len(key))), key[first]
                own = key & ((1 << 44) - 1)
                pairs = np.unique(own)
                at = np.searchsorted(pairs, own)
                links = np.bincount(at, weights=times).astype(np.int64)
                figures[:4, fine] = x.n_a, x.n_b, x.n_groups, x.n_links
                figures[4, fine] = np.bincount(key >> 44, minlength=len(fine))
                for i, digest in zip(fine, x.digests()):
                    digests[i] = digest
                held = press.compress(np.stack([np.diff(at, prepend=0), times]).astype("<i4").tobytes())
            one = lambda v, t: pa.array([v], pa.list_(t))
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0))
            columns = [pa.array([block]), ids, *(one(f, pa.int64()) for f in figures[:4]), one(digests, pa.string())]
            columns += [one(pairs, pa.int64()), one(links, pa.int64()), pa.array([held], pa.binary()), one(figures[4], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names)
            block += 1

    return docs.mapInArrow(run, schema)


def link_counts(blocks: DataFrame, n_pieces: int) -> DataFrame:
    """(pair, count, best): links of each id pair in the corpus, and whether no pair of its b id has more."""
    each = blocks.select(F.explode(F.arrays_zip("pair", "links")).alias("x")).select("x.pair", "x.links")
    counts = each.groupBy("pair").agg(F.sum("links").alias("count")).withColumn("b", F.col("pair") % n_pieces)
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row.

    Null and empty texts, and texts that either vocabulary does not spell exactly, have zeros and ''.  Repeated rows
    count as often as they come, null ids as others; an empty table gives an empty result; further columns are ignored.
    """
    kind = dict(docs.dtypes)["doc_id"]
    blocks = stored(encoded(docs, byte_path, piece_path), "aligned")
    counts = link_counts(blocks, _pieces(piece_path or model_path()))
    each = blocks.select("block", F.posexplode("pair").alias("pos", "pair")).join(counts, "pair")
    # a pair's count and whether it is best in one number
    valued = each.groupBy("block").agg(F.collect_list(F.struct("pos", (F.col("count") * 2 + F.col("best").cast("long")).alias("v"))).alias("values"))
    own = blocks.select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "held", "n_held")
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            flat = {n: row[n].flatten() for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_held")}
            best = total = np.zeros(batch.num_rows and len(flat["doc_id"]), np.int64)
            if row["values"][0].is_valid:
                values = row["values"].flatten()
                v = np.empty(len(values), np.int64)
                v[values.field("pos").to_numpy()] = values.field("v").to_numpy()
                delta, times = np.frombuffer(zstandard.decompress(row["held"][0].as_py()), "<i4").reshape(2, -1).astype(np.int64)
                v, ends = v[np.cumsum(delta)], np.cumsum(flat["n_held"].to_numpy())
                total = np.diff(np.append(0, np.cumsum((v >> 1) * times))[ends], prepend=0)
                best = np.diff(np.append(0, np.cumsum((v & 1) * times))[ends], prepend=0)
            made = {**flat, "n_best": pa.array(best), "count_sum": pa.array(total)}
            yield pa.RecordBatch.from_arrays([made[n] for n in names], names)

    return own.join(valued, "block", "left").mapInArrow(run, schema)


@functools.lru_cache(maxsize=4)
def _pieces(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()
