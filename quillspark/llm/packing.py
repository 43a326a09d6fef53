"""Hierarchical multi-length packing into windows of 256, 512, 1024 and 2048 tokens.

A document's ids (with an end id) are cut into whole windows of 2048 and one rest.  The rest goes to the tier
of its size: up to 256, 512, 1024 or 2048.  Each tier is packed into windows of its own size, the longest tier
first.  A window is opened by the longest piece of its tier; its gap takes the longest pieces of the same or
shorter tiers that fit, and last a piece cut off a longer one of these tiers, so that windows are full.  A tier
whose pieces and all shorter ones fill no window waits for the next round.  What remains of a partition is
laid out in sequences of falling powers of two, which need no padding.  Sequences of a round are dealt to step groups in
serpentine order of their attention cost (the sum of squared piece lengths).

Packing is map-only: a task packs the rows it reads, in rounds of bounded size, so nothing is shuffled and
an executor that is lost repeats its own partitions only.
"""

from __future__ import annotations

import bisect
import functools
import re
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import narrow, slices, small_batches

WINDOW = 2048
TIERS = (256, 512, 1024, 2048)
END = 1
ROUND = 1 << 20  # tokens of rests that are packed together
STEP = 8  # sequences of a step group
MEMO = 600_000
_END_BYTES = END.to_bytes(4, "little")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# The library's pre-tokens, spelt out for texts of characters up to U+00FF.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_PRE = re.compile(f"'(?:[sdmt]|ll|ve|re)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_BEYOND = re.compile("[^\x00-\xff]")


class Ids:
    """Ids of a text as little-endian 32-bit words.

    A text is the concatenation of its pre-tokens' ids, and a pre-token is merged once while the bounded memo
    holds it.  Texts with characters beyond U+00FF or with a special string are encoded whole.
    """

    def __init__(self, path: str, memo: int = MEMO) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo: dict[str, bytes] = {}
        self.limit = memo
        self.merge = self._merges(path)

    def _merges(self, path: str):
        """The same vocabulary in a faster library, if its file lies beside the first and gives every token the same id."""
        import base64
        import os

        ranked = re.sub(r"\.json$", ".tiktoken", path)
        if ranked == path or not os.path.exists(ranked):
            return lambda unit: self.tokenizer.encode(unit, add_special_tokens=False).ids
        import public_tokenizers
        import tiktoken

        with open(ranked, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        # a byte's character in the vocabulary: itself if it is printable, else the next one from U+0100 on
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        letter = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}
        ids = self.tokenizer.get_vocab()
        if any(ids.get("".join(map(letter.__getitem__, token))) != rank for token, rank in ranks.items()):
            return lambda unit: self.tokenizer.encode(unit, add_special_tokens=False).ids
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _whole(self, text: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not text.isascii() and _BEYOND.search(text) or any(s in text for s in self.special):
            return self._whole(text)
        memo, units = self.memo, _PRE.findall(text)
        try:
            return b"".join(map(memo.__getitem__, units))
        except KeyError:
            if len(memo) > self.limit:
                memo.clear()
            for unit in units:
                if unit not in memo:
                    memo[unit] = b"".join([i.to_bytes(4, "little") for i in self.merge(unit)])
            return b"".join(map(memo.__getitem__, units))


@functools.lru_cache(maxsize=1)
def ids_for(path: str) -> Ids:
    """One memo for each worker process, kept from task to task."""
    return Ids(path)


class _Piece:
    __slots__ = ("doc", "start", "ids", "total")

    def __init__(self, doc, start: int, ids: bytes, total: int) -> None:
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    @property
    def length(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple["_Piece", "_Piece"]:
        return _Piece(self.doc, self.start, self.ids[: 4 * n], self.total), _Piece(self.doc, self.start + n, self.ids[4 * n :], self.total)


class Pool:
    """Rests in order of length, in one list for each tier."""

    def __init__(self) -> None:
        self.tiers: list[list[tuple[int, int, _Piece]]] = [[] for _ in TIERS]
        self.held = [0] * len(TIERS)  # tokens of each tier
        self.made = 0

    @property
    def tokens(self) -> int:
        return sum(self.held)

    def add(self, piece: _Piece) -> None:
        self.made += 1
        tier = bisect.bisect_left(TIERS, piece.length)
        self.held[tier] += piece.length
        bisect.insort(self.tiers[tier], (piece.length, -self.made, piece))

    def _pop(self, tier: int, at: int) -> _Piece:
        n, _, piece = self.tiers[tier].pop(at)
        self.held[tier] -= n
        return piece

    def take(self, most: int) -> _Piece | None:
        """The longest piece of at most ``most`` tokens, the first come of equals; longer tiers are searched first."""
        for tier in reversed(range(len(TIERS))):
            at = bisect.bisect_left(self.tiers[tier], (most + 1, -1 << 62))
            if at:
                return self._pop(tier, at - 1)
        return None

    def cut(self, n: int, last: int = len(TIERS) - 1) -> _Piece | None:
        """``n`` tokens off the shortest piece of the tiers up to ``last`` that is longer."""
        for tier in range(last + 1):
            at = bisect.bisect_left(self.tiers[tier], (n + 1, -1 << 62))
            if at < len(self.tiers[tier]):
                head, tail = self._pop(tier, at).cut(n)
                self.add(tail)
                return head
        return None

    def windows(self, tier: int) -> list[list[_Piece]]:
        """Full windows of a tier's size, each opened by a piece of the tier; only it and shorter tiers are used."""
        made, size = [], TIERS[tier]
        while self.tiers[tier] and sum(self.held[: tier + 1]) >= size:
            out = [self._pop(tier, len(self.tiers[tier]) - 1)]
            gap = size - out[0].length
            while gap:
                piece = self.take(gap) or self.cut(gap, tier)
                out.append(piece)
                gap -= piece.length
            made.append(out)
        return made

    def sequence(self, size: int) -> list[_Piece]:
        """A full sequence of ``size`` tokens; there must be as many."""
        out: list[_Piece] = []
        gap = size
        while gap:
            piece = self.take(gap) or self.cut(gap)
            out.append(piece)
            gap -= piece.length
        return out


def _dealt(sequences: list[list[_Piece]], first_group: int) -> list[tuple[int, list[_Piece]]]:
    """Step groups of ``STEP`` sequences with near-equal attention cost: serpentine order of cost."""
    n = -(-len(sequences) // STEP)
    cost = [sum(p.length**2 for p in s) for s in sequences]
    order = sorted(range(len(sequences)), key=lambda i: (-cost[i], i))
    group = [0] * len(sequences)
    for rank, i in enumerate(order):
        lap, at = divmod(rank, n)
        group[i] = first_group + (at if lap % 2 == 0 else n - 1 - at)
    return list(zip(group, sequences))


def pack_stream(docs, window: int = WINDOW, round_tokens: int = ROUND):
    """Yields rounds of (step group, tier, pieces) over (doc, ids with the end id)."""
    pool, group = Pool(), 0
    ready: list[tuple[int, list[_Piece]]] = []

    def fill():
        for tier in reversed(range(len(TIERS))):
            ready.extend((TIERS[tier], pieces) for pieces in pool.windows(tier))

    def flush():
        nonlocal ready, group
        out = []
        for size in sorted({s for s, _ in ready}, reverse=True):
            dealt = _dealt([p for s, p in ready if s == size], group)
            group += -(-len(dealt) // STEP)
            out += [(g, size, pieces) for g, pieces in dealt]
        ready = []
        return out

    pending = 0
    for doc, ids in docs:
        total = len(ids) // 4
        whole = total - total % window
        for at in range(0, whole, window):
            ready.append((window, [_Piece(doc, at, ids[4 * at : 4 * (at + window)], total)]))
        if whole < total:
            pool.add(_Piece(doc, whole, ids[4 * whole :], total))
        pending += total
        if pending >= round_tokens:
            fill()
            pending = 0
            yield flush()
    fill()
    size = window
    while pool.tokens:
        size //= 2
        if pool.tokens >= size:
            ready.append((size, pool.sequence(size)))
    yield flush()


SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier int, step_group long"
)
_TYPES = [pa.int64()] * 7 + [pa.int32(), pa.int64()]


def pack(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    ``tier`` is the length of the piece's sequence: that of its tier, or a power of two at a partition's end; every
    sequence is full, so nothing is padded.  Null text counts as empty and packs its end id alone.
    Repeated rows and null ids are packed as they come.  ``with_ids`` adds the ids (array<int>).
    An empty table gives an empty result; further columns are ignored.
    """
    small_batches(docs.sparkSession)
    schema = SCHEMA + (", ids array<int>" if with_ids else "")

    def run(batches):
        encode = ids_for(path or vocabulary_path())
        base = TaskContext.get().partitionId() << 32
        sequence = base

        def rows():
            for batch in slices(batches):
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    yield doc, encode(text) + _END_BYTES

        for made in pack_stream(rows()):
            out = []
            for group, tier, pieces in made:
                offset = 0
                for p in pieces:
                    row = (p.doc, p.start, p.length, zlib.crc32(p.ids), p.total, sequence, offset, tier, base + group)
                    out.append(row + ((list(memoryview(p.ids).cast("I")),) if with_ids else ()))
                    offset += p.length
                sequence += 1
            if out:
                types = [*_TYPES, *([pa.list_(pa.int32())] if with_ids else [])]
                names = [x.split()[0] for x in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return narrow(docs, "doc_id", "text").mapInArrow(run, schema)
