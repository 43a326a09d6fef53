"""Removal of repeated passages by matching statistics against run-compressed Burrows-Wheeler transforms.

A byte goes if a string of WINDOW bytes around it also starts in a document with a smaller id.  Texts cannot all be
held against all, so what can match is first brought together:

* A document is cut into pieces: runs of windows with one smallest hash of ANCHOR bytes, the piece's anchor.  Equal
  windows have equal anchors, so they meet under it wherever they stand.
* Rows (anchor, hash of the piece, id) are sorted by anchor.  Equal pieces are one entry, held by the smallest id: it
  stands for all copies, whose windows all start in a smaller document.  A piece that is alone under its anchor can match
  nothing but itself.  All other entries go to an index.
* Entries of whole anchors make a block.  Those that have the bytes of no other on either side of the anchor can match
  nothing.  Of the others a transform is built and run-compressed, with the text's place sampled at both ends of each run.  The entries are streamed through it backwards: a letter that stands in the present row's run
  is followed, for another the nearest runs of it above and below are tried at their sampled ends, and the longer match
  goes on.  Where a match has WINDOW bytes, the smallest id among all rows with these bytes decides.

An anchor with many entries is split by the bytes before it and by those behind it (whichever of them fill more of a
window), so it is spread over tasks and no match is lost.  Copies are pre-aggregated in each Arrow batch before the shuffle.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, release, slices, small_batches, stored

WINDOW = 50
ANCHOR = 16
SEGMENT = 1 << 18  # bytes that are hashed at once, so that they stay in cache
BLOCK = 1 << 19  # bytes of entries that are looked at together; one anchor's entries are never parted
HOT = 2048  # entries of an anchor above which it is split
_SIDE = (WINDOW - ANCHOR) // 2  # bytes beside the anchor that every window of one half has
_STOP = 0xFF  # in no UTF-8 text

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _A
    x ^= x >> np.uint64(31)
    x *= _C
    x ^= x >> np.uint64(29)
    return x


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    out = []
    for x in (base, inverse):
        run = np.full(n, x, np.uint64)
        run[0] = 1
        out.append(np.multiply.accumulate(run))
    return out[0], out[1]


def _words(data: bytes) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,)).astype(np.uint64)


def anchors(words: np.ndarray) -> np.ndarray:
    """The hash of the ANCHOR bytes from each place on."""
    return _mixed(_mixed(words[: max(0, len(words) - ANCHOR + 8)]) ^ words[ANCHOR - 8 :] * _B)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The smallest of ``width`` numbers from each place on."""
    span = 1
    while span * 2 <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - (width - span)], h[width - span :]) if span < width else h


class Pieces:
    """The pieces of texts that lie end to end: the text's number, start in it, windows, anchor and identity."""

    def __init__(self, texts: list[bytes]) -> None:
        data, sizes = b"".join(texts), np.array(list(map(len, texts)), np.int64)
        self.text = self.start = self.windows = np.empty(0, np.int64)
        self.anchor = self.hash = np.empty(0, np.uint64)
        if len(data) < WINDOW:
            return
        words = _words(data)
        least = _least(anchors(words), WINDOW - ANCHOR + 1)
        ends = np.cumsum(sizes)
        text = np.repeat(np.arange(len(texts)), sizes)[: len(least)]
        inside = np.flatnonzero(np.arange(len(least)) <= (ends - WINDOW)[text])
        if not len(inside):
            return
        least, text = least[inside], text[inside]
        fresh = np.ones(len(inside), bool)
        fresh[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(fresh)
        at = inside[first]
        self.windows = np.diff(np.append(first, len(inside)))
        self.text, self.anchor = text[first], least[first]
        self.start = at - (ends - sizes)[self.text]
        size = 1 << max(18, len(data).bit_length())
        power, back = _powers(size)
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(_mixed(words) * power[: len(words)], out=sums[1:])
        whole = (sums[at + self.windows + WINDOW - 8] - sums[at]) * back[at]
        self.hash = _mixed(whole ^ self.windows.astype(np.uint64))

    def keys(self) -> np.ndarray:
        """One even number for anchor and piece, which tells a document's pieces apart."""
        return key_of(self.anchor, self.hash)


def key_of(anchor: np.ndarray, piece: np.ndarray) -> np.ndarray:
    return (_mixed(anchor ^ piece * _B) & ~np.uint64(1)).view(np.int64)


def _segments(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first, texts) of at most SEGMENT bytes, or of one longer text."""
    at = held = 0
    for i, text in enumerate(texts):
        if held + len(text) > SEGMENT and i > at:
            yield at, texts[at:i]
            at, held = i, 0
        held += len(text)
    if at < len(texts):
        yield at, texts[at:]


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _from(rank: np.ndarray, at: int) -> np.ndarray:
    """Ranks from ``at`` places further on; 0 behind the end."""
    return np.append(rank[at:] + 1, np.zeros(min(at, len(rank)), rank.dtype))


def _ranked(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, dense ranks) of places by one to three keys."""
    if len(keys) == 1 or len(keys[0]) < (1 << 21) - 1:
        key = keys[0].astype(np.uint64)
        for more in keys[1:]:
            key = (key << np.uint64(21)) | more.astype(np.uint64)
        order = np.argsort(key)
        step = np.diff(key[order], prepend=key[order[:1]]) != 0
    else:
        order = np.lexsort(keys[::-1])
        step = np.append(False, np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(step)
    return order, rank


class RunIndex:
    """A run-compressed transform of ``texts``, whose owners are numbers; rows are in order of their first 72 bytes."""

    def __init__(self, texts: list[bytes], owners: np.ndarray) -> None:
        sizes = np.array(list(map(len, texts)), np.int64) + 1
        data = bytes([_STOP]).join([*texts, bytes([_STOP]) * (80 + WINDOW)])
        n = int(sizes.sum())
        self.text, self.words = np.frombuffer(data, np.uint8), _words(data)
        order, rank = _ranked(np.ndarray((n,), ">u8", data, strides=(1,)).astype(np.uint64))
        order, by24 = _ranked(*(_from(rank, at) for at in (0, 8, 16)))
        row, _ = _ranked(*(_from(by24, at) for at in (0, 24, 48)))  # order of 72 bytes
        same = np.ones(n - 1, bool)
        for at in (0, 24, WINDOW - 24):
            some = _from(by24, at)[row]
            same &= some[1:] == some[:-1]
        fresh = np.append(True, ~same)
        self.class_start = np.flatnonzero(fresh)
        owner = np.repeat(owners, sizes)[row]
        self.class_owner = np.minimum.reduceat(owner, self.class_start)
        self.class_of = np.cumsum(fresh) - 1
        letter = self.text[row - 1]
        letter[row == 0] = _STOP
        change = np.ones(n, bool)
        change[1:] = letter[1:] != letter[:-1]
        self.run_start = np.flatnonzero(change)
        run_end = np.append(self.run_start[1:], n)
        self.run_letter = letter[self.run_start].astype(np.int64)
        self.head, self.tail = row[self.run_start], row[run_end - 1]  # the sampled ends
        self.run_end = run_end - 1
        self.run_of = np.cumsum(change) - 1
        # the rows of the texts' last windows
        place = np.empty(n, np.int64)
        place[row] = np.arange(n)
        self.last_row = place[np.maximum(np.cumsum(sizes) - 1 - WINDOW, 0)]
        # where a run's rows go: letters in order, then runs in order
        by_letter = np.argsort(self.run_letter, kind="stable")
        length = run_end - self.run_start
        self.run_to = np.empty(len(length), np.int64)
        self.run_to[by_letter] = np.cumsum(length[by_letter]) - length[by_letter]
        self.letter_runs = (self.run_letter[by_letter] << 32) | by_letter

    def _common(self, at: np.ndarray, words: np.ndarray, place: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal bytes of the text from ``at`` and of other data from ``place``, at most ``most``; eight at a time."""
        out, alive = np.zeros(len(at), np.int64), np.flatnonzero(most > 0)
        for k in range(0, WINDOW, 8):
            differs = self.words[at[alive] + k] ^ words[place[alive] + k]
            equal = differs == 0
            low = differs & (~differs + np.uint64(1))  # the lowest bit that differs
            out[alive] += np.where(equal, 8, np.log2(np.where(equal, np.uint64(1), low).astype(np.float64)).astype(np.int64) // 8)
            alive = alive[equal & (most[alive] > k + 8)]
            if not len(alive):
                break
        return np.minimum(out, most)

    def stream(self, texts: list[bytes], own: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Yields (text, place, matched bytes, owner), for one place of each text at a time, from the last place on.

        The match is the longest one of the bytes from the place on, counted up to WINDOW; the owner is the smallest
        of all texts of the index with these WINDOW bytes, and says nothing for a shorter match.  ``own``: the texts are those of
        the index, each at least WINDOW bytes long, and start at their last windows, whose rows are sampled.
        """
        sizes = np.array(list(map(len, texts)), np.int64)
        order = np.argsort(-sizes, kind="stable")
        joined = b"".join(texts) + bytes(WINDOW + 8)
        data, words = np.frombuffer(joined, np.uint8), _words(joined)
        ends, starts = np.cumsum(sizes)[order], (np.cumsum(sizes) - sizes)[order]
        row, match = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        first = 1
        if own:
            row, match, first = self.last_row[order], np.full(len(texts), WINDOW), WINDOW + 1
            yield order, sizes[order] - WINDOW, match.copy(), self.class_owner[self.class_of[row]]
        for step in range(first, int(sizes.max(initial=0)) + 1):
            n = int(np.searchsorted(-sizes[order], -step, "right"))
            place, q, m = ends[:n] - step, row[:n], match[:n]
            letter = data[place].astype(np.int64)
            run = self.run_of[q]
            off = np.flatnonzero(self.run_letter[run] != letter)
            if len(off):
                c = letter[off]
                after = np.searchsorted(self.letter_runs, (c << 32) | run[off])
                best, to, into = np.full(len(off), -1), np.zeros(len(off), np.int64), np.zeros(len(off), np.int64)
                for which, ends_of, rows_of in ((after - 1, self.tail, self.run_end), (after, self.head, self.run_start)):
                    known = (which >= 0) & (which < len(self.letter_runs))
                    there = self.letter_runs[np.where(known, which, 0)]
                    known &= (there >> 32) == c
                    other = there & 0xFFFFFFFF
                    common = np.where(known, self._common(ends_of[other], words, place[off] + 1, m[off]), -1)
                    better = common > best
                    best, to, into = np.where(better, common, best), np.where(better, rows_of[other], to), np.where(better, other, into)
                q[off], run[off], m[off] = to, into, best
            q[:] = np.where(m >= 0, self.run_to[run] + q - self.run_start[run], 0)
            np.minimum(m + 1, WINDOW, out=m)
            yield order[:n], place - starts[:n], m.copy(), self.class_owner[self.class_of[q]]


def _occurring(docs: DataFrame) -> DataFrame:
    """(settled, anchor, piece, id): each document's distinct pieces; a copy of a smaller id in its batch is settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, texts = batch.column(0).to_numpy(), _bytes(batch.column(1))
            found = [(at, Pieces(some)) for at, some in _segments(texts)]
            anchor, piece = np.concatenate([p.anchor for _, p in found]), np.concatenate([p.hash for _, p in found])
            owner = ids[np.concatenate([at + p.text for at, p in found])]
            # most pieces stand once in a batch; only the others are put in order of the document, too
            key = key_of(anchor, piece)
            order = np.argsort(key)
            equal = np.append(False, key[order][1:] == key[order][:-1])
            several = equal | np.append(equal[1:], False)
            again = order[several]
            order = np.concatenate([order[~several], again[np.lexsort((owner[again], piece[again], anchor[again]))]])
            anchor, piece, owner = anchor[order], piece[order], owner[order]
            fresh = np.ones(len(order), bool)
            fresh[1:] = (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])
            again = ~fresh
            again[1:] &= owner[1:] == owner[:-1]  # the same piece of the same document
            keep = ~again
            columns = [(~fresh)[keep].astype(np.int64), anchor[keep].view(np.int64), piece[keep].view(np.int64), owner[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["settled", "anchor", "piece", "id"])

    return docs.where("id is not null").mapInArrow(run, "settled long, anchor long, piece long, id long")


def _sorted_out(rows: DataFrame, hot: int) -> DataFrame:
    """(id, key) of pieces that matter, from rows sorted by settled, anchor, piece and id.

    An even key is a piece that a smaller document has too; an odd one is the first of its copies, for the index.  A
    null id names an anchor with more than ``hot`` distinct pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_anchor = last_piece = holder = None
        pending = None  # (id, key) of an anchor's first piece until a second one comes
        entries = 0  # distinct pieces of the anchor so far

        def made(ids: list, keys: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64())], ["id", "key"])

        for batch in slices(batches, 1 << 16):
            settled, anchor, piece, ids = (c.to_numpy() for c in batch.columns)
            keys = key_of(anchor.view(np.uint64), piece.view(np.uint64))
            out_ids, out_keys = [ids[settled == 1]], [keys[settled == 1]]
            live = settled == 0
            anchor, piece, ids, keys = anchor[live], piece[live], ids[live], keys[live]
            n = len(ids)
            if n:
                new_anchor, new_piece = np.ones(n, bool), np.ones(n, bool)
                new_anchor[1:] = anchor[1:] != anchor[:-1]
                new_anchor[0] = anchor[0] != last_anchor
                new_piece[1:] = new_anchor[1:] | (piece[1:] != piece[:-1])
                new_piece[0] = new_anchor[0] or piece[0] != last_piece
                first = np.flatnonzero(new_piece)
                # copies: the holder's id is that of the piece's first row
                owner = np.append(holder if holder is not None else 0, ids[first])[np.cumsum(new_piece)]
                copy = ~new_piece & (ids != owner)
                out_ids.append(ids[copy])
                out_keys.append(keys[copy])
                if len(first):
                    # entries: all but pieces that are alone; the last piece waits if it is the first of its anchor
                    if pending and not new_anchor[first[0]]:
                        out_ids.append(np.array(pending[:1]))
                        out_keys.append(np.array(pending[1:]) | 1)
                    alone = new_anchor[first] & np.append(new_anchor[first[1:]], True)
                    go = first[~alone]
                    out_ids.append(ids[go])
                    out_keys.append(keys[go] | 1)
                    pending = (int(ids[first[-1]]), int(keys[first[-1]])) if alone[-1] else None
                # distinct pieces by anchor, over batches
                starts = np.flatnonzero(new_anchor)
                upto = np.cumsum(new_piece)
                bounds = np.append(starts, n)
                if not new_anchor[0]:
                    lead = int(upto[bounds[0] - 1])
                    if entries <= hot < entries + lead:
                        out_ids.append(None)
                        out_keys.append(np.array([anchor[0]]))
                    entries += lead
                if len(starts):
                    count = upto[bounds[1:] - 1] - upto[starts] + 1
                    entries = int(count[-1])
                    many = starts[count > hot]
                    if len(many):
                        out_ids.append(None)
                        out_keys.append(anchor[many])
                last_anchor, last_piece, holder = anchor[-1], piece[-1], int(ids[first[-1]]) if len(first) else holder
            for i, k in zip(out_ids, out_keys):
                if len(k):
                    yield made([None] * len(k) if i is None else i, k)

    return rows.mapInArrow(run, "id long, key long")


class Wanted:
    """Keys of some texts' pieces, looked up for a segment of texts at once."""

    def __init__(self, lists: pa.Array, odd: bool) -> None:
        keys, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        chosen = (keys & 1) == int(odd)
        self.keys, self.owner = keys[chosen] - int(odd), owner[chosen]

    def among(self, at: int, n: int, pieces: Pieces) -> np.ndarray:
        """Places of the pieces of texts ``at`` to ``at + n`` whose keys are wanted of their text."""
        low, high = np.searchsorted(self.owner, [at, at + n])
        own = (self.owner[low:high] - at).astype(np.uint64) * _A + self.keys[low:high].view(np.uint64)
        return np.flatnonzero(np.isin(pieces.text.astype(np.uint64) * _A + pieces.keys().view(np.uint64), own))


_ENTRY = "anchor long, id long, version long, start array<int>, body binary"


def _entries(joined: DataFrame) -> DataFrame:
    """The bytes of the pieces that go to an index, from (id, text, keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            batch = batch.filter(batch.column(2).is_valid())
            if not batch.num_rows:
                continue
            ids, texts, wanted = batch.column(0).to_pylist(), _bytes(batch.column(1)), Wanted(batch.column(2), True)
            out: dict[tuple[int, int], tuple] = {}
            for at, some in _segments(texts):
                pieces = Pieces(some)
                hits = wanted.among(at, len(some), pieces)
                found = zip(*(x[hits].tolist() for x in (pieces.text, pieces.start, pieces.windows, pieces.anchor.view(np.int64), pieces.keys())))
                versions: dict[int, int] = {}
                for text, start, windows, anchor, key in found:
                    if text not in versions:
                        versions[text] = xxhash.xxh64_intdigest(some[text]) >> 1
                    if (at + text, key) in out:
                        out[at + text, key][3].append(start)
                    else:
                        out[at + text, key] = (anchor, ids[at + text], versions[text], [start], some[text][start : start + windows + WINDOW - 1])
            if out:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out.values()), types)], [x.split()[0] for x in _ENTRY.split(", ")])

    return joined.mapInArrow(run, _ENTRY)


def halves(anchor: int, body: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(group, shift, bytes): runs of windows by the bytes before their anchor, or behind it if these are more."""
    places = np.flatnonzero(anchors(_words(body)).view(np.int64) == anchor)
    runs: list[tuple[int, int, int]] = []
    for s in range(len(body) - WINDOW + 1):
        p = int(places[np.searchsorted(places, s)])
        side = b"<" + body[p - _SIDE : p] if p - s >= _SIDE else b">" + body[p + ANCHOR : p + ANCHOR + _SIDE]
        group = xxhash.xxh64_intdigest(side, seed=anchor & 0xFFFFFFFF) >> 1
        if runs and runs[-1][0] == group:
            runs[-1] = (group, runs[-1][1], s)
        else:
            runs.append((group, s, s))
    return ((g, a, body[a : b + WINDOW]) for g, a, b in runs)


def _parted(entries: DataFrame) -> DataFrame:
    """Entries of hot anchors (first column) cut into halves, whose group stands for the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            hot = batch.filter(batch.column(0))
            for _, anchor, ids, version, start, body in zip(*(c.to_pylist() for c in hot.columns)):
                out += [(g, ids, version, [s + shift for s in start], b) for g, shift, b in halves(anchor, body)]
            if not out:
                continue
            types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["anchor", "id", "version", "start", "body"])

    return entries.mapInArrow(run, _ENTRY)


def contested(anchor: np.ndarray, data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of bodies (end to end in ``data``) can be in common with another one under their anchor.

    Such a window has the anchor at one place in both, and so the bytes before it or those behind it.  Returns for each body
    the windows (first, end) that can be such: those with the bytes before, those with the bytes behind, all or none.  Of bodies in
    which the anchor stands more than once all are taken.
    """
    words, ends = _words(data + bytes(WINDOW)), np.cumsum(sizes)
    body = np.repeat(np.arange(len(sizes)), sizes)
    here = np.flatnonzero(anchors(words)[: len(body)].view(np.int64) == anchor[body])
    here = here[here + ANCHOR <= ends[body[here]]]
    whole = np.bincount(body[here], minlength=len(sizes)) != 1
    once = here[~whole[body[here]]]
    owner = body[once]
    starts = (ends - sizes)[owner]
    shared = np.zeros((2, len(sizes)), bool)
    sides = ((once - _SIDE, once - _SIDE >= starts), (once + ANCHOR, once + ANCHOR + _SIDE <= ends[owner]))
    for hit, (first, inside) in zip(shared, sides):
        at, who = first[inside], owner[inside]
        side = _mixed(_mixed(_mixed(words[at]) ^ words[at + 8] * _B) ^ words[at + _SIDE - 8] * _C) ^ _mixed(anchor[who].view(np.uint64))
        order = np.argsort(side)
        same = side[order][1:] == side[order][:-1]
        hit[who[order[1:][same]]] = True
        hit[who[order[:-1][same]]] = True
    # windows that start up to here have the bytes before the anchor, the others those behind it
    split = np.zeros(len(sizes), np.int64)
    split[owner] = np.maximum(once - starts - _SIDE + 1, 0)
    before, behind = shared | whole
    windows = sizes - WINDOW + 1
    return np.where(before, 0, np.where(behind, split, 0)), np.where(behind, windows, np.where(before, np.minimum(split, windows), 0))


def _matched(entries: DataFrame, parted: bool = False) -> DataFrame:
    """(id, version, first, end) of bytes that a smaller document has, from entries sorted by anchor; ``parted``: by half."""

    def block(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not parted:
            body = table["body"].combine_chunks().cast(pa.large_binary())
            body = body.chunk(0) if isinstance(body, pa.ChunkedArray) else body
            ends = np.frombuffer(body.buffers()[1], np.int64)[body.offset : body.offset + len(body) + 1]
            data = body.buffers()[2].to_pybytes()[ends[0] : ends[-1]]
            first, end = contested(table["anchor"].to_numpy(), data, np.diff(ends))
            some = np.flatnonzero(end > first)
            rows = zip(*(c.to_pylist() for c in table.take(pa.array(some)).columns), first[some].tolist(), end[some].tolist())
            rows = [(anchor, ids, version, [s + a for s in starts], body[a : b + WINDOW - 1]) for anchor, ids, version, starts, body, a, b in rows]
        else:
            rows = list(zip(*(c.to_pylist() for c in table.columns)))
        if rows:
            yield from indexed(rows)

    def indexed(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        owners, bodies = np.array([r[1] for r in rows], np.int64), [r[4] for r in rows]
        windows = np.array(list(map(len, bodies))) - WINDOW + 1
        gone = np.zeros((len(rows), int(windows.max()) + 1), bool)
        for text, place, match, owner in RunIndex(bodies, owners).stream(bodies, own=True):
            hit = (match == WINDOW) & (owner < owners[text])
            gone[text[hit], place[hit]] = True
        edge = np.diff(gone.astype(np.int8), axis=1, prepend=0)
        out = []
        (text, first), (_, stop) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        for t, a, b in zip(text.tolist(), first.tolist(), stop.tolist()):
            _, ids, version, starts, _ = rows[t]
            out += [(ids, version, s + a, s + b + WINDOW - 1) for s in starts]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["id", "version", "first", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.column(4).nbytes
            if size > BLOCK:
                table = pa.Table.from_batches(held)
                anchor = table["anchor"].to_numpy()
                cut = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor's entries may go on
                if cut:
                    yield from block(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
                size = sum(b.column(4).nbytes for b in held)
        if held:
            yield from block(pa.Table.from_batches(held))

    return entries.mapInArrow(run, "id long, version long, first long, end long")


def _kept(joined: DataFrame) -> DataFrame:
    """The result, from (doc_id, text, keys, marks)."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, keys, marks = _bytes(batch.column(1)), batch.column(2), batch.column(3)
            removed, spans, digests = [0] * len(texts), [0] * len(texts), [""] * len(texts)
            cuts: dict[int, list] = {}
            chosen = np.flatnonzero(keys.is_valid().to_numpy(zero_copy_only=False))
            wanted = Wanted(keys.take(pa.array(chosen)), False)
            for at, some in _segments([texts[i] for i in chosen]):
                pieces = Pieces(some)
                hits = wanted.among(at, len(some), pieces)
                first, owner = pieces.start[hits], chosen[at + pieces.text[hits]]
                end, edges = first + pieces.windows[hits] + WINDOW - 1, np.flatnonzero(np.diff(owner, prepend=-1))
                for low, high in zip(edges, [*edges[1:], len(owner)]):
                    cuts[int(owner[low])] = [(first[low:high], end[low:high])]
            for row, found in enumerate(marks):
                if found.is_valid:
                    version, first, end = (found.values.field(n).to_numpy() for n in ("version", "first", "end"))
                    mine = version == xxhash.xxh64_intdigest(texts[row]) >> 1
                    cuts.setdefault(row, []).append((first[mine], end[mine]))
            for row, text in enumerate(texts):
                if row in cuts and any(len(a) for a, _ in cuts[row]):
                    step = np.zeros(len(text) + 1, np.int64)
                    for first, end in cuts[row]:
                        np.add.at(step, first, 1)
                        np.add.at(step, end, -1)
                    gone = np.cumsum(step)[:-1] > 0
                    removed[row], spans[row] = int(gone.sum()), int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                    text = np.frombuffer(text, np.uint8)[~gone].tobytes()
                digests[row] = hashlib.sha256(text).hexdigest()
            columns = [batch.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row.

    Null text counts as empty.  A row without an id is neither smaller nor larger than others: it is returned whole and
    takes nothing from them.  Rows of one id take nothing from each other.  An empty table gives an empty result;
    further columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = narrow(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("id"), F.col("text"))
    rows = _occurring(docs)
    # settled rows are dealt by document, all others by anchor
    dealt = rows.repartition(F.when(F.col("settled") == 1, F.xxhash64("id")).otherwise(F.col("anchor")))
    chosen = stored(_sorted_out(dealt.sortWithinPartitions("settled", "anchor", "piece", "id"), hot), "pieces")
    del rows, dealt
    release(spark)
    keys = chosen.where("id is not null").groupBy("id").agg(F.collect_list("key").alias("keys"))
    crowded = chosen.where("id is null").select(F.col("key").alias("anchor"), F.lit(True).alias("hot"))
    # both branches read the same shuffle of the texts
    joined = docs.join(keys, "id", "left")
    entries = _entries(joined.select("id", "text", "keys"))
    # entries are dealt once; only those of crowded anchors are parted and dealt again
    dealt = entries.repartition("anchor").join(crowded, "anchor", "left").select("hot", *entries.columns)
    calm, parted = dealt.where("hot is null").drop("hot"), _parted(dealt)
    marks = _matched(calm.sortWithinPartitions("anchor", "id")).unionByName(_matched(parted.repartition("anchor").sortWithinPartitions("anchor", "id"), True))
    marks = marks.groupBy("id").agg(F.collect_list(F.struct("version", "first", "end")).alias("marks"))
    return _kept(joined.join(marks, "id", "left").select("id", "text", "keys", "marks"))


# windows in hexadecimal, cut from stretches of 500 bytes; removed runs; what lies between them
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
part AS (SELECT r, doc_id, c, substr(h, (2 * c + 1)::bigint, {2 * (500 + WINDOW - 1)}) AS p
  FROM d, unnest(range(0, (length(h) // 2 - {WINDOW - 1})::bigint, 500)) u(c)),
w AS (SELECT r, doc_id, c + j AS i, substr(p, (2 * j + 1)::bigint, {2 * WINDOW}) AS s
  FROM part, unnest(range(0, (length(p) // 2 - {WINDOW - 1})::bigint)) u(j)),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
hit AS (SELECT r, i FROM w JOIN m USING (s) WHERE least < doc_id),
edge AS (SELECT r, i, (i > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i) + {WINDOW}, -1))::int AS fresh FROM hit),
runs AS (SELECT r, n, min(i) AS low, max(i) + {WINDOW} AS high FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS n FROM edge) GROUP BY r, n),
before AS (SELECT r, low, high, coalesce(lag(high) OVER (PARTITION BY r ORDER BY low), 0) AS last FROM runs),
cut AS (SELECT r, sum(high - low)::bigint AS n_removed, count(*) AS n_spans, max(high) AS last,
  string_agg(substr(h, (2 * last + 1)::bigint, (2 * (low - last))::bigint), '' ORDER BY low) AS head FROM before JOIN d USING (r) GROUP BY r)
SELECT doc_id, (length(h) // 2)::bigint AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head || substr(h, (2 * last + 1)::bigint), h))) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""
