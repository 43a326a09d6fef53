"""SimHash near-duplicate groups by bit-sliced comparison.

1. One pass over the texts gives a 64-bit fingerprint per row; only (doc_id, fingerprint) is stored.
2. Equal fingerprints collapse to one row before anything is compared, so copies cost nothing more.
3. Two fingerprints within 2 bits agree on at least two of four 16-bit blocks (pigeonhole), so each
   is dealt to six 32-bit keys.  A key with more than ``GROUP_LIMIT`` fingerprints is dealt again by
   two of four 8-bit sub-blocks of its other 32 bits, which bounds every group by 2**16 members
   whatever the data; no pair within the radius is lost.
4. Inside the groups, fingerprints lie as vertical bit planes, 64 to a machine word.  Distances of a
   fingerprint to 64 others grow together in carry-save counters, and a word is abandoned as soon
   as every lane exceeds the radius.
5. Groups emit only a spanning star for each local component; components are then joined by
   alternating large-star and small-star rounds, each written to the shared folder.

Two bits find copies with an edit or two in a long text.  With ``similarity``, rows are also linked whose sets of
``shingle``-word shingles have that Jaccard similarity: MinHash bands propose pairs and the sets verify each exactly.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, narrow, quoted, stored

RADIUS = 2
SHINGLE = 3
GROUP_LIMIT = 4096
SEED = 42
MINIMA = 100  # of a row's shingle hashes, dealt to bands
SHARE = 512  # texts that a task sets against one
MISS = 1e-5  # chance at most that a pair just at the similarity shares no band
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint_of(text: str | None) -> int:
    """Unsigned SimHash of a text: majority of the XXH64 bits of its 3-word shingles, repeats counted."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return digest(joined, SEED)
    ends = list(itertools.accumulate(map(len, words)))
    ends = [e + i for i, e in enumerate(ends)]
    starts = [0] + [e + 1 for e in ends[:-1]]
    n, counts = len(words) - SHINGLE + 1, np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        to = min(n, at + (1 << 16))
        hashes = np.array(
            [digest(joined[s:e], SEED) for s, e in zip(starts[at:to], ends[at + SHINGLE - 1 : to + SHINGLE - 1])], "<u8"
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def text_key(text: str) -> Column:
    """Stands for a text; null counts as empty."""
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, key, fp): ``fp`` is the fingerprint as a signed 64-bit integer.  Null text counts as empty."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = np.array([fingerprint_of(t) for t in batch.column(2).to_pylist()], "u8").view("i8")
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], ["doc_id", "key", "fp"])

        return step

    return map_texts(docs.select("doc_id", text_key("text").alias("key"), "text"), make, "doc_id long, key string, fp long")


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of a text's ``shingle``-word shingles; one of all words if there are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = [e + i for i, e in enumerate(itertools.accumulate(map(len, words)))]
    starts = [0] + [e + 1 for e in ends[:-1]]
    last = ends[min(shingle, len(words)) - 1 :]
    return np.unique(np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, last)), "<u8", len(last)))


_FACTORS = np.random.default_rng(20240302).integers(1, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands_of(hashes: np.ndarray, rows: int) -> list[int]:
    """Signed keys of the bands of ``rows`` minima each."""
    low = np.full(MINIMA, _ALL)
    for at in range(0, len(hashes), 1 << 14):
        mixed = hashes[at : at + (1 << 14)] * _FACTORS[:, None]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
        low = np.minimum(low, mixed.min(axis=1))
    keys = [xxhash.xxh64_intdigest(low[at : at + rows].tobytes(), at) for at in range(0, MINIMA, rows)]
    return np.array(keys, "u8").view("i8").tolist()


def band_rows(similarity: float) -> int:
    """The most minima a band with which a pair just at ``similarity`` is missed with chance ``MISS`` at most; one at least."""
    fit = [r for r in (2, 4, 5, 10, 20) if (1 - similarity**r) ** (MINIMA // r) <= MISS]
    return max(fit, default=1)


def _similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def similar_links(docs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(u, v): fingerprints of rows whose shingle sets have ``similarity`` at least, enough to connect all such rows.

    Equal texts are one.  In a band each text is set against the one with the smallest key, in tasks of ``SHARE`` texts
    however many share it; where all are similar to that one, they are connected and the band is done.  Only in the other bands
    are texts compared with each other, each until it is linked to every component there.  Bands of the same texts are
    one.  Texts travel instead of their sets, which are twice as large.
    """
    rows = band_rows(similarity)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            sets = (shingle_set(t, shingle) for t in texts)
            bands = [bands_of(x, rows) if len(x) else [] for x in sets]
            fps = np.array([fingerprint_of(t) for t in texts], "u8").view("i8")
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), pa.array(bands, pa.list_(pa.int64()))], ["key", "fp", "bands"])

        return step

    keyed = docs.select(F.unhex(text_key("text")).alias("key"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    banded = stored(map_texts(keyed, make, "key binary, fp long, bands array<long>"), "banded")
    dealt = banded.dropDuplicates(["key"]).select("key", "fp", F.explode("bands").alias("band"))
    mark = F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("mark")
    bands = dealt.groupBy("band").agg(F.min(F.struct("key", "fp")).alias("least"), F.count("*").alias("n"), mark).where("n > 1")
    bands = bands.groupBy("least", "n", "mark").agg(F.min("band").alias("band"))
    members = stored(dealt.join(bands, "band").select("band", "key", "fp", F.col("least.key").alias("other"), F.col("least.fp").alias("other_fp")), "members")
    wanted = members.select("key").union(members.select("other")).distinct()
    texts = stored(keyed.join(wanted, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")), "texts")
    pairs = members.where("key <> other").select("key", "fp", "other", "other_fp").distinct()
    checked = stored(_checked(pairs, texts, similarity, shingle), "checked")
    mixed = members.join(checked.where("not alike"), ["key", "other"], "left_semi").select("band").distinct()
    rest = members.join(mixed, "band", "left_semi").select("band", "key", "fp").join(texts, "key").select("band", "fp", "text")
    further = rest.repartition("band").sortWithinPartitions("band").mapInArrow(_compared(similarity, shingle), "u long, v long")
    return checked.where("alike and u <> v").select("u", "v").union(further)


def _checked(pairs: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(key, other, u, v, alike) of (key, fp, other, other_fp): whether the two texts' sets are similar."""
    shares = pairs.groupBy("other", "other_fp").agg((F.count("*") / SHARE).cast("int").alias("shares"))
    heads = shares.select("other", "other_fp", F.explode(F.sequence(F.lit(0), F.col("shares"))).alias("share")).join(texts.withColumnRenamed("key", "other"), "other")
    heads = heads.select("other", "share", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("key"), F.lit(None).cast("long").alias("fp"), "other_fp", "text")
    dealt = pairs.join(shares.drop("other_fp"), "other").withColumn("share", F.pmod(F.xxhash64("key"), F.col("shares") + 1).cast("int"))
    rows = dealt.join(texts, "key").select("other", "share", F.lit(1).alias("kind"), "key", "fp", "other_fp", "text")
    both = heads.unionByName(rows).repartition("other", "share").sortWithinPartitions("other", "share", "kind")

    def run(batches):
        least = None
        for batch in batches:
            out = []
            for other, _, kind, key, fp, other_fp, text in zip(*(c.to_pylist() for c in batch.columns)):
                own = shingle_set(text, shingle)
                if kind == 0:
                    least = own
                else:
                    out.append((key, other, fp, other_fp, _similar(own, least, similarity)))
            if out:
                types = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["key", "other", "u", "v", "alike"])

    return both.mapInArrow(run, "key binary, other binary, u long, v long, alike boolean")


def _compared(similarity: float, shingle: int):
    """Links between the texts of a band, over rows (band, fp, text) sorted by band."""

    def run(batches):
        band, parts = None, []
        for batch in batches:
            out = set()
            for b, fp, text in zip(*(c.to_pylist() for c in batch.columns)):
                if b != band:
                    band, parts = b, []
                own = shingle_set(text, shingle)
                joined, apart = [(fp, own)], []
                for part in parts:
                    hit = next((other for other, x in part if _similar(own, x, similarity)), None)
                    if hit is None:
                        apart.append(part)
                    else:
                        joined = part + joined
                        out.add((fp, hit))
                parts = [*apart, joined]
            out = [x for x in out if x[0] != x[1]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["u", "v"])

    return run


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints (a multiple of 64 of them): row w, column b holds bit b of lanes 64w..64w+63."""
    lanes = np.ascontiguousarray(fps, "<u8").view(np.uint8).reshape(-1, 64, 8)
    bits = np.unpackbits(lanes, axis=2, bitorder="little")
    packed = np.packbits(np.ascontiguousarray(bits.transpose(0, 2, 1)), axis=2, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8").reshape(-1, 64)


def within_radius(queries: np.ndarray, planes: np.ndarray, word: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each query and the word of planes it is set against, the lanes within ``radius`` bits.

    Two carry-save counter bits and one overflow bit hold 64 distances at once (radius up to 3).
    Every eight planes the entries whose 64 lanes all exceed the radius are dropped.
    """
    out = np.zeros(len(queries), np.uint64)
    live = np.arange(len(queries))
    one, two, over = (np.zeros(len(queries), np.uint64) for _ in range(3))
    q, w = queries, word
    for b in range(64):
        differs = planes[w, b] ^ ((q >> np.uint64(b) & np.uint64(1)) * _ALL)
        carry = one & differs
        one ^= differs
        over |= two & carry
        two ^= carry
        if b % 8 == 7:
            exceeds = over | _exceeds(one, two, radius)
            keep = exceeds != _ALL
            if not keep.all():
                live, one, two, over, q, w = live[keep], one[keep], two[keep], over[keep], q[keep], w[keep]
                if not len(live):
                    return out
    out[live] = ~(over | _exceeds(one, two, radius))
    return out


def _exceeds(one: np.ndarray, two: np.ndarray, radius: int) -> np.ndarray:
    return {0: one | two, 1: two, 2: one & two, 3: np.zeros_like(one)}[radius]


def linked(fps: np.ndarray, sizes: np.ndarray, chunk: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, of positions within ``RADIUS`` in consecutive groups of the given sizes."""
    words = -(-sizes // 64)
    first_word = np.concatenate([[0], np.cumsum(words)])
    first = np.concatenate([[0], np.cumsum(sizes)])
    group = np.repeat(np.arange(len(sizes)), sizes)
    lane = np.arange(len(fps)) - first[group]
    slot = first_word[group] * 64 + lane
    padded = np.zeros(first_word[-1] * 64, np.uint64)
    padded[slot] = fps
    position = np.full(first_word[-1] * 64, -1, np.int64)
    position[slot] = np.arange(len(fps))
    planes = np.concatenate([planes_of(padded[a : a + (1 << 18)]) for a in range(0, len(padded), 1 << 18)])
    # a fingerprint is set against its own word and the later words of its group
    reach = first_word[group + 1] - slot // 64
    left, right = [], []
    bounds = np.concatenate([[0], np.cumsum(reach)])
    at = 0
    while at < len(fps):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + chunk, "right")) - 1)
        idx = np.repeat(np.arange(at, to), reach[at:to])
        word = slot[idx] // 64 + np.arange(len(idx)) - np.repeat(bounds[at:to] - bounds[at], reach[at:to])
        hits = within_radius(fps[idx], planes, word)
        some = np.flatnonzero(hits)
        bits = np.unpackbits(hits[some].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, bit = np.nonzero(bits)
        i, j = idx[some[row]], position[word[some[row]] * 64 + bit]
        ok = j > i
        left.append(i[ok])
        right.append(j[ok])
        at = to
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def roots_of(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest position in the component of each position (hooking and pointer jumping)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped
        if np.array_equal(before, root):
            return root


def _stars(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch | None:
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    sizes = np.diff(cut)
    if len(sizes) and (keep := np.repeat(sizes > 1, sizes)).any():
        fps = fps[keep]
        i, j = linked(fps.view(np.uint64), sizes[sizes > 1])
        if len(i):
            root = roots_of(len(fps), i, j)
            far = np.flatnonzero(root != np.arange(len(fps)))
            return pa.RecordBatch.from_arrays([pa.array(fps[far]), pa.array(fps[root[far]])], ["u", "v"])
    return None


def _compare_sorted(batches):
    """Over rows sorted by (k1, k2): whole groups only; a group may reach over batches and is bounded by 2**16."""
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for batch in batches:
        k1, k2, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
        if not len(fp):
            continue
        if kept:
            k1, k2, fp = (np.concatenate([*(x[c] for x in kept), y]) for c, y in enumerate((k1, k2, fp)))
        whole = int(np.flatnonzero((k1 != k1[-1]) | (k2 != k2[-1]))[-1]) + 1 if (k1[0], k2[0]) != (k1[-1], k2[-1]) else 0
        if whole:
            if (out := _group(k1[:whole], k2[:whole], fp[:whole])) is not None:
                yield out
        kept = [(k1[whole:], k2[whole:], fp[whole:])]
    if kept and (out := _group(*kept[0])) is not None:
        yield out


def _group(k1: np.ndarray, k2: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
    fresh = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    return _stars(np.concatenate([[0], np.cumsum(fresh)]), fp)


def _block(c: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(c, at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _combos(c: Column, offset: int, width: int) -> list[Column]:
    """A key for each pair of the four blocks from bit ``offset`` up: number of the pair, then both blocks."""
    keys = []
    for n, (a, b) in enumerate(itertools.combinations(range(4), 2)):
        two = F.shiftleft(_block(c, offset + width * a, width), width).bitwiseOR(_block(c, offset + width * b, width))
        keys.append(two.bitwiseOR(F.lit(n << 32).cast("long")))
    return keys


def links(distinct: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(u, v): star edges that connect all fingerprints (column fp, distinct) within ``RADIUS`` bits."""
    dealt = distinct.select("fp", F.explode(F.array(*_combos(F.col("fp"), 0, 16))).alias("k1"))
    big = dealt.groupBy("k1").count().where(F.col("count") > group_limit).select("k1", F.lit(True).alias("big"))
    # the two blocks that are not in the key, side by side in the low 32 bits
    rest = F.lit(None).cast("long")
    for n, (a, b) in enumerate(itertools.combinations(range(4), 2)):
        c, d = (x for x in range(4) if x not in (a, b))
        two = F.shiftleft(_block(F.col("fp"), 16 * c, 16), 16).bitwiseOR(_block(F.col("fp"), 16 * d, 16))
        rest = F.when(F.shiftright("k1", 32) == n, two).otherwise(rest)
    again = (
        dealt.join(big, "k1", "left")
        .withColumn("rest", rest)
        .select(
            "k1",
            F.explode(
                F.when(F.col("big"), F.array(*_combos(F.col("rest"), 0, 8))).otherwise(F.array(F.lit(-1).cast("long")))
            ).alias("k2"),
            "fp",
        )
    )
    return again.repartition("k1", "k2").sortWithinPartitions("k1", "k2").mapInArrow(_compare_sorted, "u long, v long")


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root): connected components by alternating large-star and small-star rounds.

    Every round is one written table in the shared folder, so a lost executor repeats at most a round.
    Stars keep (node, smallest node); minima are pre-aggregated before the shuffle and joined back,
    so a node with very many neighbours is never gathered in one place.
    """
    current = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        heads = low.select("u", F.col("m").alias("v"))
        current = stored(
            small.union(heads).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges"
        )
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _grouped(docs: DataFrame, similarity: float | None, shingle: int) -> DataFrame:
    """(doc_id, key, fp, root, component_id) for every row; ``key`` stands for the text, ``root`` for the group."""
    fps = stored(fingerprints(docs), "fingerprints")
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    edges = links(distinct.select("fp"))
    if similarity is not None:
        edges = edges.union(similar_links(docs, similarity, shingle))
    found = components(edges)
    members = found.union(found.select(F.col("root").alias("node"), "root").distinct())
    named = members.join(distinct, members.node == distinct.fp).select("node", "root", "first_id")
    lowest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked_fps = named.join(lowest, "root").select(F.col("node").alias("fp"), "root", "component_id")
    named_all = distinct.join(linked_fps, "fp", "left")
    # as a written table, both sides of the last join are plain exchanges and a hot fingerprint can be split
    named_all = named_all.select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "first_id").alias("component_id"))
    return fps.join(stored(named_all, "named"), "fp").select("doc_id", "key", "fp", "root", "component_id")


def near_duplicate_groups(docs: DataFrame, similarity: float | None = None, shingle: int = 5) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    component_id is the smallest doc_id that can be reached over links of at most two bits, and with ``similarity``
    also over links of that Jaccard similarity of ``shingle``-word shingles at least.  Null or
    blank text has fingerprint zero and is linked like any other.  Repeated rows are returned as often
    as they come.  A row without doc_id gets its group's smallest id, null if no row there has one.
    An empty table gives an empty result; further columns are ignored.
    """
    return _grouped(docs, similarity, shingle).select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, similarity: float | None = None, shingle: int = 5) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the row with the group's smallest doc_id.

    The settings are those of ``near_duplicate_groups``.  Rows are told apart by doc_id and text, so rows that share
    a doc_id go or stay each with its own group.  If a group has its smallest doc_id with several texts, the one with
    the smallest MD5 stays; of rows with one doc_id and text, the one whose columns have the smallest hash.  Rows without
    a doc_id stay.  An empty table gives an empty result; other columns may have any name and are kept as they are.
    """
    groups = stored(_grouped(docs, similarity, shingle), "groups").where("doc_id is not null")
    stays = groups.where("doc_id = component_id").groupBy("root", "doc_id").agg(F.min("key").alias("key"))
    gone = groups.select("doc_id", "key").distinct().join(stays.select("doc_id", "key"), ["doc_id", "key"], "left_anti")
    whole = docs.select(F.col("doc_id").alias("i"), text_key("text").alias("k"), F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"))
    kept = whole.join(gone.select(F.col("doc_id").alias("i"), F.col("key").alias("k")), ["i", "k"], "left_anti")
    repeated = groups.groupBy(F.col("doc_id").alias("i"), F.col("key").alias("k")).count().where("count > 1").select("i", "k")
    if not repeated.isEmpty():
        repeated = stored(repeated, "repeated")
        once = kept.join(repeated, ["i", "k"], "left_semi").groupBy("i", "k").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        kept = kept.join(repeated, ["i", "k"], "left_anti").unionByName(once)
    return kept.select(*[F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns])


def hex_of(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
