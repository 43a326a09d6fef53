import random
import zlib

import pytest
from tokenizers import Tokenizer

from quillspark.llm import packing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PARTS = ["a", "the", "é", "\n", " ", "  ", "\t", "<|endoftext|>", "ﬁ", "\r", "\x00", "日本", "😀", "\xa0", "'s", "1", ".", "\x85", "\x1c", "x ", " y"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.vocabulary_path())


def test_ids_equal_the_library(tokenizer):
    ids, rnd = packing.Ids(packing.vocabulary_path(), memo=40), random.Random(2)
    for _ in range(4000):
        text = "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 10)))
        assert list(memoryview(ids(text)).cast("I")) == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def check(rows, pieces, tokenizer):
    want = {}
    for d, t in rows:
        want.setdefault(d, []).append(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])
    got = {}
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in p.ids)) and p.length == len(p.ids) > 0
        got.setdefault(p.doc_id, []).append(p)
    assert got.keys() == want.keys()
    for d, docs in want.items():
        assert sum(len(x) for x in docs) == sum(p.length for p in got[d])
        if len(docs) == 1:
            own = sorted(got[d], key=lambda p: p.start)
            assert [i for p in own for i in p.ids] == docs[0] and all(p.doc_tokens == len(docs[0]) for p in own)
            assert all(a.start + a.length == b.start for a, b in zip(own, own[1:]))
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        assert own[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in zip(own, own[1:]))
        n = sum(p.length for p in own)
        assert n <= 2048 and n & (n - 1) == 0 and own[0].tier == n
    return sequences


def test_pieces_are_a_gapless_cover_without_padding(spark, tokenizer):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(["word", "Éa", "x1", "\n"]) for _ in range(rnd.choice([0, 3, 40, 900, 5000])))) for i in range(120)]
    rows += [(500, None), (501, ""), (7, "again"), (None, "no id"), (502, "<|endoftext|> x")]
    df = spark.createDataFrame([(d, t, None, None, 3) for d, t in rows], DOCS).repartition(3)
    pieces = packing.pack(df, with_ids=True).collect()
    sequences = check(rows, pieces, tokenizer)
    assert sum(len(s) for s in sequences.values()) < len(rows) + 2 * len(sequences)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


def test_step_groups_are_balanced():
    rnd = random.Random(8)
    docs = [(i, b"\2\0\0\0" * rnd.randint(1, 6000)) for i in range(900)]
    made = [x for part in packing.pack_stream(docs, round_tokens=1 << 40) for x in part if x[1] == 2048]
    cost = {}
    for group, _, pieces in made:
        cost.setdefault(group, []).append(sum(p.length**2 for p in pieces))
    full = [sum(c) / len(c) for c in cost.values() if len(c) == packing.STEP]
    assert max(full) < 1.1 * min(full)


def test_each_tier_has_windows_of_its_own_size():
    rnd = random.Random(9)
    docs = [(i, b"\2\0\0\0" * rnd.choice([*(rnd.randint(1, 256) for _ in range(6)), rnd.randint(257, 512), rnd.randint(513, 1024), rnd.randint(1025, 2048)])) for i in range(3000)]
    made = [x for part in packing.pack_stream(docs, round_tokens=1 << 18) for x in part]
    assert sum(p.length for _, _, pieces in made for p in pieces) == sum(len(ids) // 4 for _, ids in docs)
    for size in packing.TIERS:
        own = [pieces for _, tier, pieces in made if tier == size]
        # the partition's end adds a sequence of each size at most; all others are opened by a piece of the tier
        assert len(own) > 20 and all(sum(p.length for p in pieces) == size for pieces in own)
        assert sum(size > 256 and pieces[0].length <= size // 2 for pieces in own) <= 1
        assert all(p.start + p.length <= p.total and (p.total <= size or p.length < p.total) for pieces in own for p in pieces)
    short = [(i, b"\2\0\0\0" * rnd.randint(1, 256)) for i in range(500)]
    assert {tier for part in packing.pack_stream(short) for _, tier, _ in part if tier > 128} == {256}
