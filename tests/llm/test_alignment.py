import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quillspark.llm import alignment
from quillspark.llm.packing import vocabulary_path
from quillspark.llm.tokens import model_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PARTS = ["a", "the", " the", "é", "\n", " ", "  ", "\t", "<s>", "▁", "ﬁ", "\r", "\x00", "日本", "😀", "\xa0", "​", "<|endoftext|>", "1", ".", "\n\n", "<0x0A>", "\x85", "…", " cat's"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(vocabulary_path())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=model_path())


def spelt(libraries, text):
    """(id, bytes) of both sides' tokens, by the libraries alone."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}
    a, sp = libraries
    left = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(f" {text}", add_special_tokens=False).ids]
    one = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    return left, [(i, one(i)) for i in sp.encode(text)]


def brute(libraries, rows):
    """The operator's rows by comparing every token of one side with every one of the other."""
    found, counts = [], Counter()
    for doc, text in rows:
        left, right = spelt(libraries, text) if text else ([], [])
        want = f" {text or ''}".encode()
        if not text or b"".join(x for _, x in left) != want or b"".join(x for _, x in right) != want:
            found.append((doc, [], [], [], []))
            continue
        ranges = []
        for side in (left, right):
            at, out = 0, []
            for i, x in side:
                out.append((i, at, at + len(x)))
                at += len(x)
            ranges.append(out)
        links, j = [], 0
        for i, start, end in ranges[0]:
            while j and ranges[1][j][1] > start:
                j -= 1
            while ranges[1][j][2] <= start:
                j += 1
            k = j
            while k < len(ranges[1]) and ranges[1][k][1] < end:
                links.append((i, ranges[1][k][0]))
                k += 1
        counts.update(links)
        cuts = sorted({x[2] for x in ranges[0]} & {x[2] for x in ranges[1]})
        groups = ";".join("|".join(",".join(str(i) for i, _, end in side if low < end <= high) for side in ranges) for low, high in zip([0, *cuts], cuts)) if len(want) < 3000 else None
        found.append((doc, *ranges, links, (len(cuts), groups)))
    most = Counter()
    for (a, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for doc, a, b, links, groups in found:
        digest = hashlib.sha256(groups[1].encode()).hexdigest() if groups and groups[1] is not None else "" if not groups else None
        out.append((doc, len(a), len(b), groups[0] if groups else 0, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return out


def made(seed, n):
    rnd = random.Random(seed)
    words = ["reasonable", "Überraschung", "tokenization", "x", "naïve", "co-operate", "12345", "don't"]
    rows = [(i, "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 12)))) for i in range(n)]
    rows += [(n + i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60)))) for i in range(n // 3)]
    return rows + [(9000, None), (9001, ""), (None, "x y"), (3, "repeated id"), (3, "repeated id"), (9002, " two  spaces "), (9003, "\n\n a\n")]


def test_rows_equal_brute_force(spark, libraries):
    rows = made(1, 1500)
    df = spark.createDataFrame([(d, t, None, None, 0) for d, t in rows], DOCS)
    got = sorted(map(tuple, alignment.align(df).collect()), key=repr)
    want = sorted(brute(libraries, rows), key=repr)
    assert got == want
    assert sum(r[1] == 0 for r in got) > 3 and sum(r[3] < min(r[1:3]) for r in got) > 50


def test_documents_equal_brute_force(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    want = {r[0]: r for r in brute(libraries, rows)}
    for r in alignment.align(docs).collect():
        assert tuple(r)[:7] == want[r.doc_id][:7] and want[r.doc_id][7] in (None, r.groups_sha256)


def test_very_long_text(spark, libraries):
    rows = [(1, "the cat sat. " * 40_000), (2, "q" * 20_000)]
    got = {r.doc_id: r for r in alignment.align(spark.createDataFrame([(d, t, None, None, 0) for d, t in rows], DOCS)).collect()}
    want = brute(libraries, rows)
    assert [tuple(got[d])[:7] for d, _ in rows] == [w[:7] for w in want]


def test_ids_equal_the_libraries(libraries):
    a, b = alignment.sides(vocabulary_path(), model_path())
    for _, text in made(2, 800):
        if text:
            assert np.frombuffer(a(f" {text}"), "<u4").tolist() == libraries[0].encode(f" {text}", add_special_tokens=False).ids
            assert np.frombuffer(b(text), "<u4").tolist() == libraries[1].encode(text)


def test_empty_table_and_clashing_columns(spark):
    assert alignment.align(spark.createDataFrame([], DOCS)).count() == 0
    df = spark.createDataFrame([(i, "a b c", None, None, 0) for i in range(5)], DOCS)
    more = df.selectExpr("*", *[f"doc_id as `{c}`" for c in ("block", "pair", "held", "values", "a.b")])
    assert sorted(alignment.align(more).collect()) == sorted(alignment.align(df).collect())
