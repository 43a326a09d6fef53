import hashlib
import random

import numpy as np
import pytest

from quillspark.llm import runindex as R

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, w=50):
    """Every string of 50 bytes against the smallest id in which it starts."""
    first = {}
    for doc, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - w + 1):
            if doc is not None:
                s = data[i : i + w]
                first[s] = min(first.get(s, doc), doc)
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - w + 1):
            if doc is not None and first[data[i : i + w]] < doc:
                gone[i : i + w] = b"\1" * w
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(gone)))
        kept = bytes(x for x, g in zip(data, gone) if not g)
        out.append((doc, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def made(seed, n=150):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6)))
    passages = [" ".join(word() for _ in range(rnd.randint(8, 60))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rnd.randint(0, 5)):
            p = rnd.choice(passages)
            kind = rnd.random()
            if kind < 0.4:
                a = rnd.randint(0, len(p))
                p = p[a : a + rnd.randint(20, 120)]
            elif kind < 0.6:
                k = rnd.randint(0, len(p) - 1)
                p = p[:k] + rnd.choice("xyz😀") + p[k + 1 :]
            parts.append(p if rnd.random() < 0.8 else " ".join(word() for _ in range(20)))
        rows.append((rnd.randint(0, 200), "\n".join(parts)))
    rows += [(500, None), (501, ""), (None, passages[0]), (None, passages[0]), (502, "a" * 300), (503, "b" + "a" * 90), (1, "a" * 49), (0, "ab" * 200), (504, "ba" * 40)]
    return rows + rows[:5] + [(600 + k, rows[3][1]) for k in range(20)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, None, None, 0) for d, t in rows], DOCS)


@pytest.mark.parametrize("hot", [R.HOT, 1])
def test_rows_equal_brute_force(spark, hot):
    rows = made(1)
    got = sorted(map(tuple, R.repeats(frame(spark, rows).repartition(5), hot).collect()), key=repr)
    want = sorted(brute(rows), key=repr)
    assert got == want and sum(r[2] > 0 for r in want) > 50 and len({r[3] for r in want}) > 3


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, R.repeats(docs).collect())) == sorted(brute(rows))


def test_small_blocks_and_batches(spark, monkeypatch):
    rows = made(4, 60)
    monkeypatch.setattr(R, "SEGMENT", 100)
    found = [(at + p.text, p.start, p.windows, p.anchor, p.hash) for at, some in R._segments([(t or "").encode() for _, t in rows]) for p in [R.Pieces(some)]]
    whole = R.Pieces([(t or "").encode() for _, t in rows])
    for k, column in enumerate((whole.text, whole.start, whole.windows, whole.anchor, whole.hash)):
        assert np.concatenate([f[k] for f in found]).tolist() == column.tolist()


def test_matching_statistics_of_other_texts():
    rnd = random.Random(5)
    for alphabet in ("ab", "abcdefgh"):
        base = "".join(rnd.choice(alphabet) for _ in range(400))
        texts, others = [], []
        for out in (texts, others):
            for _ in range(30):
                a = rnd.randint(0, 300)
                x = base[a : a + rnd.randint(1, 140)]
                k = rnd.randint(0, len(x) - 1)
                out.append((x[:k] + rnd.choice(alphabet + "z") + x[k + 1 :]).encode())
        owners = np.array([rnd.randint(0, 99) for _ in texts])
        index = R.RunIndex(texts, owners)
        got = {}
        for text, place, match, owner in index.stream(others):
            got |= {(t, p): (m, o if m == R.WINDOW else None) for t, p, m, o in zip(text.tolist(), place.tolist(), match.tolist(), owner.tolist())}
        for t, x in enumerate(others):
            for p in range(len(x)):
                m = next(m for m in range(min(R.WINDOW, len(x) - p), -1, -1) if any(x[p : p + m] in y for y in texts))
                first = min((o for y, o in zip(texts, owners.tolist()) if x[p : p + m] in y), default=None) if m == R.WINDOW else None
                assert got[t, p] == (m, first), (alphabet, t, p)


@pytest.mark.parametrize("wide", [False, True])
def test_texts_of_the_index_start_at_their_last_windows(monkeypatch, wide):
    if wide:  # ranks that fit into no common number
        given = R._ranked
        monkeypatch.setattr(R, "_ranked", lambda *keys: given(*keys) if len(keys) == 1 else (o := np.lexsort(keys[::-1]), np.unique(np.stack(keys), axis=1, return_inverse=True)[1].ravel()))
    rnd = random.Random(12)
    base = bytes(rnd.choice(b"ab") for _ in range(300))
    texts = []
    for _ in range(80):
        a = rnd.randint(0, 200)
        text = bytearray(base[a : a + rnd.randint(50, 100)])
        text[rnd.randrange(len(text))] = rnd.choice(b"abz")
        texts.append(bytes(text))
    owners = np.array([rnd.randint(0, 30) for _ in texts])
    got = {}
    for text, place, match, owner in R.RunIndex(texts, owners).stream(texts, own=True):
        assert (match == R.WINDOW).all()
        got |= dict(zip(zip(text.tolist(), place.tolist()), owner.tolist()))
    assert got == {(t, i): min(o for y, o in zip(texts, owners.tolist()) if x[i : i + 50] in y) for t, x in enumerate(texts) for i in range(len(x) - 49)}


def test_repetitive_texts_have_few_runs():
    rnd = random.Random(6)
    base = bytes(rnd.choice(b"abcdefghij") for _ in range(3000))
    one, many = R.RunIndex([base], np.array([0])), R.RunIndex([base] * 50, np.arange(50))
    assert len(many.run_start) < 1.1 * len(one.run_start) and len(many.class_start) < 1.1 * len(one.class_start) + 80 * 50


def test_halves_keep_every_window():
    rnd = random.Random(7)
    for _ in range(50):
        text = bytes(rnd.choice(b"ab") for _ in range(200))
        pieces = R.Pieces([text])
        for j in range(len(pieces.start)):
            s, n = int(pieces.start[j]), int(pieces.windows[j])
            parts = list(R.halves(int(pieces.anchor[j].view(np.int64)), text[s : s + n + R.WINDOW - 1]))
            assert sum(len(b) - R.WINDOW + 1 for _, _, b in parts) == n and all(text[s + a : s + a + len(b)] == b for _, a, b in parts)


def test_only_entries_without_a_common_window_are_left_out():
    rnd = random.Random(11)
    for _ in range(30):
        base = bytes(rnd.choice(b"abc") for _ in range(160))
        texts = []
        for _ in range(6):
            a = rnd.randint(0, 60)
            text = bytearray(base[a : a + rnd.randint(50, 100)])
            text[rnd.randrange(len(text))] = rnd.choice(b"abcx")
            texts.append(bytes(text))
        p = R.Pieces(texts)
        entries = [(int(p.anchor[j].view(np.int64)), texts[p.text[j]][p.start[j] : p.start[j] + p.windows[j] + 49]) for j in range(len(p.start))]
        entries = sorted(set(entries))
        first, end = R.contested(np.array([a for a, _ in entries], np.int64), b"".join(b for _, b in entries), np.array([len(b) for _, b in entries]))
        windows = [[b[i : i + 50] for i in range(len(b) - 49)] for _, b in entries]
        for i, own in enumerate(windows):
            others = {x for j, more in enumerate(windows) if i != j for x in more}
            assert all(first[i] <= k < end[i] for k, x in enumerate(own) if x in others) and end[i] <= len(own)


def test_very_long_text(spark):
    rnd = random.Random(8)
    long = "".join(rnd.choice("abcdefghijklmnop ") for _ in range(700_000))
    rows = [(1, long), (2, "x" * 100 + long[1000:300_000] + "y" * 100), (3, long[299_990:])]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in R.repeats(frame(spark, rows)).collect()}
    assert got == {1: (0, 0), 2: (299_000, 1), 3: (len(long) - 299_990, 1)}


def test_empty_table_and_clashing_columns(spark):
    assert R.repeats(frame(spark, [])).count() == 0
    rows = made(9, 40)
    more = frame(spark, rows).selectExpr("*", *[f"doc_id as `{c}`" for c in ("id", "key", "keys", "anchor", "marks", "a.b")])
    assert sorted(map(tuple, R.repeats(more).collect()), key=repr) == sorted(brute(rows), key=repr)
