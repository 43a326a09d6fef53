import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from quillspark.llm import quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=500):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice(["on", "the", "ti", "er", "an", "re"]) for _ in range(rnd.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rnd.randint(5, 200))]
        good = i % 3 > 0
        text = " ".join(words) if good else " ".join(w + "###" for w in words) if i % 2 else " ".join([words[0]] * 60)
        docs.append((i, text, "en", f"src{i % 4}", len(text)))
        labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_accuracy_and_edge_rows(spark):
    docs, labels = corpus()
    extra = [(7000, None, None, None, None), (7001, "", None, None, 0), (None, "word", None, None, 4), (3, docs[3][1], None, None, docs[3][4])]
    d = spark.createDataFrame(docs + extra, DOCS)
    tail = [(1, None, 0), (None, 1, 0), (99999, 0, 1)]
    lab = spark.createDataFrame(labels + tail, "doc_id long, quality int, toxic int")
    got = quality.assess(d, lab).collect()
    assert len(got) == len(docs) + len(extra) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth = {i: y for i, y, _ in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    again = {(r.doc_id, r.score) for r in quality.assess(d, lab).collect()}
    assert again == {(r.doc_id, r.score) for r in got}
    kept = quality.keep_good(d, lab)
    assert kept.columns == d.columns and kept.count() == sum(r.predicted for r in got)


def test_linear_time_identity():
    m = quality.Machine(seed=1)
    ids, x = np.array([3, 8, 20000 % quality.DIM]), np.array([0.5, 1.0, 0.2])
    m.w[ids] = [0.1, -0.2, 0.3]
    want = m.bias + (m.w[ids] * x).sum() + sum(m.v[ids[i]] @ m.v[ids[j]] * x[i] * x[j] for i in range(3) for j in range(i))
    assert abs(m.margins(ids, x, np.array([0]))[0][0] - want) < 1e-9


def test_nothing_to_learn_from(spark):
    d = spark.createDataFrame([(1, "a b", None, None, 3)], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert 0 <= quality.assess(d, none).first().score <= 1
    assert quality.assess(spark.createDataFrame([], DOCS), none).count() == 0


def test_repeated_documents_teach_once_and_in_any_order(spark):
    rows = [(i, f"{'good calm prose' if i % 2 else 'BUY ### NOW'} {i}", None, None, 20) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    again = [(1, "other text", None, None, None), (1, None, None, None, 3)] + rows[:5] * 50
    one = quality.train(spark.createDataFrame(rows + again, DOCS), labels)
    two = quality.train(spark.createDataFrame((rows + again)[::-1], DOCS), labels)
    assert np.array_equal(one.w, two.w) and np.array_equal(one.v, two.v)


def plain_features(text, n_chars):
    """{slot: value}, restated from the module's description: words by slot, then eleven levels."""
    text = text or ""
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", text.lower().encode()) if w]
    counts = Counter(zlib.crc32(w) % 16384 for w in words)
    length = math.sqrt(sum(math.log(1 + c) ** 2 for c in counts.values()))
    out = {slot: math.log(1 + c) / length for slot, c in counts.items()}
    n, size = max(1, len(words)), max(1, len(text))
    shares = [
        size / n / 16,
        sum(c in "#*$%&|<>!" for c in text) / n / 2,
        sum(c.isupper() for c in text) * 2 / size,
        len(set(words)) / n,
        len({(a, b) for a, b in zip(words, words[1:])}) / n,
        4 * sum(c == "." for c in text) / n,
        2 * sum(c == "|" for c in text) / n,
        4 * sum(c in "0123456789" for c in text) / size,
        math.log2(n + 1) / 16,
        math.log2(size / len(text.split("\n")) + 1) / 16,
        math.log2(max(0, n_chars or 0) + 1) / 20,
    ]
    for i, share in enumerate(shares):
        out[16384 + 12 * i + min(11, max(0, math.floor(share * 12)))] = 0.5
    return out


def test_features_and_scores_equal_their_restatement(spark):
    rnd = random.Random(21)
    docs, labels = corpus(90)
    parts = ["a", "THE", "é", "Ünï", "#", "|", "1.5", "\n", " ", "\t", "x" * 30, "日本", "<b>", "\x0b", "."]
    docs += [(500 + i, "".join(rnd.choice(parts) + rnd.choice(["", " "]) for _ in range(rnd.randint(0, 60))), None, None, rnd.choice([None, 0, -3, 5, 10**6])) for i in range(150)]
    docs += [(900, "word " * 60_000 + "Ende", "de", "s", 300_004), (901, None, None, None, None), (902, "", None, None, 0)]
    for _, text, _, _, n in docs:
        ids, x = quality.features(text, n)
        want = plain_features(text, n)
        assert ids.tolist() == sorted(want) and np.allclose(x, [want[i] for i in sorted(want)], atol=1e-12)
    d = spark.createDataFrame(docs, DOCS)
    machine = quality.train(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.score for r in quality.scored(d, machine).collect()}
    for doc, text, _, _, n in docs:
        one = sorted(plain_features(text, n).items())
        # all pairs of features, one by one
        raw = machine.bias + sum(machine.w[i] * x for i, x in one)
        v = np.array([machine.v[i] * x for i, x in one])
        raw += np.triu(v @ v.T, 1).sum()
        assert abs(got[doc] - 1 / (1 + math.exp(-raw))) < 1e-9
