import random

import numpy as np

from quillspark.llm import decontam

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(docs, items, threshold=0.8):
    out = []
    for d, t in docs:
        words = decontam.words_of(t)
        own = {tuple(words[a : a + n]) for n in range(1, 6) for a in range(len(words) - n + 1)}
        for i, s in items:
            shingles = decontam.shingles_of(decontam.words_of(s))
            if shingles and len(own & shingles) >= threshold * len(shingles) - 1e-9:
                out.append((d, i, len(own & shingles), len(shingles)))
    return sorted(out, key=repr)


def corpus():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(rnd.randint(5, 60)))) for i in range(60)]
    items += [(100, "two words"), (104, "Abcd"), (105, "one, two three four"), (101, ""), (102, None), (103, items[0][1]), (None, items[1][1])]
    docs = [(i, " ".join(word() for _ in range(rnd.choice([3, 40, 300])))) for i in range(60)]
    for i in range(60):
        piece = items[i][1].upper().split()
        if i % 3 == 0:
            piece[len(piece) // 2] = "changed"
        filler = [word() for _ in range(rnd.choice([0, 50, 3000]))]
        at = rnd.randint(0, len(filler))
        docs.append((1000 + i, ", ".join(filler[:at] + piece + filler[at:])))
    docs += [(2000, None), (2001, ""), (2002, "Two, words!"), (2003, "..."), (2004, "not two  WORDS alone"), (2005, "two more words"), (2006, "zero one two three four five six"), (2007, "one two three"), (1000, docs[60][1]), (None, items[3][1])]
    docs.append((3000, " ".join(word() for _ in range(60000)) + " " + items[7][1]))
    return docs, items


def test_equals_exact_containment(spark):
    docs, items = corpus()
    d = spark.createDataFrame([(i, t, None, None, 3) for i, t in docs], DOCS)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for block in (50_000, 10):
        got = decontam.contaminated(d, b, block=block).collect()
        assert sorted(((r.doc_id, r.item_id, r.n_found, r.n_shingles) for r in got), key=repr) == want
    kept = decontam.drop_contaminated(d, b, block=10)
    assert kept.columns == d.columns
    bad = {x[0] for x in want}
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((i for i, _ in docs if i not in bad), key=repr)


def test_empty_tables(spark):
    d, b = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(d, b).count() == 0
    assert decontam.contaminated(spark.createDataFrame([(1, "a b c d e f", None, None, 1)], DOCS), b).count() == 0


def test_vector_hashes_follow_words():
    powers = decontam._Powers()
    a = decontam.shingle_hashes("One two, three FOUR five. six", powers)[0]
    b = decontam.shingle_hashes("zero one two three four five six", powers)[0]
    assert len(a) == 2 and len(b) == 3 and np.array_equal(a, b[1:])


def test_minima_are_one_per_bin():
    h = np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2)
    m = decontam.minima(h, 8)
    assert len(m) == 256 and all(x == min(h[h >> np.uint64(56) == x >> np.uint64(56)]) for x in m[:5])
