import random
import re

import numpy as np
import xxhash

from quillspark.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def naive_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_components(rows):
    fps = [naive_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                group[top(i)] = top(j)
    lowest = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            lowest[top(i)] = min(lowest.get(top(i), doc), doc)
    return sorted(((d, format(f, "016x"), lowest.get(top(i))) for i, ((d, _), f) in enumerate(zip(rows, fps))), key=repr)


def result(spark, rows):
    df = spark.createDataFrame([(d, t, None, None, 7) for d, t in rows], SCHEMA)
    out = simhash.near_duplicate_groups(df).select("doc_id", simhash.hex_of("fp").alias("fp"), "component_id")
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_groups_equal_brute_force_with_edge_cases(spark):
    rnd = random.Random(3)
    words = ["alpha", "Beta", "gamma", "été", "Öl", "x", "9", "zeta"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60)))) for i in range(60)]
    base = [rnd.choice(words) + str(rnd.randint(0, 99)) for _ in range(400)]
    for i in range(40):
        copy = list(base)
        copy[rnd.randrange(400)] = "edit"
        rows.append((100 + i, "\n ".join(copy)))
    rows += [(7, None), (500, ""), (501, " \t\n"), (None, "alpha beta"), (None, "lonely row"), (60, rows[5][1]), (60, rows[5][1])]
    rows.append((9000, " ".join(base * 60)))
    assert result(spark, rows) == naive_components(rows)


def test_empty_table(spark):
    assert result(spark, []) == []


def test_bit_sliced_links_equal_all_pairs():
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 1 << 63, 1, dtype=np.uint64)[0]
    fps = np.unique([centre ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) ^ np.uint64(1 << int(c)) for a, b, c in rng.integers(0, 20, (700, 3))])
    sizes = np.array([len(fps) - 205, 200, 5])
    i, j = simhash.linked(fps, sizes, chunk=1000)
    ends = np.cumsum(sizes)
    expected = {
        (a, b)
        for a in range(len(fps))
        for b in range(a + 1, len(fps))
        if np.searchsorted(ends, a, "right") == np.searchsorted(ends, b, "right") and bin(int(fps[a] ^ fps[b])).count("1") <= 2
    }
    assert set(zip(i.tolist(), j.tolist())) == expected and len(i) == len(expected)


def test_hot_keys_are_dealt_again_without_loss(spark):
    rng = np.random.default_rng(6)
    centre = int(rng.integers(0, 1 << 62))
    fps = sorted({centre ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 40, (300, 3))})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    roots = {}
    for limit in (4096, 8):
        found = simhash.components(simhash.links(df, group_limit=limit)).collect()
        roots[limit] = {r.node: r.root for r in found}
    assert roots[8] == roots[4096] and roots[8]
    linked = {f for i, f in enumerate(fps) if any(bin(f ^ g).count("1") <= 2 for g in fps if g != f)}
    assert linked == set(roots[8]) | set(roots[8].values())


def test_long_chain_settles(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(-40, 60)], "u long, v long")
    assert {(r.node, r.root) for r in simhash.components(edges).collect()} == {(i, -40) for i in range(-39, 61)}


def test_drop_keeps_one_row_of_each_group(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(5, text), (3, text), (3, text), (8, "other words that have nothing in common here"), (None, text)]
    df = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], SCHEMA)
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 3, 8]


def test_rows_that_share_an_id_go_or_stay_with_their_own_groups(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(3, b, "k"), (5, b, "k"), (5, a, "k"), (6, c, "x"), (6, c, "y"), (6, a + " a60", "z"), (7, None, "n"), (7, "", "n"), (None, b, "k"), (None, None, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, k string").selectExpr("*", "k as i", "k as row", "k as `key`", "k as root", "k as `a.b`")
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted((x for x in got if x[1]), key=repr) == sorted([(3, b), (5, a), (6, c), (None, b)] + ([(6, a + " a60")] if bits(a, a + " a60") > 2 else []), key=repr)
    # null and empty text of one id are repeats; rows without an id stay
    assert sorted(repr(x) for x in got if not x[1]) in (["(7, '')", "(None, None)"], ["(7, None)", "(None, None)"])
    again = sorted(repr(tuple(r)) for r in simhash.drop_near_duplicates(df.repartition(5)).collect())
    assert again == sorted(repr(tuple(r)) for r in kept.collect())
    assert simhash.drop_near_duplicates(df.limit(0)).count() == 0


def bits(s, t):
    return bin(simhash.fingerprint_of(s) ^ simhash.fingerprint_of(t)).count("1")


def test_similarity_finds_near_copies_beyond_two_bits(spark):
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    rows = []
    for i in range(30):
        text = [word() for _ in range(rnd.randint(6, 200))]
        rows.append((i, " ".join(text)))
        for k in range(4):
            copy = list(text)
            for _ in range(k):
                copy[rnd.randrange(len(copy))] = word()
            rows.append((100 * (k + 1) + i, "\n".join(copy).upper()))
    rows += [(900, None), (901, ""), (902, "two words"), (903, "Two  words"), (904, "two other"), (None, rows[0][1]), (7, rows[35][1])]
    rnd.shuffle(rows)
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for _, t in rows]
    fps = [naive_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    wide = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            near = bool(a) and len(a & b) >= 0.8 * len(a | b)
            close = bin(fps[i] ^ fps[j]).count("1") <= 2
            wide += near and not close
            if near or close:
                group[top(i)] = top(j)
    lowest = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            lowest[top(i)] = min(lowest.get(top(i), doc), doc)
    df = spark.createDataFrame([(d, t, None, None, 7) for d, t in rows], SCHEMA)
    got = simhash.near_duplicate_groups(df, similarity=0.8).collect()
    assert wide > 20 and sorted(((r.doc_id, r.component_id) for r in got), key=repr) == sorted(((d, lowest[top(i)]) for i, (d, _) in enumerate(rows)), key=repr)
    kept = {r.doc_id for r in simhash.drop_near_duplicates(df, similarity=0.8).collect()}
    assert kept == {None, *lowest.values()}
