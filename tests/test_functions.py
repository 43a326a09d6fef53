import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quillspark.functions import prompts as P
from quillspark.functions import text as T
from quillspark.functions import vectors as V
from quillspark.operators import chunking, search, sync


def model(text, size, overlap):
    """An independent chunker: (pieces, chunks)."""
    queue, pieces, held = [p.strip() for p in text.split("\n")], [], None
    for p in filter(None, queue):
        if held is not None and len(held) + 1 + len(p) <= size:
            held = held + "\n" + p
            continue
        if held is not None:
            pieces.append(held)
        held = p if len(p) <= size else None
        if held is None:
            pieces += [p[i : i + size] for i in range(0, len(p), size - overlap)]
    pieces += [held] if held is not None else []
    return pieces, [c if i == 0 else pieces[i - 1][-overlap:] + "\n" + c for i, c in enumerate(pieces)]


def chunked(spark, texts, size, overlap):
    df = spark.createDataFrame(list(enumerate(texts)), "source int, text string")
    out = {}
    for r in chunking.chunks(df, size, overlap).orderBy("source", "chunk_index").collect():
        out.setdefault(r.source, []).append(r.text)
    lag = {}
    for r in chunking.chunks_by_lag(df, size, overlap).orderBy("source", "chunk_index").collect():
        lag.setdefault(r.source, []).append(r.text)
    assert lag == out
    return [out.get(i, []) for i in range(len(texts))]


def test_short_blank_and_long_texts(spark):
    long = "\n".join(f"This is paragraph number {i} with some extra filler words." for i in range(30))
    short, none, blank, null, many = chunked(spark, ["This is a short piece of text.", "", "   \n\t", None, long], 200, 50)
    assert short == ["This is a short piece of text."] and none == blank == null == []
    assert len(many) > 1 and all(len(c) <= 200 + 50 + 1 for c in many)


def test_chunks_follow_the_model(spark):
    rnd = random.Random(1)
    texts = ["x" * 1000, "y" * 1001, "z" * 1701, "a" * 1200 + "\nx", "\xa0pad\x1c\n\x0bpad", "😀" * 1300, "é\r\nb\rc"]
    texts += ["\n".join("w" * rnd.choice([0, 1, 5, 40, 79, 80, 81, 300]) for _ in range(rnd.randint(0, 30))) for _ in range(60)]
    assert chunked(spark, texts[:7], 1000, 150) == [model(t, 1000, 150)[1] for t in texts[:7]]
    assert chunked(spark, texts[7:], 80, 20) == [model(t, 80, 20)[1] for t in texts[7:]]


def test_chunks_of_many_paragraphs_follow_the_model(spark):
    rnd = random.Random(3)
    texts = ["\n".join("w" * rnd.choice([0, 1, 2, 3, 19, 20, 21, 59, 60, 61]) for _ in range(n)) for n in (1, 2, 255, 256, 257, 2000)]
    texts += ["a\n" * 5000, "\n".join("ab" for _ in range(3000)), ("x" * 61 + "\n") * 400]
    assert chunked(spark, texts, 60, 7) == [model(t, 60, 7)[1] for t in texts]


def test_long_texts_take_time_in_proportion(spark):
    def seconds(mb):
        text = "\n".join("x" * 44 for _ in range(mb * 1_000_000 // 45))
        df = spark.createDataFrame([(1, text)], "source long, text string")
        took = []
        for _ in range(3):
            began = time.time()
            assert chunking.chunks(df).count() > 1000 * mb
            took.append(time.time() - began)
        return min(took)

    seconds(1)
    four, sixteen = seconds(4), seconds(16)
    # the fold that copied all finished pieces took 53 s for 4 MB, and four times as much text took sixteen times as long
    assert four < 10 and sixteen < 7 * four


def test_one_long_paragraph_is_sliced_in_one_pass(spark):
    text = "é😀xyz" * 400_000
    got = chunked(spark, [text], 1000, 150)[0]
    assert got == model(text, 1000, 150)[1]


@pytest.mark.parametrize("size, overlap", [(10, 0), (10, 10), (10, 12)])
def test_sizes_are_checked(spark, size, overlap):
    with pytest.raises(ValueError):
        chunking.chunks(spark.createDataFrame([(1, "a")], "source int, text string"), size, overlap)


def test_recursive_split():
    text = "\n\n".join(" ".join(["word"] * 30) for _ in range(5)) + "\n\n" + "q" * 130
    parts = chunking.split_recursively(text, 100, 20)
    assert all(len(p) <= 100 for p in parts) and "".join(parts).count("q") >= 130
    assert chunking.split_recursively("short", 100, 20) == ["short"] and chunking.split_recursively(" \n\n ", 100, 20) == []


def recursively(text, size, overlap, separators=("\n\n", "\n", " ", "")):
    """The splitter stated anew: parts keep the separator before them; short ones are merged, others split by the next separator."""
    sep = next(s for s in separators if s in text)
    rest = separators[separators.index(sep) + 1 :]
    first, *more = text.split(sep) if sep else ["", *text]
    parts = [p for p in [first, *(sep + m for m in more)] if p]
    out, run = [], []

    def merge(run):
        kept, first = [], 0
        for last in range(len(run) + 1):
            whole = "".join(run[first:last])
            if last == len(run) or len(whole) + len(run[last]) > size:
                if last > first:
                    kept.append(whole)
                    while last < len(run) and first < last and (len("".join(run[first:last])) > overlap or len("".join(run[first : last + 1])) > size):
                        first += 1
        return kept

    for part in parts:
        if len(part) < size:
            run.append(part)
        else:
            out += merge(run) + (recursively(part, size, overlap, rest) if rest else [part])
            run = []
    return [c.strip() for c in out + merge(run) if c.strip()]


def test_recursive_split_equals_its_rule_on_any_text(spark):
    rnd = random.Random(12)
    texts = ["".join(rnd.choice(["a", "bb", "ccc", " ", " ", "\n", "\n\n", "é" * 9, "x" * 30]) for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    for size, overlap in ((10, 3), (20, 7), (30, 1)):
        for t in texts:
            assert chunking.split_recursively(t, size, overlap) == (recursively(t, size, overlap) if t else []), (t, size)
    df = spark.createDataFrame([(i, t or None) for i, t in enumerate(texts[:50])], "source int, text string")
    got = sorted((r.source, r.chunk_index, r.text) for r in chunking.recursive_chunks(df, 20, 7).collect())
    assert got == [(i, n, c) for i, t in enumerate(texts[:50]) for n, c in enumerate(recursively(t, 20, 7) if t else [])]


def test_suffixes(spark):
    names = ["a.TXT", "d/.txt", "d/x.tar.csv", "noext", ".hidden.md", "a b.pdf", "d.txt/file"]
    df = spark.createDataFrame([(n,) for n in names], "p string").select(T.suffix("p"), T.base_name("p"))
    assert [tuple(r) for r in df.collect()] == [
        (".txt", "a.TXT"), ("", ".txt"), (".csv", "x.tar.csv"), ("", "noext"), (".md", ".hidden.md"), (".pdf", "a b.pdf"), ("", "file")]


def test_cosine_edges(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0, 2.0, 2.0], [1.0, 2.0]), ([3.0, 4.0], [4.0, 3.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>").select(V.cosine(F.col("a"), F.col("b")).alias("c"))
    assert [round(r.c, 6) for r in df.collect()] == [1.0, 0.0, round(5 / (3 * 5**0.5), 6), 0.96]


def test_search_ties_threshold_and_k(spark):
    rows = [(i, v) for i, v in enumerate([[1.0, 0.0], [0.0, 1.0], [2.0, 0.0], [float("nan"), 1.0], [1.0, 1.0]])]
    df = spark.createDataFrame(rows, "seq long, embedding array<double>")
    hits = lambda k, least: [r.seq for r in search.top(df, [1.0, 0.0], k, least).collect()]
    assert hits(5, 0.0) == [0, 2, 4, 1] and hits(5, 1.0) == [0, 2] and hits(1, 0.0) == [0] and hits(0, 0.0) == [] and hits(9, 1.1) == []
    with pytest.raises(ValueError):
        search.top(df, [1.0, 0.0], -1)
    asked = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 1.0]), (9, [0.0, 0.0])], "qid long, query array<double>")
    for limit in (4096, 1):
        got = search.batch_top(df, asked, 2, 0.5, limit=limit).orderBy("qid", "rank").collect()
        assert [(r.qid, r.seq, r.rank) for r in got] == [(7, 0, 1), (7, 2, 2), (8, 1, 1), (8, 4, 2)]


def test_pushdown_and_topk_plans(spark):
    df = spark.createDataFrame([(1, [1.0])], "seq long, embedding array<double>")
    plan = search.top(df, [1.0], 3)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan
    asked = spark.createDataFrame([(7, [1.0])], "qid long, query array<double>")
    plan = search.batch_top(df, asked)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "MapInArrow" in plan and "NestedLoopJoin" not in plan and "Cartesian" not in plan


def test_batch_search_equals_brute_force(spark):
    rnd = random.Random(11)
    pool = [[float(rnd.randint(0, 2)) for _ in range(rnd.choice([3, 3, 3, 2, 5]))] for _ in range(40)]
    rows = [(rnd.choice(["a", "b", "c/d", None]), i, rnd.choice(pool)) for i in range(3000)] + [("n", 1, None), ("n", 2, [1.0, None, 0.0]), ("n", 3, [])]
    rnd.shuffle(rows)
    asked = [(f"q{i}", rnd.choice(pool)) for i in range(30)] + [("none", None)]

    def cosine(a, b):
        na, nb = sum(x * x for x in a) ** 0.5, sum(x * x for x in b) ** 0.5
        return sum(x * y for x, y in zip(a, b)) / (na * nb) if na and nb else 0.0

    want = []
    for q, v in asked[:-1]:
        scored = sorted((-round(cosine(v, x), 4), p or "", i) for p, i, x in rows if x is not None and None not in x)
        want += [(q, "" if p is None else p, i, -s, n + 1) for n, (s, p, i) in enumerate([x for x in scored if -x[0] >= 0.3][:7])]
    df = spark.createDataFrame(rows, "place string, seq long, embedding array<double>").repartition(3)
    qs = spark.createDataFrame(asked, "qid string, query array<double>")
    for limit in (4096, 7):
        got = search.batch_top(df, qs, 7, 0.3, order=("place", "seq"), digits=4, limit=limit).collect()
        assert sorted((r.qid, r.place or "", r.seq, round(r.score, 4), r.rank) for r in got) == sorted((q, p, i, round(s, 4), n) for q, p, i, s, n in want)
    assert search.batch_top(df, qs, 0).count() == 0 and search.batch_top(df, qs.limit(0)).count() == 0 and search.batch_top(df.limit(0), qs).count() == 0


def test_offline_embedding_counts_tokens(spark):
    texts = ["", "a b a", "one, two; ONE two zwei 2 2 2", "x " * 500]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", V.hashed_embedding("t", 16).alias("v"))
    for r in df.collect():
        want = [0.0] * 16
        for w in re.findall(r"\w+", r.t.lower()):
            want[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 16] += 1
        assert r.v == want


def test_sync_states(spark):
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "source string, digest string")
    old = spark.createDataFrame([("b", "2"), ("c", "x"), ("d", "4")], "source string, digest string")
    diff = sync.changes(new, old)
    assert {r.source: r.status for r in diff.collect()} == {"a": "added", "b": "unchanged", "c": "updated", "d": "removed"}
    assert tuple(sync.summary(diff, 9).first()) == (1, 1, 1, 1, 9)
    kept = sync.retained(spark.createDataFrame([("b",), ("c",), ("d",), ("e",)], "source string"), diff)
    assert sorted(r.source for r in kept.collect()) == ["b", "e"]


def test_prompts(spark):
    df = spark.createDataFrame([(2, "B"), (1, "A {question}")], "r int, v string")
    joined = df.agg(P.joined_in_order("r", "v").alias("c"))
    assert joined.first().c == "A {question}\n\n---\n\nB"
    filled = joined.select(P.flat_prompt("x {context} y {question} z", F.col("c"), F.lit("why?")).alias("p")).first().p
    assert filled == "x A {question}\n\n---\n\nB y why? z"
    assert spark.range(1).select(P.hides_sources(F.lit("SORRY: " + P.NOT_FOUND.upper())).alias("h")).first().h
