import random
import re

import corpus_pipeline
from quillspark.llm import decontam, packing, quality, secrets, sharding, simhash, tokens
from test_decontam import brute
from test_pii import base
from test_quality import corpus
from test_simhash import naive_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def near_groups(rows):
    """The smallest id that each row reaches over op5's links or over a Jaccard similarity of 0.8 of 5-word shingles."""
    group = {i: c for i, _, c in naive_components(rows)}
    words = {i: (t or "").lower().split() for i, t in rows}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items() if w}
    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    return group


def test_near_copies_are_caught(spark):
    docs, _ = corpus(120)
    rnd = random.Random(31)
    rows = [(i, t) for i, t, *_ in docs[:120] if t and len(t.split()) > 60]
    copies = []
    for i, t in rows:
        words = t.split()
        words[rnd.randrange(len(words))] = "edited"
        copies.append((5000 + i, " ".join(words)))
    d = spark.createDataFrame([(i, t, None, None, 1) for i, t in rows + copies], DOCS)
    left = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, d, "").collect()}
    groups = near_groups(rows + copies)
    assert left == {i for i, g in groups.items() if i == g} and sum(5000 + i in left for i, _ in rows) <= 0.1 * len(rows)


def test_stages_equal_brute_force(spark, tmp_path):
    rnd = random.Random(12)
    docs, labels = corpus(200)
    word = lambda: "".join(rnd.choice(["on", "the", "ti", "er", "an", "re"]) for _ in range(rnd.randint(1, 4)))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(5)]
    for i in range(30):
        words = docs[rnd.choice([k for k in range(200) if k % 3])][1].split()
        if i % 3 == 0:
            words += items[i % 5][1].split() + words[:10]
        if i % 3 == 1:
            words.insert(len(words) // 2, rnd.choice(["jo.x@mail.example.com", "10.20.30.40", "+1 (319) 555-5132"]))
        text = " ".join(words)
        docs.append((1000 + i, text, "en", "s", len(text)))
    docs += [(2000, None, None, None, None), (2001, "", None, None, 0)]
    folder = str(tmp_path)
    spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    d = spark.read.parquet(f"{folder}/documents.parquet")
    scores = {r.doc_id: r.score for r in quality.assess(d, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    kept = [(i, t) for i, t, *_ in docs if scores[i] >= 0.3]
    groups = near_groups(kept)
    kept = [(i, t) for i, t in kept if groups[i] == i]
    bad = {x[0] for x in brute(kept, items)}
    kept = [(i, t) for i, t in kept if i not in bad]
    assert bad and 0 < len(kept) < len(docs)

    def clean(text):
        last, out = 0, ""
        for kind, s, e in sorted(base(text), key=lambda x: (x[1], -x[2])):
            if s >= last:
                out, last = out + text[last:s] + f"[{kind.upper()}]", e
        return out + text[last:] if text is not None else None

    ids = packing.Ids(packing.vocabulary_path())
    want = {i: len(ids(clean(t))) // 4 + 1 for i, t in kept}
    got = {r.doc_id: r.doc_tokens for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == want and any("[EMAIL]" in (clean(t) or "") for _, t in kept)


CLASHES = ("row", "key", "k", "i", "doc", "hits", "t", "base", "fp", "ids", "score", "shard", "lines", "a.b")


def with_clashes(df):
    return df.selectExpr("*", *[f"doc_id as `{c}`" for c in CLASHES])


def test_stages_take_empty_tables_and_columns_of_any_name(spark, tmp_path):
    docs, labels = corpus(60)
    item = " ".join(f"item{k}" for k in range(30))
    docs += [(500, item, "en", "s", 9), (501, "mail a@b.cd " + docs[1][1], "en", "s", 9), (None, None, None, None, None)]
    folder = str(tmp_path)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    plain = spark.createDataFrame(docs, DOCS)
    for name, stage in corpus_pipeline.STAGES:
        wide = stage(spark, with_clashes(plain), folder)
        got, want = wide.collect(), stage(spark, plain, folder).collect()
        if name != "packing":
            assert wide.columns == with_clashes(plain).columns
            assert all(r[c] == r.doc_id for r in got for c in CLASHES)
        assert sorted((repr(r.doc_id) for r in got)) == sorted(repr(r.doc_id) for r in want), name
        assert stage(spark, with_clashes(plain).limit(0), folder).count() == 0


def test_operators_ignore_columns_of_any_name(spark):
    docs, labels = corpus(30)
    d = spark.createDataFrame(docs, DOCS)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, docs[1][1], 5)], "item_id long, text string, doc_id long")
    for run in (
        lambda x: quality.assess(x, lab.withColumn("text", lab.doc_id)),
        lambda x: decontam.contaminated(x, items),
        lambda x: simhash.near_duplicate_groups(x),
        lambda x: sharding.assign(x),
        lambda x: tokens.token_counts(x),
        lambda x: secrets.digest(secrets.scan(x)),
    ):
        one, two = run(d), run(with_clashes(d))
        assert one.columns == two.columns and sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))
        assert run(with_clashes(d).limit(0)).count() == 0
    shared = sharding.interleave(with_clashes(d).drop("shard"))
    assert shared.count() == 30 and {*CLASHES} <= {*shared.columns}


def test_stages_are_named_functions_and_keep_columns():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "simhash", "decontam", "pii", "packing"]
    assert all(re.fullmatch("[a-z_]+", f.__name__) for _, f in corpus_pipeline.STAGES) and simhash.RADIUS == 2 and decontam.THRESHOLD == 0.8
