import random

import sentencepiece

from quillspark.llm import tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PARTS = ["a", "the", "é", "\n", " ", "  ", "\t", "<s>", "▁", "ﬁ", "\r", "\x00", "日本", "😀", "\xa0", "​", "AKIA", "1", ".", "\n\n", "<0x0A>", "\x85"]


def test_counts_equal_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=tokens.model_path())
    rnd = random.Random(5)
    rows = [(i, "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 12)))) for i in range(3000)]
    rows += [(5000, None), (5001, ""), (5002, "the " * 5000), (None, "x"), (3, "repeated id"), (5003, "q" * 20000)]
    df = spark.createDataFrame([(d, t, None, None, 0) for d, t in rows], DOCS)
    want = [(d, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for d, t in rows]
    assert sorted(map(tuple, tokens.token_counts(df).collect()), key=repr) == sorted(want, key=repr)


def test_shortcut_is_proven_and_memo_is_bounded():
    c = tokens.Counter(tokens.model_path(), memo=50)
    assert c.separable and len(c.whole) > 10_000
    some = random.Random(1).sample(sorted(c.whole), 500)
    assert all(len(c.model.encode(u)) == 1 for u in some if u)
    c.count_all([" ".join(f"zzq{i}x{k}" for k in range(30)) for i in range(20)])
    for i in range(10):
        c.count_all([f"unit{i}{k}" for k in range(20)])
    assert len(c) - len(c.whole) <= 50


def test_empty_table(spark):
    assert tokens.token_counts(spark.createDataFrame([], DOCS)).count() == 0


def test_batch_settings_may_have_units(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        for given, kept in (("64m", str(4 << 20)), ("1m", "1m"), ("2048b", "2048b")):
            spark.conf.set(name, given)
            assert tokens.token_counts(spark.createDataFrame([(1, "a b", None, None, 1)], DOCS)).first().n_tokens == 2
            assert spark.conf.get(name) == kept
    finally:
        spark.conf.set(name, before)
