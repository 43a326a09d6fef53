import random
import zlib
from collections import Counter

from quillspark.llm import sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_law_and_mixture(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice(["text", "é", None, "x" * 50]), "en", "hot" if i % 3 else f"s{i % 7}" if i % 2 else None, 1) for i in range(1001)]
    rows += [(5, "text", "en", "hot", 1)] * 3 + [(None, "no id", None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    out = sharding.interleave(df, identity=("doc_id", "text"), bucket=60).collect()
    assert Counter(map(tuple, [r[:5] for r in out])) == Counter(rows)
    sizes = Counter(r.shard for r in out)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(16):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))
        for source, n in Counter(r[3] for r in rows).items():
            mine = sum(r.shard == s and r.source == source for r in out)
            assert abs(mine - n / 16) <= 2
    one = {(r.doc_id, r.text, r.source): r.shard for r in sharding.interleave(df, identity=("doc_id", "text"), bucket=10**6).collect() if r.doc_id != 5}
    assert all(one[(r.doc_id, r.text, r.source)] == r.shard for r in out if r.doc_id != 5)


def test_contract_columns(spark):
    rows = [(1, "é", None, "a", 1), (2, None, None, "a", 1), (3, "x", None, None, 1)]
    out = {r.doc_id: r for r in sharding.assign(spark.createDataFrame(rows, DOCS)).collect()}
    assert {d: (r.size, r.text_crc32, r.law) for d, r in out.items()} == {
        1: (3, zlib.crc32("é".encode()), "rows"), 2: (1, 0, "rows"), 3: (2, zlib.crc32(b"x"), "rows")}
    assert len({r.shard for r in out.values()}) == 3 and all(r.slot == 0 and r.grown_shard is None for r in out.values())
    assert sharding.assign(spark.createDataFrame([], DOCS)).count() == 0
