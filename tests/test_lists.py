import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import search
from quillspark.operators.lists import NONE, VectorLists, fitted, probes_for

EMBEDDINGS = "/root/testdata/sf0.1/embeddings.parquet"


def rows_of(df, *names, digits=6):
    return sorted((tuple(round(v, digits) if isinstance(v, float) else v for v in (r[n] for n in names))) for r in df.collect())


def table(spark):
    v = spark.read.parquet(EMBEDDINGS).select(F.col("vec_id").alias("seq"), F.col("embedding").cast("array<double>").alias("embedding"))
    return v, v.where("seq % 20 = 0").select(F.col("seq").alias("qid"), F.col("embedding").alias("query"))


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    vectors, asked = table(spark)
    lists = VectorLists(spark, str(tmp_path_factory.mktemp("lists")))
    lists.build(vectors)
    return lists, vectors, asked


def test_probes_reach_the_recall(spark, built):
    lists, vectors, asked = built
    want = {(r.qid, r.seq) for r in search.batch_top(vectors, asked, 5).collect()}
    got = {(r.qid, r.seq) for r in lists.probe(asked, 5).collect()}
    assert len(want & got) >= 0.9 * len(want)
    assert lists.head().probes < len(lists.head().names)


def test_exact_search_equals_the_search_over_all(spark, built):
    lists, vectors, asked = built
    for least, k in ((0.0, 5), (0.3, 5), (0.999999, 3), (-1.0, 1)):
        want = rows_of(search.batch_top(vectors, asked, k, least, digits=6), "qid", "seq", "score", "rank")
        found, skipped = lists.exact(asked, k, least, digits=6)
        assert rows_of(found, "qid", "seq", "score", "rank") == want and 0 <= skipped < 1


def clustered(n, dim, centres, seed):
    rnd = np.random.default_rng(seed)
    c = rnd.normal(size=(centres, dim)) * 5
    return [(i, (c[i % centres] + rnd.normal(size=dim) * 0.3).tolist()) for i in range(n)]


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_lists_that_lie_apart_are_skipped(spark, tmp_path, metric):
    rows = clustered(1500, 8, 30, 1)
    odd = [(5000, None), (5001, [0.0] * 8), (5002, [1.0, None] + [0.0] * 6), (5003, [1.0] * 3), (5004, rows[0][1]), (5005, [float("nan")] * 8)]
    vectors = spark.createDataFrame(rows + odd, "seq long, embedding array<double>")
    asked = vectors.where("seq % 50 = 0 or seq in (5000, 5001)").select(F.col("seq").alias("qid"), F.col("embedding").alias("query"))
    lists = VectorLists(spark, str(tmp_path / "x"))
    head = lists.build(vectors, metric, lists=30)
    assert head.sizes.sum() + head.loose == len(rows) + len(odd)
    found, skipped = lists.exact(asked, 4, digits=6)
    assert skipped > 0.8
    if metric == "cosine":
        want = search.batch_top(vectors, asked, 4, -1.0, digits=6)
        assert rows_of(found, "qid", "seq", "score", "rank") == rows_of(want, "qid", "seq", "score", "rank")
    else:
        points = {i: np.array(v) for i, v in rows + [odd[1], odd[4]]} | {5003: np.array([1.0] * 3 + [0.0] * 5)}
        for q in {r.qid for r in asked.collect()} - {5000}:
            order = sorted((round(float(((points[q] - p) ** 2).sum()), 6), i) for i, p in points.items())[:4]
            assert sorted((round(r.score, 6), r.seq) for r in found.where(F.col("qid") == q).collect()) == order


def test_only_probed_lists_are_read(spark, built):
    lists, vectors, asked = built
    one = lists.probe(asked.limit(1), 5, probes=2)
    plan = one._jdf.queryExecution().executedPlan().toString()
    part = plan[plan.index("PartitionFilters") :]
    read = lists.vectors([1, 2])
    assert "list" in part[: part.index("]")] and {r.list for r in read.select("list").distinct().collect()} == {1, 2}
    names = {f.split("list=")[1].split("/")[0] for f in lists.vectors([int(x) for x in lists.head().names[:2]]).select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    assert names == {str(x) for x in lists.head().names[:2]}


def test_small_and_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "seq long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, query array<double>")
    lists = VectorLists(spark, str(tmp_path / "none"))
    lists.build(empty)
    assert lists.probe(asked).count() == 0 and lists.exact(asked)[0].count() == 0
    few = VectorLists(spark, str(tmp_path / "few"))
    few.build(spark.createDataFrame([(1, [0.0, 2.0]), (2, [3.0, 0.1]), (3, None)], empty.schema))
    assert [(r.seq, r.rank) for r in few.exact(asked, 2)[0].orderBy("rank").collect()] == [(2, 1), (1, 2)]
    assert NONE == -1 and few.probe(empty.selectExpr("seq as qid", "embedding as query")).count() == 0
    with pytest.raises(ValueError):
        few.probe(asked, -1)


def test_centroids_and_probes():
    rnd = random.Random(2)
    sample = np.array([[rnd.choice([0, 10, 20]) + rnd.random(), rnd.choice([0, 10]) + rnd.random()] for _ in range(600)])
    centres = fitted(sample, 6)
    assert np.sqrt(((sample[:, None] - centres) ** 2).sum(axis=2).min(axis=1)).mean() < 3
    assert 1 <= probes_for(sample, centres) <= 6
