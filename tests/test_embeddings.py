from pyspark.sql import functions as F

from quillspark.config import Settings
from quillspark.engine import Engine
from quillspark.providers import Offline
from quillspark.sources.embeddings import Embeddings


class Paid(Offline):
    """The offline embedder under another name, which counts what it is asked for in an accumulator."""

    name = "paid"

    def __init__(self, spark, dim=16):
        super().__init__(dim)
        self.asked = spark.sparkContext.accumulator(0)

    def embed(self, text, task="RETRIEVAL_DOCUMENT"):
        asked = self.asked

        @F.udf("string")
        def counted(x):
            asked.add(1)
            return x

        return super().embed(counted.asNondeterministic()(text), task)


def test_equal_texts_are_embedded_once(spark, tmp_path):
    paid, table = Paid(spark), Embeddings(spark, str(tmp_path / "e"))
    texts = spark.createDataFrame([(1, "one two"), (2, "three"), (3, "one two"), (4, None), (5, "")], "n int, text string")
    for more in (0, 0, 1):
        some = texts.union(spark.createDataFrame([(9, "new")], texts.schema)) if more else texts
        before = paid.asked.value
        got = {r.n: r.embedding for r in table.embedded(some, paid.embed, "paid/16").collect()}
        assert got[1] == got[3] and sum(got[1]) == 2 and got[4] is None and sum(got[5]) == 0 and len(got) == 5 + more
        assert paid.asked.value - before <= (4 if not before else 1 + more)
    assert table.known("other", "RETRIEVAL_DOCUMENT").count() == 0


def test_a_sync_that_fails_repeats_no_call(spark, tmp_path, monkeypatch):
    (tmp_path / "kb").mkdir()
    for name in "abc":
        (tmp_path / "kb" / f"{name}.txt").write_text("the same text" if name != "c" else "another text")
    e = Engine(spark, tmp_path / "kb", tmp_path / "index", Paid(spark), Settings(dim=16, min_score=0.1))
    append = type(e.index).append
    monkeypatch.setattr(type(e.index), "append", lambda *a: 1 / 0)
    try:
        e.sync()
    except ZeroDivisionError:
        pass
    asked = e.provider.asked.value
    assert asked == 2
    monkeypatch.setattr(type(e.index), "append", append)
    assert e.sync()["added"] == 3 and e.provider.asked.value == asked
    assert {r.source for r in e.retrieve(spark.createDataFrame([(1, "same text")], "qid long, question string")).collect()} >= {"a.txt", "b.txt"}
