import os
import threading

import pytest
from pyspark.sql import functions as F

from quillspark.config import Settings
from quillspark.engine import Engine
from quillspark.providers import Offline
from quillspark.sources import files
from quillspark.sources import index as I
from quillspark.sources.index import NAMES, Conflict, Index
from quillspark.storage import Store


def kb(spark, tmp_path, name="kb"):
    folder = tmp_path / name
    folder.mkdir(exist_ok=True)
    return Engine(spark, folder, tmp_path / "index", Offline(64), Settings(dim=64, min_score=0.1))


def write(folder, **texts):
    for name, text in texts.items():
        (folder / f"{name}.txt").write_text(text)


def records(spark, rows):
    """Rows (source, text), a chunk each."""
    df = spark.createDataFrame(rows, "source string, text string")
    made = df.select(F.concat("source", F.lit("::chunk_0")).alias("id"), "text", "source", F.lit(0).alias("chunk_index"), F.array(F.lit(1.0)).alias("embedding"), F.lit(1.0).alias("norm"), F.lit(0).cast("long").alias("seq"))
    listed = df.select("source", F.lit("d").alias("digest"), F.lit("c").alias("config")).distinct()
    return made, listed


def live(index):
    return sorted((r.source, r.text) for r in index.records().collect())


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_of_many_writers_one_gets_a_name(spark, tmp_path):
    for folder in (str(tmp_path / "a"), (tmp_path / "b").as_uri()):
        store, won = Store(spark, folder), []
        threads = [threading.Thread(target=lambda k=k: store.create_text("000000000001", f"text {k}", f".{k}") and won.append(k)) for k in range(12)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        assert len(won) == 1 and store.read_text("000000000001") == f"text {won[0]}"
        assert [n for n, _, _ in store.entries() if not n.endswith(".crc")] == ["000000000001"]


def test_syncs_that_overlap_on_other_sources_both_remain(spark, tmp_path):
    index, none = Index(spark, tmp_path / "i"), spark.createDataFrame([], "source string")
    index.commit(*records(spark, [("base", "0"), ("x", "old")]))
    base = index.number()
    index.append(*records(spark, [("b", "B")]), none, base)
    index.append(*records(spark, [("a", "A"), ("x", "new")]), none, base)  # began before b was there
    assert live(index) == [("a", "A"), ("b", "B"), ("base", "0"), ("x", "new")]
    assert {r.source for r in index.manifest().collect()} == {"a", "b", "base", "x"}
    assert index.number() == 3 and index.state()["seq"] == 2


def test_syncs_that_overlap_on_a_source_do_not_lose_it(spark, tmp_path):
    index, none = Index(spark, tmp_path / "i"), spark.createDataFrame([], "source string")
    index.commit(*records(spark, [("base", "0")]))
    base, before = index.number(), set(os.listdir(tmp_path / "i"))
    index.append(*records(spark, [("a", "first")]), none, base)
    between = set(os.listdir(tmp_path / "i"))
    with pytest.raises(Conflict):
        index.append(*records(spark, [("a", "second")]), none, base)
    with pytest.raises(Conflict):
        index.append(*records(spark, [("c", "C")]), spark.createDataFrame([("a",)], "source string"), base)
    assert live(index) == [("a", "first"), ("base", "0")] and set(os.listdir(tmp_path / "i")) == between > before
    index.commit(*records(spark, [("all", "new")]))  # replaces whatever there is
    with pytest.raises(Conflict):
        index.append(*records(spark, [("d", "D")]), none, base)
    assert live(index) == [("all", "new")]


def test_a_sync_that_is_overlapped_begins_again(spark, tmp_path, monkeypatch):
    one, two = kb(spark, tmp_path), kb(spark, tmp_path)
    write(one.folder, a="Amman is a city.", b="Irbid is a city.")
    append, once = Index.append, []

    def overtaken(self, *args):
        if not once:
            once.append(1)
            two.sync()
        return append(self, *args)

    monkeypatch.setattr(Index, "append", overtaken)
    assert one.sync() == {"added": 0, "updated": 0, "unchanged": 2, "removed": 0, "total_chunks": 2}
    assert sorted(r.source for r in one.index.records().collect()) == ["a.txt", "b.txt"]


def test_dead_records_are_left_out_by_bitmaps_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "DEAD_SHARE", 0.9)
    index = Index(spark, tmp_path / "i")
    index.commit(*records(spark, [(f"s{i:04d}", "old") for i in range(3000)]))
    want = {f"s{i:04d}": "old" for i in range(3000)}
    for at in range(3):
        changed = [f"s{i:04d}" for i in range(at, 3000, 7 + at)]
        gone = [f"s{i:04d}" for i in range(at, 3000, 11)]
        fresh = [(s, f"new {at}") for s in changed if s not in gone]
        index.append(*records(spark, fresh), spark.createDataFrame([(s,) for s in gone], "source string"))
        want = {s: t for s, t in want.items() if s not in gone} | dict(fresh)
        assert live(index) == sorted(want.items())
    state = index.state()
    assert len(state["parts"]) == 4 and state["rows"] - state["dead"] == len(want) and "Join" not in plan(index.records())
    assert spark.read.parquet(f"{tmp_path}/i/{state['version']}/dead").count() <= 3 * 4 * 4
    monkeypatch.setattr(I, "BITMAPS", 1)
    index.append(*records(spark, [("z", "Z")]), spark.createDataFrame([], "source string"))
    assert live(index) == sorted((want | {"z": "Z"}).items()) and index.state()["dead"] == 0 and len(index.state()["parts"]) == 1
    assert index.vacuum() > 3 and live(index)[-1] == ("z", "Z") and len([n for n in os.listdir(tmp_path / "i" / "log") if not n.endswith(".crc")]) == 1


def test_versions_in_use_are_kept_until_they_expire(spark, tmp_path):
    index = Index(spark, tmp_path / "i")
    for i in range(3):
        index.commit(*records(spark, [("a", str(i))]))
    reader = index.records(index.state(2))
    assert index.vacuum(3600) == 0 and [r.text for r in reader.collect()] == ["1"]
    assert index.vacuum() == 2 and live(index) == [("a", "2")]
    with pytest.raises(Conflict):
        index.state(1)


def test_texts_are_found_without_reading_the_others(spark, tmp_path):
    index = Index(spark, tmp_path / "i")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as many files as a larger table would have
    try:
        index.commit(*records(spark, [(f"s{i:05d}", "text " * 50) for i in range(4000)]))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    names = [n for n in os.listdir(tmp_path / "i" / index.version() / "records") if n.endswith(".parquet")]
    assert len(names) > 1
    found = index.texts(["s00007::chunk_0", "s00009::chunk_0"])
    assert found.count() == 2 and "PushedFilters: [In(id" in found._jdf.queryExecution().executedPlan().toString()
    rows = found._jdf.queryExecution()
    found.collect()

    def leaves(p):
        return [p] if not p.children().size() else [x for i in range(p.children().size()) for x in leaves(p.children().apply(i))]

    scan = leaves(rows.executedPlan())[0]
    assert scan.metrics().apply("numOutputRows").value() <= 2 * 4000 / len(names)
    many = index.texts([f"s{i:05d}::chunk_0" for i in range(100)])
    assert many.where(F.col("id") < "s00100").count() == 100


def test_hits_get_their_texts_without_a_shuffle_of_texts(spark, tmp_path):
    e = kb(spark, tmp_path)
    write(e.folder, **{f"t{i}": f"word{i} and again word{i} among others" for i in range(30)})
    e.sync()
    asked = spark.createDataFrame([(i, f"word{i}") for i in (3, 7)], "qid long, question string")
    hits = e.retrieve(asked)
    assert {(r.qid, r.source) for r in hits.where("rank = 1").collect()} == {(3, "t3.txt"), (7, "t7.txt")}
    physical = hits._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in physical and "SortMergeJoin" not in physical and "hashpartitioning" not in physical
    assert e.retrieve(asked.limit(0)).count() == 0


def test_a_sync_without_changes_opens_no_file(spark, tmp_path, monkeypatch):
    e = kb(spark, tmp_path)
    write(e.folder, a="Amman", b="Irbid", c="Aqaba")
    for name in "abc":
        os.utime(e.folder / f"{name}.txt", (1_000_000, 1_000_000))
    assert e.sync()["added"] == 3
    number, given = e.index.number(), e.index.manifest()
    monkeypatch.setattr(files, "digest_of", lambda path: F.raise_error(F.concat(F.lit("opened "), path)))
    assert e.sync()["unchanged"] == 3 and e.index.number() == number
    with pytest.raises(Exception, match="opened"):
        e.current(given.limit(0)).count()
        e.current(given.limit(0)).collect()
    monkeypatch.undo()
    os.utime(e.folder / "a.txt", (2_000_000, 2_000_000))  # touched, of the same content
    write(e.folder, b="Zarqa")
    os.utime(e.folder / "b.txt", (1_000_000, 2_000_000))  # the same size
    assert e.sync() == {"added": 0, "updated": 1, "unchanged": 2, "removed": 0, "total_chunks": 3}
    assert dict(live(e.index))["b.txt"] == "Zarqa"


def test_a_file_that_changed_just_now_is_hashed_again(spark, tmp_path):
    e = kb(spark, tmp_path)
    write(e.folder, a="one")
    e.sync()
    before = os.stat(e.folder / "a.txt")
    write(e.folder, a="two")
    os.utime(e.folder / "a.txt", ns=(before.st_atime_ns, before.st_mtime_ns))
    assert e.sync()["updated"] == 1 and live(e.index) == [("a.txt", "two")]
    assert NAMES[0] == "id" and files.BATCH > 0
