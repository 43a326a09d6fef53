import io
import json
import os
import sys
import zipfile
from types import SimpleNamespace

import pytest

from quillspark import cli
from quillspark.config import Settings, api_key, flat_settings, load_env
from quillspark.engine import Engine, FlatEngine
from quillspark.functions import prompts as P
from quillspark.providers import Gemini, Offline, Remote, in_batches, with_retries
from quillspark.sources import files
from quillspark.sources.index import PARTS, Index
from quillspark.streaming import answer_stream


def write(folder, **texts):
    for name, text in texts.items():
        path = folder / name.replace("__", "/").replace("_dot_", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())


def docx(*body):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{"".join(body)}</w:body></w:document>')
    return out.getvalue()


def test_discovery(spark, tmp_path):
    for name in ["a.txt", "b.md", "c.csv", "d.unsupported", "sub/E.TXT", "_x/f.txt", ".h/g.md", "_k.txt", ".txt", "empty.txt", "a/z.txt", "with space.markdown"]:
        write(tmp_path, **{name.replace("/", "__").replace(".", "_dot_"): "" if name == "empty.txt" else "hi"})
    got = [r.source for r in files.discover(spark, tmp_path).collect()]
    assert got == [".h/g.md", "_k.txt", "_x/f.txt", "a/z.txt", "a.txt", "b.md", "c.csv", "empty.txt", "sub/E.TXT", "with space.markdown"]
    flat = {r.source for r in files.discover(spark, tmp_path, recursive=False).collect()}
    assert flat == {"_k.txt", "a.txt", "b.md", "c.csv", "empty.txt"}
    assert files.discover(spark, tmp_path / "missing").count() == 0
    assert [r.depth for r in files.tree(spark, tmp_path).collect()].count(1) == 4


def test_readers():
    assert files.text_of(b"caf\xc3\xa9 \xff bad\r\nx\ry") == "café  bad\nx\ny"
    table = b'\xef\xbb\xbfname, role ,x\n"Khaled, A", "q""q" ,"two\nlines"\n\nshort\na,b,c,d\n,,\n'
    assert files.csv_text(table) == "﻿name: Khaled, A, role: q\"\"q\", x: two\nlines".replace('q""q"', '"q""q"') + "\n\n﻿name: short\n﻿name: a, role: b, x: c\n﻿name: , role: , x: "
    assert files.csv_text(b"") == files.csv_text(b"only,header") == ""
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    row = lambda *c: "<w:tr>" + "".join(f"<w:tc>{p(x)}</w:tc>" for x in c) + "</w:tr>"
    assert files.docx_text(docx(p("One"), f"<w:tbl>{row(' a ', '')}{row('', '')}</w:tbl>", p(" "), p("Two"))) == "One\nTwo\na | "
    with pytest.raises(ValueError):
        files.parse(".exe", b"")


def test_read_reports_bad_files(spark, tmp_path):
    write(tmp_path, a_dot_txt="Amman is the capital of Jordan.", b_dot_csv="name,role\nKhaled,Student", c_dot_docx=b"no zip", d_dot_pdf=b"%PDF")
    got = {r.source: (r.text, r.error) for r in files.read(files.discover(spark, tmp_path)).collect()}
    assert got["a.txt"] == ("Amman is the capital of Jordan.", None) and got["b.csv"] == ("name: Khaled, role: Student", None)
    assert got["c.docx"][0] is None and "BadZipFile" in got["c.docx"][1] and got["d.pdf"][1]


def kb(spark, tmp_path, **settings):
    folder = tmp_path / "kb"
    folder.mkdir(exist_ok=True)
    return Engine(spark, folder, tmp_path / "index", Offline(64), Settings(dim=64, **settings))


def test_sync_lifecycle(spark, tmp_path):
    e = kb(spark, tmp_path, min_score=0.4)
    folder = e.folder
    assert e.answer("anything")["answer"] == P.EMPTY
    write(folder, a_dot_txt="Amman is the capital of Jordan.", b_dot_csv="name,role\nKhaled,Student", sub__c_dot_md="x" * 2500, empty_dot_txt="")
    said = []
    assert e.sync(say=said.append) == {"added": 4, "updated": 0, "unchanged": 0, "removed": 0, "total_chunks": 5}
    assert "[sync] Added: empty.txt (0 chunks)" in said and said[-1] == "[sync] Done. Added=4 Updated=0 Unchanged=0 Removed=0 TotalChunks=5"
    assert e.sync() == {"added": 0, "updated": 0, "unchanged": 4, "removed": 0, "total_chunks": 5}
    write(folder, a_dot_txt="Amman is the capital city of Jordan.", bad_dot_docx=b"broken")
    os.remove(folder / "sub" / "c.md")
    said.clear()
    assert e.sync(say=said.append) == {"added": 1, "updated": 1, "unchanged": 2, "removed": 1, "total_chunks": 2}
    assert "[sync] Removed (deleted from disk): sub/c.md" in said and any("bad.docx" in x and "Warning" in x for x in said)
    order = [r.id for r in e.index.records().orderBy("seq").collect()]
    assert order == ["b.csv::chunk_0", "a.txt::chunk_0"]
    assert e.sync(force=True)["added"] == 4
    got = e.answer("What is the capital of Jordan")
    assert "Amman" in got["answer"] and got["sources"][0]["source"] == "a.txt" and got["sources"][0]["chunk_index"] == 0
    assert e.answer("zebra quantum") == {"answer": P.NOT_FOUND, "sources": []}
    other = Engine(spark, folder, tmp_path / "index", Offline(32), Settings(dim=32))
    assert other.sync()["updated"] == 3
    # four syncs changed something; the one that did not wrote no version
    assert e.index.vacuum() == 3 and e.index.records().count() == 2
    os.rename(folder, tmp_path / "gone")
    with pytest.raises(FileNotFoundError):
        e.sync()


def test_sources_added_by_later_syncs_are_hits_of_their_own(spark, tmp_path):
    e = kb(spark, tmp_path, min_score=0.1)
    write(e.folder, a_dot_txt="Amman is the capital of Jordan.")
    e.sync()
    write(e.folder, b_dot_txt="Amman is a city of Jordan.")
    e.sync()
    assert [(r.id, r.seq) for r in e.index.records().orderBy("seq").collect()] == [("a.txt::chunk_0", 0), ("b.txt::chunk_0", 1)]
    hits = e.retrieve(spark.createDataFrame([(1, "Amman is the capital of Jordan")], "qid long, question string")).orderBy("rank").collect()
    assert [(r["rank"], r.source, r.text) for r in hits] == [(1, "a.txt", "Amman is the capital of Jordan."), (2, "b.txt", "Amman is a city of Jordan.")]


def test_equal_scores_come_in_order_of_sync_then_path(spark, tmp_path):
    e = kb(spark, tmp_path, min_score=0.1)
    write(e.folder, z_dot_txt="one two", a_b_dot_txt="one two", a__z_dot_txt="one two")
    e.sync()
    write(e.folder, A_dot_txt="one two")
    e.sync()
    hits = e.retrieve(spark.createDataFrame([(1, "two one")], "qid long, question string")).orderBy("rank").collect()
    assert [r.source for r in hits] == ["a/z.txt", "a_b.txt", "z.txt", "A.txt"]


def test_syncs_append_until_the_index_is_written_whole(spark, tmp_path):
    e = kb(spark, tmp_path)
    write(e.folder, a_dot_txt="first", b_dot_txt="second")
    e.sync()
    parts = []
    for i in range(PARTS + 1):
        write(e.folder, a_dot_txt=f"first again {i}", **{f"c{i}_dot_txt": f"third {i}"})
        e.sync()
        parts.append(len(e.index.state()["parts"]))
        want = {"a.txt": f"first again {i}", "b.txt": "second"} | {f"c{k}.txt": f"third {k}" for k in range(i + 1)}
        assert {r.source: r.text for r in e.index.records().collect()} == want
    assert parts == [*range(2, PARTS + 1), 1, 2]
    before = set(os.listdir(e.index.folder))
    with pytest.raises(Exception):
        e.index.append(e.index.records().select("no_such"), e.index.manifest(), e.index.manifest())
    assert set(os.listdir(e.index.folder)) == before and e.index.records().count() == 2 + PARTS + 1


def test_folders_may_be_uris(spark, tmp_path):
    folder, uri = tmp_path / "kb", tmp_path.as_uri()
    write(folder, a_dot_txt="Amman is the capital of Jordan.", sub___x_dot_md="Bread", sub__deep__y_dot_csv="a,b\n1,2", empty_dot_txt="")
    assert [r.source for r in files.discover(spark, f"{uri}/kb").collect()] == [r.source for r in files.discover(spark, folder).collect()] == ["a.txt", "empty.txt", "sub/_x.md", "sub/deep/y.csv"]
    assert files.discover(spark, f"{uri}/none").count() == 0
    e = Engine(spark, f"{uri}/kb", f"{uri}/index", Offline(64), Settings(dim=64, min_score=0.1))
    assert e.sync()["added"] == 4 and "Amman" in e.answer("capital of Jordan")["answer"] and e.sync()["unchanged"] == 4
    assert FlatEngine(spark, f"{uri}/kb", f"{uri}/flat", Offline(64)).build() == 1


class Says(Offline):
    def __init__(self, text):
        super().__init__(64)
        self.text = text

    def generate(self, prompt):
        from pyspark.sql import functions as F

        return F.lit(self.text)


@pytest.mark.parametrize("text, answer, shown", [("", P.NOT_FOUND, False), (P.NOT_FOUND.upper(), P.NOT_FOUND.upper(), False), ("Yes.", "Yes.", True)])
def test_sources_follow_the_answer(spark, tmp_path, text, answer, shown):
    e = kb(spark, tmp_path, min_score=0.1)
    write(e.folder, a_dot_txt="Amman is the capital of Jordan.")
    e.sync()
    e.provider = Says(text)
    got = e.answer("capital of Jordan")
    assert got["answer"] == answer and bool(got["sources"]) == shown


def test_index_json_round_trip(spark, tmp_path):
    e = kb(spark, tmp_path)
    write(e.folder, a_dot_txt="one\ntwo", b_dot_txt="three")
    e.sync()
    e.index.export_json(tmp_path / "x.json")
    doc = json.loads((tmp_path / "x.json").read_text())
    assert [r["id"] for r in doc["records"]] == ["a.txt::chunk_0", "b.txt::chunk_0"] and set(doc["file_hashes"]) == {"a.txt", "b.txt"}
    copy = Index(spark, tmp_path / "copy")
    assert copy.is_empty()
    copy.import_json(tmp_path / "x.json")
    assert [r.text for r in copy.records().orderBy("seq").collect()] == ["one\ntwo", "three"] and copy.manifest().count() == 2
    (tmp_path / "bad.json").write_text("{corrupt")
    with pytest.raises(Exception):
        copy.import_json(tmp_path / "bad.json")
    copy.clear()
    assert copy.is_empty()


def test_retries_and_batches():
    waits, calls = [], []

    def flaky(part):
        calls.append(len(part))
        if len(calls) == 1:
            raise OSError("later")
        return [[1.0]] * len(part)

    assert len(in_batches(["t"] * 33, flaky, wait=waits.append)) == 33 and calls == [32, 32, 1] and waits == [2]
    waits.clear()
    with pytest.raises(RuntimeError, match="after 3 attempts"):
        with_retries(lambda: 1 / 0, wait=waits.append)
    assert waits == [2, 4]
    with pytest.raises(RuntimeError):
        in_batches(["a", "b"], lambda part: [[1.0]])


def test_flat_engine(spark, tmp_path):
    (tmp_path / "kb").mkdir()
    write(tmp_path / "kb", a_dot_txt="Amman is the capital of Jordan.", b_dot_md="Bread is baked.", c_dot_docx=b"broken", sub__d_dot_txt="hidden")
    e = FlatEngine(spark, tmp_path / "kb", tmp_path / "flat", Offline(64))
    assert e.answer("x")[1] == [] and e.build() == 2
    text, sources = e.answer("capital of Jordan")
    assert "Amman" in text and sources == ["a.txt", "b.md"] and flat_settings().top_k == 4


def test_cli(tmp_path, monkeypatch, capsys, spark):
    monkeypatch.setattr(cli, "session", lambda: spark)
    base = ["--kb-dir", str(tmp_path / "kb"), "--index-dir", str(tmp_path / "i")]
    assert cli.main([*base, "sync"]) == 0 and "Done. Added=0" in capsys.readouterr().out
    write(tmp_path / "kb", a_dot_txt="Amman is the capital of Jordan.")
    assert cli.main([*base, "ask", "Amman is the capital of Jordan?"]) == 0
    out = capsys.readouterr().out
    assert "ANSWER:" in out and "  - a.txt (chunk 0, relevance 1.0)" in out
    lines = iter(["  ", "what", "QUIT"])
    monkeypatch.setattr("builtins.input", lambda _: next(lines))
    assert cli.main([*base, "chat"]) == 0 and "Goodbye!" in capsys.readouterr().out
    assert cli.main(["--kb-dir", str(tmp_path / "none"), "ask", "x"]) == 1 and "Configuration error" in capsys.readouterr().err


def test_chat_reads_questions_until_the_end(capsys):
    for given, want in ((["a", " ", "b", "Exit", "c"], ["a", "b"]), (["quit"], []), (["a", None], ["a"])):
        lines = iter(given)

        def read(_):
            if (line := next(lines)) is None:
                raise EOFError
            return line

        assert list(cli.questions(read)) == want


def test_flat_command(tmp_path, monkeypatch, capsys, spark):
    monkeypatch.setattr(cli, "session", lambda: spark)
    base = ["--kb-dir", str(tmp_path / "kb"), "--index-dir", str(tmp_path / "i")]
    assert cli.main([*base, "flat"]) == 0 and "Nothing to load" in capsys.readouterr().out
    write(tmp_path / "kb", a_dot_txt="Amman is the capital of Jordan.", b_dot_docx=b"broken")
    assert cli.main([*base, "flat", "capital of Jordan"]) == 0
    out = capsys.readouterr().out
    assert "Skipped 'b.docx'" in out and "Indexed 1 chunk(s)." in out and "Assistant: Amman is the capital of Jordan." in out and "(Sources: a.txt)" in out
    lines = iter(["what", "exit"])
    monkeypatch.setattr("builtins.input", lambda _: next(lines))
    monkeypatch.setattr(FlatEngine, "answer", lambda self, q: 1 / 0)
    assert cli.main([*base, "flat"]) == 0 and "could not be answered" in capsys.readouterr().out


def test_remote_provider_needs_a_key_and_sends_what_it_should(tmp_path, monkeypatch, capsys):
    for name in ("GEMINI_API_KEY", "GOOGLE_API_KEY"):
        monkeypatch.delenv(name, raising=False)
    monkeypatch.chdir(tmp_path)
    base = ["--kb-dir", str(tmp_path), "--index-dir", str(tmp_path / "i")]
    assert cli.main([*base, "--provider", "gemini", "ask", "x"]) == 1 and "Configuration error: no API key" in capsys.readouterr().err
    assert cli.main([*base, "--provider", "other", "ask", "x"]) == 1 and "no provider" in capsys.readouterr().err
    (tmp_path / ".env").write_text("# keys\nGOOGLE_API_KEY='from file'\n")
    load_env()
    assert api_key() == "from file"
    monkeypatch.setenv("GEMINI_API_KEY", "k")
    sent = []

    class Models:
        def embed_content(self, **given):
            sent.append(given)
            return SimpleNamespace(embeddings=[SimpleNamespace(values=[1, 2]) for _ in given["contents"]])

        def generate_content(self, **given):
            sent.append(given)
            return SimpleNamespace(text=" said ")

    client = SimpleNamespace(Client=lambda api_key: SimpleNamespace(models=Models()) if api_key == "k" else None)
    client.types = SimpleNamespace(EmbedContentConfig=dict, GenerateContentConfig=dict)
    monkeypatch.setitem(sys.modules, "google", SimpleNamespace(genai=client))
    monkeypatch.setitem(sys.modules, "google.genai", client)
    p = Gemini()
    assert p.embedder()(["a", "b"], "RETRIEVAL_QUERY") == [[1, 2], [1, 2]] and p.generator()("ask") == " said "
    assert sent[0] == {"model": "gemini-embedding-001", "contents": ["a", "b"], "config": {"task_type": "RETRIEVAL_QUERY"}}
    assert sent[1] == {"model": "gemini-2.5-flash", "contents": "ask", "config": {"system_instruction": P.SYSTEM}} and P.NOT_FOUND in P.SYSTEM
    Gemini(flat=True).generator()("ask")
    assert sent[2]["config"] == {"temperature": 0.0}


def test_remote_columns_call_in_batches(spark):
    def client():
        return lambda texts, task: [[float(len(texts)), float(len(task))] for _ in texts]

    p = Remote(client, lambda: lambda prompt: f" {prompt}! ")
    df = spark.createDataFrame([(str(i),) for i in range(40)], "t string").coalesce(1)
    assert sorted({r.v[0] for r in df.select(p.embed("t").alias("v")).collect()}) == [8.0, 32.0]
    assert {tuple(r.v) for r in df.select(p.embed("t", "RETRIEVAL_QUERY").alias("v")).collect()} == {(1.0, 15.0)}
    assert df.select(p.generate("t").alias("a")).first().a == "0!"


def test_key_and_settings(monkeypatch):
    monkeypatch.delenv("GEMINI_API_KEY", raising=False)
    monkeypatch.setenv("GOOGLE_API_KEY", "g")
    assert api_key() == "g" and api_key("x") == "x"
    monkeypatch.delenv("GOOGLE_API_KEY")
    with pytest.raises(OSError):
        api_key()
    with pytest.raises(ValueError):
        Settings(overlap=0)


def test_unzip(tmp_path):
    assert not files.unzip(tmp_path / "no.zip", tmp_path)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/a.txt", "hi")
    assert files.unzip(tmp_path / "a.zip", tmp_path) and (tmp_path / "x" / "a.txt").read_text() == "hi"


def test_answers_of_a_stream(spark, tmp_path):
    e = kb(spark, tmp_path, min_score=0.1)
    write(e.folder, a_dot_txt="Amman is the capital of Jordan.")
    e.sync()
    spark.createDataFrame([(1, "capital of Jordan")], "qid long, question string").write.json(str(tmp_path / "q"))
    got = []
    stream = answer_stream(e, spark.readStream.schema("qid long, question string").json(str(tmp_path / "q")), lambda df, n: got.extend(df.collect()), str(tmp_path / "cp"))
    stream.processAllAvailable()
    stream.stop()
    assert [r.qid for r in got] == [1] and "Amman" in got[0].answer
