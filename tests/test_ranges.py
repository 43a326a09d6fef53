import random

import pytest

from quillspark.sources import ranges as R
from quillspark.sources.files import csv_text

PARTS = ["a", "b c", '"', '""', ",", ",", "\n", "\r\n", "\r", "é", "😀", ' "x" ', '"q,\n""r"', "\n\n", "\t", "\xa0"]


def lines(path, data, size):
    path.write_bytes(data)
    out, state = [], R.BEGIN
    for start in range(0, max(1, len(data)), size):
        out += R._range_lines(str(path), start, size, state)
        state = int(R.effect(data[start : start + size])[state])
    return out


def test_any_cut_gives_the_lines_of_the_whole(tmp_path, monkeypatch):
    rnd = random.Random(1)
    monkeypatch.setattr(R, "AHEAD", 3)
    cases = [b"", b"a,b", b"a,b\n", b"\n\n1,2\n", b'"a\nb",c\n1,"2\n3"\n', b"a,b\r\n1,2\r\n", b"a\r1\r2", b'a,b\n1,x"y\n"2"z,3', b'"open', b"a,b\n\xff1\xfe,2\xc3\n"]
    cases += ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(1, 40))).encode() for _ in range(700)]
    for data in cases:
        want = csv_text(data)
        for size in {1, 2, 3, rnd.randint(4, 20), 1000}:
            assert "\n".join(lines(tmp_path / "x.csv", data, size)) == want, (data, size)


@pytest.mark.parametrize("uri", [False, True])
def test_one_file_is_read_by_many_tasks(spark, tmp_path, uri):
    rnd = random.Random(2)
    row = lambda i: f'{i},"{"".join(rnd.choice(PARTS[1:2] + PARTS[9:11]) for _ in range(5))}\n""{i}""",{rnd.random()}'
    data = ("id, name ,value\n" + "\n".join(row(i) for i in range(3000))).encode()
    (tmp_path / "big.csv").write_bytes(data)
    (tmp_path / "none.csv").write_bytes(b"")
    path = (tmp_path / "big.csv").as_uri() if uri else str(tmp_path / "big.csv")
    files = spark.createDataFrame([(path, len(data)), (str(tmp_path / "none.csv"), 0)], "path string, size long")
    found = R.csv_lines(files, size=5000).collect()
    parts = {r.part for r in found}
    assert len(parts) > 20 and "\n".join(r.line for r in sorted(found, key=lambda r: (r.part, r.n))) == csv_text(data)
