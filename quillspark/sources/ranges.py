"""Large CSV files read by many tasks, each its own range of bytes.

Whether a line feed ends a record depends on all quotes before it.  A range by itself is a function from the reader's state
at its start to that at its end; there are six states, so a range yields six letters, whatever its size.  The functions of a
file's ranges, applied one after the other, give the state at each range's start; with it a task finds the first record that
begins in its range, and reads on behind the range's end until its last record is whole.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import is_uri

RANGE = 16 << 20
AHEAD = 1 << 16  # bytes that are read at once behind a range
# States of the reader: at a record's begin, behind a carriage return, at a field's begin, within a plain field, within a
# quoted one, behind a quote in a quoted one.
BEGIN, RETURN, FIELD, PLAIN, QUOTED, CLOSING = range(6)
_OPEN = {'"': QUOTED, ",": FIELD, "\n": BEGIN, "\r": RETURN, "x": PLAIN}
_NEXT = [
    _OPEN,
    _OPEN,
    _OPEN,
    _OPEN | {'"': PLAIN},
    dict.fromkeys(_OPEN, QUOTED) | {'"': CLOSING},
    _OPEN,
]
_NEXT[CLOSING] = _OPEN | {'"': QUOTED}
_SPECIAL = re.compile(rb'[",\n\r]')
IDENTITY = "012345"


def _kinds(data: bytes) -> Iterator[tuple[str, int]]:
    """Special characters and runs of others (as ``x``), each with the place behind it."""
    at = 0
    for m in _SPECIAL.finditer(data):
        if m.start() > at:
            yield "x", m.start()
        yield chr(data[m.start()]), (at := m.end())
    if at < len(data):
        yield "x", len(data)


def effect(data: bytes) -> str:
    """For each state before the bytes the state behind them."""
    known: dict[tuple[str, str], str] = {}
    out = IDENTITY
    for kind, _ in _kinds(data):
        key = (out, kind)
        if key not in known:
            known[key] = "".join(str(_NEXT[int(s)][kind]) for s in out)
        out = known[key]
    return out


def boundary(data: bytes, state: int) -> tuple[int | None, int]:
    """(place of the first record that begins in the bytes, the state there); None and the state at the end if none does."""
    if state == BEGIN or (state == RETURN and data[:1] not in (b"\n", b"")):
        return 0, BEGIN
    for kind, end in _kinds(data):
        state = _NEXT[state][kind]
        if state == BEGIN:
            return end, BEGIN
        if state == RETURN and data[end : end + 1] != b"\n" and end < len(data):
            return end, BEGIN
    return None, state


class _File:
    def __init__(self, path: str) -> None:
        if is_uri(path):
            from pyarrow import fs

            store, inner = fs.FileSystem.from_uri(path)
            self._file = store.open_input_file(inner)
        else:
            self._file = open(path, "rb")  # noqa: SIM115

    def __enter__(self) -> "_File":
        return self

    def __exit__(self, *_) -> None:
        self._file.close()

    def read(self, start: int, size: int) -> bytes:
        self._file.seek(start)
        return self._file.read(size)

    def tail(self, at: int, state: int) -> bytes:
        """From a place within a record to the record's end."""
        out = b""
        while more := self.read(at, AHEAD):
            end, state = boundary(more, state)
            if end is not None:
                return out + more[:end]
            out, at = out + more, at + len(more)
        return out


def _rows(data: bytes) -> list[list[str]]:
    return list(csv.reader(io.StringIO(data.decode("utf-8", "ignore"), newline="")))


def _range_lines(path: str, start: int, size: int, state: int) -> list[str]:
    """Lines of the records that begin in a range; those of a file's first record are its headers."""
    with _File(path) as f:
        header = _rows(f.tail(0, PLAIN) if f.read(0, 1) not in (b'"', b"\n", b"\r") else f.read(0, 1) + f.tail(1, _NEXT[BEGIN][chr(f.read(0, 1)[0])]))
        data = f.read(start, size)
        first, _ = boundary(data, state)
        if first is None:
            return []
        end = int(effect(data[first:])[BEGIN])
        if end not in (BEGIN, RETURN):
            data += f.tail(start + len(data), end)
        rows = _rows(data[first:])
        names = header[0] if header else []
        return [", ".join(f"{h.strip()}: {v.strip()}" for h, v in zip(names, row)) for row in (rows[1:] if start == 0 else rows)]


def csv_lines(files: DataFrame, size: int = RANGE) -> DataFrame:
    """(path, part, n, line) of all records but the first of the files (path, size): ``header: value`` pairs.

    Ordered by part and n, and joined by line feeds, a file's lines are what ``files.csv_text`` makes of it.  What comes
    together of one file is six letters a range.
    """
    last = F.greatest(F.lit(0), F.ceil(F.col("size") / size).cast("int") - 1)
    ranges = files.select("path", F.explode(F.sequence(F.lit(0), last)).alias("part"))
    wide = files.sparkSession.sparkContext.defaultParallelism

    def effects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, part in zip(batch["path"], batch["part"]):
                with _File(path) as f:
                    out.append((path, part, effect(f.read(part * size, size))))
            yield pd.DataFrame(out, columns=["path", "part", "effect"])

    def states(file: pd.DataFrame) -> pd.DataFrame:
        file, state, out = file.sort_values("part"), BEGIN, []
        for one in file["effect"]:
            out.append(state)
            state = int(one[state])
        return pd.DataFrame({"path": file["path"], "part": file["part"], "state": out})

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, part, state in zip(batch["path"], batch["part"], batch["state"]):
                found = _range_lines(path, part * size, size, state)
                if found:
                    yield pd.DataFrame({"path": path, "part": part, "n": range(len(found)), "line": found})

    dealt = ranges.repartition(wide, "path", "part").mapInPandas(effects, "path string, part int, effect string")
    begun = dealt.groupBy("path").applyInPandas(states, "path string, part int, state int")
    return begun.repartition(wide, "path", "part").mapInPandas(lines, "path string, part int, n int, line string")
