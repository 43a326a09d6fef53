"""File discovery and parsing.

Folders are listed by the executors, a level of the tree at a time (a built-in file source leaves out empty files and
names that begin with ``_`` or ``.``), and contents are read by path there, so the folder must be visible to them: a
local folder that all share, or a URI of a store that pyarrow reads.  One Arrow batch holds few files, whatever their
size.
"""

from __future__ import annotations

import csv
import hashlib
import io
import os
import re
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FLAT_SUFFIXES, SUFFIXES
from ..functions.text import suffix
from ..storage import is_uri, joined

ENTRIES = "path string, source string, size long, modified long, folder boolean"
BATCH = 64  # files or folders that a task handles at once


def children(path: str) -> list[tuple[str, int, int, bool]]:
    """(name, size, time of change in nanoseconds, is a folder) of what lies in a folder; nothing for a missing one; links to folders are not followed."""
    if not is_uri(path):
        try:
            with os.scandir(path) as found:
                return [(e.name, 0 if d else e.stat().st_size, e.stat().st_mtime_ns, d) for e in found if (d := e.is_dir(follow_symlinks=False)) or e.is_file()]
        except (FileNotFoundError, NotADirectoryError):
            return []
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    found = store.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    return [(e.base_name, e.size or 0, e.mtime_ns or 0, e.type == fs.FileType.Directory) for e in found if e.type in (fs.FileType.File, fs.FileType.Directory)]


def opened(path: str):
    """A binary stream of a file."""
    if not is_uri(path):
        return open(path, "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_stream(inner)


def _below(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for top, prefix in zip(batch["path"], batch["source"]):
            rows = [(joined(top, n), f"{prefix}{n}", size, modified, folder) for n, size, modified, folder in children(top)]
            yield pd.DataFrame(rows, columns=["path", "source", "size", "modified", "folder"])


def listed(spark: SparkSession, folder: str | Path, recursive: bool = True) -> DataFrame:
    """(path, source, size, modified) of all files; source is the path within the folder."""
    level = spark.createDataFrame([(str(folder), "")], "path string, source string")
    out, wide = None, spark.sparkContext.defaultParallelism
    while True:
        # a level holds one short row a file or folder and is listed once
        found = level.mapInPandas(_below, ENTRIES).cache()
        files = found.where("not folder").select("path", "source", "size", "modified")
        out = files if out is None else out.unionByName(files)
        deeper = found.where("folder").select("path", F.concat("source", F.lit("/")).alias("source"))
        if not recursive or deeper.isEmpty():
            return out
        level = deeper.repartition(wide)


def discover(spark: SparkSession, folder: str | Path, recursive: bool = True, suffixes: tuple[str, ...] | None = None) -> DataFrame:
    """Supported files with their suffix, in component-wise order of the path."""
    files = listed(spark, folder, recursive).withColumn("ext", suffix("source"))
    wanted = suffixes or (SUFFIXES if recursive else FLAT_SUFFIXES)
    return files.where(F.col("ext").isin(*wanted)).orderBy(F.split("source", "/"))


def tree(spark: SparkSession, folder: str | Path) -> DataFrame:
    """All files with their depth, indented for display."""
    files = listed(spark, folder).withColumn("depth", F.size(F.split("source", "/")) - 1)
    name = F.element_at(F.split("source", "/"), -1)
    return files.select("source", "depth", F.concat(F.repeat(F.lit("    "), F.col("depth") + 1), name).alias("line")).orderBy(F.split("source", "/"))


def unzip(archive: str | Path, folder: str | Path) -> bool:
    """Extract an archive if there is one; members cannot leave the folder."""
    if not os.path.exists(archive):
        return False
    with zipfile.ZipFile(archive) as z:
        z.extractall(folder)
    return True


def text_of(data: bytes) -> str:
    """UTF-8 with invalid bytes dropped and line ends made \\n."""
    return re.sub(r"\r\n?", "\n", data.decode("utf-8", "ignore"))


def csv_text(data: bytes) -> str:
    """A line of ``header: value`` pairs for each row after the first; pairs end with the shorter of both."""
    rows = list(csv.reader(io.StringIO(data.decode("utf-8", "ignore"), newline="")))
    return "\n".join(", ".join(f"{h.strip()}: {v.strip()}" for h, v in zip(rows[0], row)) for row in rows[1:]) if rows else ""


def pdf_text(data: bytes) -> str:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF files needs the package pypdf") from e
    return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(data: bytes) -> str:
    """Non-blank paragraphs of the body, then the rows of its tables with cells joined by `` | ``."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")

    def text(p) -> str:
        out = []
        for x in p.iter():
            if x.tag == f"{_W}t":
                out.append(x.text or "")
            elif x.tag == f"{_W}tab":
                out.append("\t")
            elif x.tag in (f"{_W}br", f"{_W}cr"):
                out.append("\n")
        return "".join(out)

    parts = [t for p in body.findall(f"{_W}p") if (t := text(p)).strip()]
    for table in body.findall(f"{_W}tbl"):
        for row in table.findall(f"{_W}tr"):
            cells = ["\n".join(map(text, cell.findall(f"{_W}p"))).strip() for cell in row.findall(f"{_W}tc")]
            if any(cells):
                parts.append(" | ".join(cells))
    return "\n".join(parts)


READERS: dict[str, Callable[[bytes], str]] = {
    ".txt": text_of, ".md": text_of, ".markdown": text_of, ".csv": csv_text, ".pdf": pdf_text, ".docx": docx_text,
}


def parse(ext: str, data: bytes) -> str:
    reader = READERS.get(ext.lower())
    if reader is None:
        raise ValueError(f"Unsupported file type: {ext}")
    return reader(data)


def read(files: DataFrame) -> DataFrame:
    """``files`` with text and error; exactly one of them is null.  A file that fails does not stop the others."""
    names = files.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (whole.iloc[at : at + BATCH] for whole in batches for at in range(0, len(whole), BATCH)):
            texts, errors = [], []
            for path, ext in zip(batch["path"], batch["ext"]):
                try:
                    with opened(path) as f:
                        texts.append(parse(ext, f.read()))
                    errors.append(None)
                except Exception as e:  # reported in the result
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield batch[names].assign(text=texts, error=errors)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return files.mapInPandas(run, f"{fields}, text string, error string")


def parse_binary(files: DataFrame) -> DataFrame:
    """The same for a table with ``content`` (as the built-in binary source gives it) and ``ext``."""

    @F.pandas_udf("struct<text: string, error: string>")
    def parsed(ext: pd.Series, content: pd.Series) -> pd.DataFrame:
        out = []
        for e, c in zip(ext, content):
            try:
                out.append((parse(e, bytes(c)), None))
            except Exception as x:  # reported in the result
                out.append((None, f"{type(x).__name__}: {x}"))
        return pd.DataFrame(out, columns=["text", "error"])

    return files.withColumn("p", parsed("ext", "content")).select(*[c for c in files.columns if c != "content"], "p.text", "p.error")


def digest_of(path: Column | str) -> Column:
    """SHA-256 of a file's bytes, read in parts."""

    @F.pandas_udf("string")
    def run(paths: pd.Series) -> pd.Series:
        def of(path: str) -> str:
            h = hashlib.sha256()
            with opened(path) as f:
                while part := f.read(1 << 20):
                    h.update(part)
            return h.hexdigest()

        return paths.map(of)

    return run(path)
