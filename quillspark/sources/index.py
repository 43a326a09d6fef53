"""The stored index: Parquet parts, a manifest a version, and a log whose entries are created only if absent.

A version adds the records of new and changed sources as one part and writes a manifest, which names for each source the
part that holds its records.  Entry n of the log describes version n whole; readers take the newest.  Two syncs that
overlap ask for the same entry: one gets it, the other reads what was committed since it began.  If that touched other
sources, it writes its manifest upon the new one and asks for the next entry; if not, it fails with ``Conflict`` and has to
begin again.  A sync that fails changes nothing, and a written version is never overwritten.

Records are sorted by id within a part, so that the texts of a few hits are found by the row groups' bounds.  They are
numbered; a part's dead records are bits of bitmaps, a bitmap for 32,768 numbers, which a scan applies by itself: no join with the
manifest is needed.  Bitmaps are bounded by ``BITMAPS``: beyond it, when ``PARTS`` are in use, or when most records are dead,
the next version is written whole.
"""

from __future__ import annotations

import json
import time
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import place
from ..storage import Store, joined

RECORDS = "id string, text string, source string, chunk_index int, embedding array<double>, norm double, seq long"
NAMES = tuple(x.split()[0] for x in RECORDS.split(", "))
NUMBERED = RECORDS + ", row long"
MANIFEST = "source string, digest string, config string, stamp string, part string, n_chunks long"
TOUCHED = "source string"
DEAD = "part string, bucket long, bitmap binary"
GIVEN = ("source", "digest", "config", "stamp")  # columns of a manifest that is to be committed; a stamp may be left out
EXPORTED = "records array<struct<id: string, text: string, source: string, chunk_index: int, embedding: array<double>>>, file_hashes map<string, string>"
ORDER = ("seq", "place", "chunk_index")  # of records: by sync, then by path, then within a source
PARTS = 8
FEW = 64  # ids that are pushed down one by one
BITMAPS = 1024  # of 4 KB each, at most
DEAD_SHARE = 0.5
KEPT = 86_400.0  # seconds for which old versions stay for readers and syncs that still use them


class Conflict(RuntimeError):
    """Another sync has committed some of the same sources."""


def _sorted_by_id(records: DataFrame) -> DataFrame:
    """In ranges of ids, numbered upwards; the numbers of a file's records follow each other."""
    ordered = records.select(*NAMES).repartitionByRange("id").sortWithinPartitions("id")
    return ordered.withColumn("row", F.monotonically_increasing_id())


def _is_dead(bitmaps: dict[int, bytes]) -> Column:
    """Whether the bit of a row's number is set in its bucket's bitmap."""
    known = F.create_map(*[x for bucket, bits in bitmaps.items() for x in (F.lit(bucket).cast("long"), F.lit(bytearray(bits)))])
    bits, at = F.try_element_at(known, F.bitmap_bucket_number("row")), F.bitmap_bit_position("row")
    byte = F.conv(F.hex(F.substring(bits, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), F.pmod(at, F.lit(8)).cast("int"))) > 0, F.lit(False))


class Index:
    def __init__(self, spark: SparkSession, folder: str | Path) -> None:
        self.spark, self.folder = spark, str(folder)
        self._store, self._log = Store(spark, self.folder), Store(spark, joined(self.folder, "log"))

    def _numbers(self) -> list[int]:
        return sorted(int(n) for n, folder, _ in self._log.entries() if not folder and len(n) == 12 and n.isdigit())

    def state(self, number: int | None = None) -> dict:
        """Entry ``number`` of the log, or the newest; before the first sync an empty one."""
        while True:
            at = number if number is not None else max(self._numbers(), default=0)
            text = self._log.read_text(f"{at:012d}") if at else json.dumps({"number": 0, "version": None, "parts": [], "seq": -1, "rows": 0, "dead": 0})
            if text is not None:
                return json.loads(text)
            if number is not None:
                raise Conflict(f"version {number} has expired")

    def version(self) -> str | None:
        return self.state()["version"]

    def number(self) -> int:
        """Of the newest version; a sync that starts from it names it when it commits."""
        return self.state()["number"]

    def next_seq(self) -> int:
        """The number of the next sync: records of a later one come after those of all earlier ones."""
        return self.state()["seq"] + 1

    def _path(self, version: str, name: str) -> str:
        return joined(self.folder, version, name)

    def _table(self, version: str | None, name: str, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema) if version is None else self.spark.read.schema(schema).parquet(self._path(version, name))

    def manifest(self, state: dict | None = None) -> DataFrame:
        return self._table((state or self.state())["version"], "manifest", MANIFEST)

    def _bitmaps(self, state: dict) -> dict[str, dict[int, bytes]]:
        """The bitmaps of each part: ``BITMAPS`` at most."""
        out: dict[str, dict[int, bytes]] = {}
        if state["dead"]:
            for r in self._table(state["version"], "dead", DEAD).collect():
                out.setdefault(r.part, {})[r.bucket] = bytes(r.bitmap)
        return out

    def _parts(self, state: dict) -> list[tuple[str, DataFrame]]:
        """Each part's live records with their numbers."""
        bitmaps, out = self._bitmaps(state), []
        for part in state["parts"]:
            rows = self._table(part, "records", NUMBERED)
            out.append((part, rows.where(~_is_dead(bitmaps[part])) if part in bitmaps else rows))
        return out

    def records(self, state: dict | None = None) -> DataFrame:
        """Live records, with the columns of ``RECORDS`` and ``place``, the text by which paths are ordered."""
        out = self.spark.createDataFrame([], NUMBERED)
        for n, (_, rows) in enumerate(self._parts(state or self.state())):
            out = rows if n == 0 else out.unionByName(rows)
        return out.select(*NAMES, place("source").alias("place"))

    def texts(self, ids: list[str], state: dict | None = None) -> DataFrame:
        """(id, source, text) of live records, of these ids at least; row groups beyond their bounds are not read."""
        wanted = F.col("id").isin(ids) if len(ids) <= FEW else F.col("id").between(min(ids), max(ids))
        return self.records(state).where(wanted).select("id", "source", "text")

    def is_empty(self) -> bool:
        state = self.state()
        return state["rows"] <= state["dead"]

    def commit(self, records: DataFrame, manifest: DataFrame) -> str:
        """Write both tables as a new version that replaces all others, whatever these hold."""
        version = self._new()
        try:
            rows = self._write_part(version, records)
            self._own(version, manifest).write.parquet(self._path(version, "manifest"))
            manifest.select("source").limit(0).write.parquet(self._path(version, "touched"))
            while True:
                state = self.state()
                if self._enter(state, {"version": version, "parts": [version] if rows else [], "rows": rows, "dead": 0, "whole": True}):
                    return version
        except BaseException:
            self._store.delete(version)
            raise

    def append(self, records: DataFrame, fresh: DataFrame, gone: DataFrame, base: int | None = None) -> str:
        """A new version in which the sources of ``fresh`` (source, digest, config) have ``records`` alone, and those of ``gone`` none.

        ``base`` is the version that the sync started from, the newest if none is named.
        """
        base = self.number() if base is None else base
        part = self._new()
        made = [part]
        try:
            rows = self._write_part(part, records)
            self._own(part, fresh).write.parquet(self._path(part, "own"))
            fresh.select("source").unionByName(gone.select("source")).distinct().write.parquet(self._path(part, "touched"))
            touched, own = self._table(part, "touched", TOUCHED), self._table(part, "own", MANIFEST)
            while True:
                state = self.state()
                self._check(base, state, touched)
                version = part if len(made) == 1 else self._new()
                made.append(version)
                entry = self._merged(state, version, part, rows, touched, own, made)
                if self._enter(state, entry | {"touched": part}):
                    for old in {*made} - {part, version, *entry["parts"]}:
                        self._store.delete(old)
                    return version
        except BaseException:
            for name in {*made}:
                self._store.delete(name)
            raise

    def _new(self) -> str:
        return f"v-{uuid.uuid4().hex}"

    def _write_part(self, version: str, records: DataFrame) -> int:
        """Records are written as they are made, once, and from there in order: finding the ranges would make them twice."""
        records.select(*NAMES).write.parquet(self._path(version, "made"))
        made = self._table(version, "made", RECORDS)
        _sorted_by_id(made).write.option("parquet.bloom.filter.enabled#id", "true").parquet(self._path(version, "records"))
        self._store.delete(joined(version, "made"))
        return self._table(version, "records", NUMBERED).count()

    def _own(self, version: str, manifest: DataFrame) -> DataFrame:
        counts = self._table(version, "records", NUMBERED).groupBy("source").agg(F.count("*").alias("n_chunks"))
        given = manifest if "stamp" in manifest.columns else manifest.withColumn("stamp", F.lit(None).cast("string"))
        return given.select(*GIVEN).join(counts, "source", "left").select(*GIVEN, F.lit(version).alias("part"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))

    def _check(self, base: int, state: dict, touched: DataFrame) -> None:
        """No version after ``base`` may have touched the same sources."""
        for number in range(base + 1, state["number"] + 1):
            other = self.state(number)
            if other.get("whole") or not self._table(other["touched"], "touched", TOUCHED).join(touched, "source", "left_semi").isEmpty():
                raise Conflict(f"version {number} has committed some of the same sources")

    def _merged(self, state: dict, version: str, part: str, rows: int, touched: DataFrame, own: DataFrame, made: list[str]) -> dict:
        """Write the manifest and the bitmaps of the version that follows ``state``; returns its entry.  ``made`` gets further folders."""
        old = self.manifest(state).join(touched, "source", "left_anti")
        if len(state["parts"]) < PARTS:
            dying = self.spark.createDataFrame([], "part string, row long")
            for name, live in self._parts(state):
                hit = live.select("source", "row").join(touched, "source", "left_semi")
                dying = dying.unionByName(hit.select(F.lit(name).alias("part"), "row"))
            bits = dying.groupBy("part", F.bitmap_bucket_number("row").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("row")).alias("bitmap"))
            before = self._table(state["version"], "dead", DEAD) if state["dead"] else self.spark.createDataFrame([], DEAD)
            whole = bits.unionByName(before).groupBy("part", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
            whole.write.parquet(self._path(version, "dead"))
            stored = self._table(version, "dead", DEAD)
            n, dead = stored.agg(F.count("*"), F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0))).first()
            total = state["rows"] + rows
            if n <= BITMAPS and dead <= DEAD_SHARE * total:
                old.unionByName(own).write.parquet(self._path(version, "manifest"))
                return {"version": version, "parts": [*state["parts"], *([part] if rows else [])], "rows": total, "dead": dead}
            self._store.delete(joined(version, "dead"))
        # all that lives goes into a part of the version's own, with what the sync brings
        living = self.records(state).join(touched, "source", "left_anti").select(*NAMES).unionByName(self._table(part, "records", NUMBERED).select(*NAMES))
        name = version if version != part else self._new()
        made.append(name)
        n = self._write_part(name, living)
        old.unionByName(own).withColumn("part", F.lit(name)).write.parquet(self._path(version, "manifest"))
        return {"version": version, "parts": [name] if n else [], "rows": n, "dead": 0}

    def _enter(self, state: dict, entry: dict) -> bool:
        number = state["number"] + 1
        text = json.dumps(entry | {"number": number, "seq": state["seq"] + 1})
        return self._log.create_text(f"{number:012d}", text, f".{uuid.uuid4().hex}")

    def clear(self) -> None:
        self.commit(self.spark.createDataFrame([], RECORDS), self.spark.createDataFrame([], MANIFEST))

    def vacuum(self, older_than: float = 0.0) -> int:
        """Delete versions that the newest does not need and that have not changed for so many seconds, and their log entries."""
        state, since = self.state(), time.time() - older_than
        needed = {state["version"], state.get("touched"), *state["parts"]}
        old = [n for n, folder, changed in self._store.entries() if folder and n.startswith("v-") and n not in needed and changed <= since]
        for name in old:
            self._store.delete(name)
        for name, _, changed in self._log.entries():
            if changed <= since and (name.startswith(".") or int(name) < state["number"]):
                self._log.delete(name)
        return len(old)

    def export_json(self, path: str | Path) -> None:
        """One JSON document with records and file hashes, streamed from the executors row by row."""
        with open(path, "w", encoding="utf-8") as out:
            out.write('{"records": [')
            for n, r in enumerate(self.records().orderBy(*ORDER).drop("norm", "seq", "place").toLocalIterator()):
                out.write(("," if n else "") + json.dumps(r.asDict()))
            out.write('], "file_hashes": ')
            out.write(json.dumps({r.source: r.digest for r in self.manifest().toLocalIterator()}) + "}")

    def import_json(self, path: str | Path, config: str = "") -> str:
        """Commit a JSON document; missing keys mean empty, corrupt JSON fails.  Records keep their order and precede all later ones."""
        from ..functions.vectors import norm

        doc = self.spark.read.schema(EXPORTED).option("multiLine", True).option("mode", "FAILFAST").json(str(path))
        seq = (F.col("pos") - F.col("n")).cast("long").alias("seq")
        each = doc.select(F.posexplode("records").alias("pos", "r"), F.size("records").alias("n"))
        records = each.select("r.*", norm(F.col("r.embedding")).alias("norm"), seq)
        listed = doc.select(F.explode("file_hashes").alias("source", "digest")).select("source", "digest")
        # records of a source without a hash are live, too, until a sync finds its file changed or gone
        unlisted = records.select("source").distinct().join(listed, "source", "left_anti").select("source", F.lit(None).cast("string").alias("digest"))
        return self.commit(records, listed.unionByName(unlisted).withColumn("config", F.lit(config)))
