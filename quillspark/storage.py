"""Small files and folders through Spark's own file systems, so that a path may be local or in any store Spark reads."""

from __future__ import annotations

import os
import re
import tempfile

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}  # folders of sessions that name none


def is_uri(path: str) -> bool:
    return re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path) is not None


def joined(*parts: object) -> str:
    return "/".join(str(p).rstrip("/") for p in parts)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only in a session of one process that names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.match(r"local(\[.*\])?$", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if spark.sparkContext.applicationId not in _OWN:
        _OWN[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="quill-shared-")
    return _OWN[spark.sparkContext.applicationId]


class Store:
    """A folder of a Hadoop file system."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, str(folder)
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(joined(self.folder, name) if name else self.folder)

    def read_text(self, name: str) -> str | None:
        path = self._path(name)
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, name: str, text: str) -> None:
        stream = self._fs.create(self._path(name), True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def create_text(self, name: str, text: str, fresh: str) -> bool:
        """Write ``text`` under the unused name ``fresh``, then give it ``name`` in one step; False if that is taken.

        Of many that ask for one name at the same time exactly one gets it: a local file is linked, any other is renamed without
        overwriting, which the store refuses if the name is there.
        """
        self.write_text(fresh, text)
        source, target = (self._fs.makeQualified(self._path(n)) for n in (fresh, name))
        try:
            if target.toUri().getScheme() == "file":
                self._fs.mkdirs(target.getParent())
                os.link(source.toUri().getPath(), target.toUri().getPath())
                return True
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf).rename(
                source, target, self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
            )
            return True
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise
        finally:
            self._fs.delete(self._path(fresh), False)

    def entries(self) -> list[tuple[str, bool, float]]:
        """(name, is a folder, time of change) of what lies within; for folders that hold few."""
        if not self._fs.exists(self._path("")):
            return []
        return [(s.getPath().getName(), s.isDirectory(), s.getModificationTime() / 1000) for s in self._fs.listStatus(self._path(""))]

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
