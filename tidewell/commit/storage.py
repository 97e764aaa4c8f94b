"""A folder of committed state on any file system Hadoop knows.

Every entry is a small JSON file that appears by a rename that fails if the
name exists, so of two writers of one version one loses and retries.  The
rename is atomic on HDFS; a local file system checks and renames in two steps,
so there only one writer is safe."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.sql import SparkSession


class Folder:
    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.path = path.rstrip("/")
        # one of its own: the cached one is shared with every writer of the JVM
        self._fs = self._jvm.org.apache.hadoop.fs.FileSystem.newInstance(self._p("").toUri(), self._conf)
        self._fs.setWriteChecksum(False)

    def _p(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._p(name))

    def names(self, sub: str = "") -> list[str]:
        if not self.exists(sub):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._p(sub)))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._p(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def read_json(self, name: str):
        return json.loads(self.read(name))

    def write(self, name: str, text: str, overwrite: bool = False) -> bool:
        """True if the entry is now there with this text by us."""
        temporary = f"_tmp/{uuid.uuid4().hex}"
        self._fs.mkdirs(self._p("_tmp"))
        stream = self._fs.create(self._p(temporary), True)
        try:
            stream.write(bytearray(text.encode()))
            stream.hsync()
        finally:
            stream.close()
        target = self._p(name)
        self._fs.mkdirs(target.getParent())
        kinds = self._jvm.org.apache.hadoop.fs.Options.Rename
        # overwriting, a reader sees the old text or the new one; else an existing name refuses
        array = SparkContext._gateway.new_array(kinds, 1)
        array[0] = kinds.OVERWRITE if overwrite else kinds.NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            context.rename(self._p(temporary), target, array)
            return True
        except Py4JJavaError as e:
            self._fs.delete(self._p(temporary), False)
            if overwrite or not self._fs.exists(target):
                raise OSError(f"{name} cannot be written") from e
            return False

    def rename(self, source: str, target: str) -> bool:
        self._fs.mkdirs(self._p(target).getParent())
        return self._fs.rename(self._p(source), self._p(target))

    def make(self, name: str) -> None:
        self._fs.mkdirs(self._p(name))

    def delete(self, name: str) -> None:
        self._fs.delete(self._p(name), True)

    def full(self, name: str) -> str:
        return f"{self.path}/{name}"
