"""Small files of a folder on any file system that Spark reaches."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    """Names below one folder, through Spark's own file systems."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.root = root.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._gateway = spark.sparkContext._gateway
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        """What is in a folder; nothing if it isn't there."""
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self._path(name))) if self.exists(name) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Makes a file with all of text in one step; False, and nothing happens, if the name is taken."""
        said = self._path(f"staging/{uuid.uuid4().hex}")
        stream = self._fs.create(said, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        to = self._path(name)
        self._fs.mkdirs(to.getParent())
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self._gateway.new_array(kind, 1)
        options[0] = kind.valueOf("NONE")
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            context.rename(self._fs.makeQualified(said), self._fs.makeQualified(to), options)
        except Py4JJavaError as error:
            self._fs.delete(said, False)
            if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
                return False
            raise
        return True

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._path(name), True)
