"""Files and folders through Hadoop's FileSystem, so any store that Spark reads will do."""

from __future__ import annotations

import time
import uuid
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


#: Files that are copied at once.
COPIES = 16


class Store:
    """A folder and what is below it."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.root = root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.at(name))

    def at(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_new(self, name: str, text: str) -> bool:
        """Creates a file under its own name, which the store refuses if it is taken (create without overwrite); False then.

        Local folders and HDFS would show the file while it is written, so there a whole file is linked to the name by a rename that doesn't overwrite.
        """
        if self.exists(name):
            return False
        if self._fs.getScheme() not in ("file", "hdfs", "viewfs"):
            try:
                self._write(name, text)
            except Py4JJavaError as failed:
                if "exist" in str(failed.java_exception).lower():
                    return False
                raise
            return True
        part = f"{name}.{uuid.uuid4().hex}.tmp"
        self._write(part, text)
        if self._fs.rename(self._path(part), self._path(name)):
            return True
        self.delete(part)
        return False

    def _write(self, name: str, text: str) -> None:
        stream = self._fs.create(self._path(name), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def size(self, name: str) -> int:
        """Bytes below a folder."""
        return self._fs.getContentSummary(self._path(name)).getLength() if self.exists(name) else 0

    def names(self, name: str) -> list[str]:
        """Entries of a folder."""
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name)))

    def files(self, name: str, older_than_s: float = 0.0) -> list[tuple[str, int]]:
        """Data files below a folder, as names below the root, with their bytes; only those written so long ago."""
        out: list[tuple[str, int]] = []
        if not self.exists(name):
            return out
        found = self._fs.listFiles(self._path(name), True)
        base = self._fs.makeQualified(self._path("")).toString()
        while found.hasNext():
            s = found.next()
            path = s.getPath().toString()
            if path.endswith(".parquet") and time.time() - s.getModificationTime() / 1000 >= older_than_s:
                out.append((path[len(base) + 1 :], s.getLen()))
        return sorted(out)

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def copied_from(self, other: Store, names: list[str]) -> int:
        """Copies files that this store doesn't have, some at a time; how many names there were.  A copy of another length than its source is refused."""
        with ThreadPoolExecutor(COPIES) as pool:
            for name, whole in zip(names, pool.map(lambda n: other.copy_to(n, self), names), strict=True):
                if not whole:
                    raise OSError(f"{name} was not copied whole")
        return len(names)

    def length(self, name: str) -> int:
        return self._fs.getFileStatus(self._path(name)).getLen()

    def copy_to(self, name: str, other: Store) -> bool:
        """A file, unless the other store has it; whether it is whole there."""
        if not other.exists(name):
            part = f"{name}.{uuid.uuid4().hex}.tmp"
            conf = self._fs.getConf()
            self._jvm.org.apache.hadoop.fs.FileUtil.copy(self._fs, self._path(name), other._fs, other._path(part), False, conf)
            if not other._fs.rename(other._path(part), other._path(name)):
                other.delete(part)
        return other.length(name) == self.length(name)
