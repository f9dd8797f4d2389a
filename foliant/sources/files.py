"""Small files in any store that Hadoop's clients reach, and numbers that only ever rise there."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Folder:
    """A folder of small files; a file appears whole or not at all, and none is ever written over."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self._jvm = path.rstrip("/"), spark._jvm
        self._hadoop = spark._jvm.org.apache.hadoop
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        if not self._fs.exists(self._at("")):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at("")))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_new(self, name: str, text: str = "") -> bool:
        """Write under a name of its own, then rename; False if another writer has taken the name."""
        draft = self._at(f".{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(text, "utf-8"))
        finally:
            stream.close()
        kind = self._hadoop.fs.Options.Rename
        options = self._jvm.java.lang.reflect.Array.newInstance(kind.NONE.getClass(), 1)
        options[0] = kind.NONE
        try:
            self._hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf).rename(draft, self._at(name), options)
            return True
        except Exception as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(e):
                return False
            raise

    def move(self, name: str, to: str) -> None:
        if not self._fs.rename(self._at(name), self._at(to)):
            raise OSError(f"{self.path}/{name} can't become {to}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


class DataVersion:
    """The version of stored data: a number that every ingest, delete or flush raises, for all drivers that read the folder.

    Each version is a file; the highest name counts. Two writers that raise it at once get two numbers.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.folder = Folder(spark, path)

    def _all(self) -> list[int]:
        return [int(n[1:]) for n in self.folder.names() if n[0] == "v" and n[1:].isdigit()]

    def current(self) -> int:
        return max(self._all(), default=1)

    def bump(self) -> int:
        n = self.current() + 1
        while not self.folder.put_new(f"v{n:012d}"):
            n += 1
        for old in self._all():
            if old < n - 1:  # the highest ones stay
                self.folder.delete(f"v{old:012d}")
        return n
