"""Small files and folders in the shared store, by Hadoop's file systems: what the driver moves is what executors wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession | None = None):
        found = spark or SparkSession.getActiveSession()
        if found is None:
            raise RuntimeError("there is no Spark session")
        self.jvm, self.conf = found._jvm, found._jsc.hadoopConfiguration()

    def _at(self, path: str) -> tuple:
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, folder: str) -> list[str]:
        """What a folder holds, sorted; nothing if there is no such folder."""
        fs, p = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def modified(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getFileStatus(p).getModificationTime()

    def make(self, folder: str) -> None:
        fs, p = self._at(folder)
        fs.mkdirs(p)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def read(self, path: str) -> str | None:
        fs, p = self._at(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str | bytes = "") -> bool:
        """A new file; false, and nothing changed, if there is one already, also if another process makes it at once."""
        fs, p = self._at(path)
        try:
            stream = fs.create(p, False)
        except Exception as e:
            if fs.exists(p):
                return False
            raise e
        stream.write(bytearray(text if isinstance(text, bytes) else text.encode()))
        stream.close()
        return True

    def write(self, path: str, text: str) -> None:
        """The file's new content, as a whole or not at all: written aside and moved over the old one."""
        aside = f"{path}.{uuid.uuid4().hex}.tmp"
        self.create(aside, text)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at(path)[0].getUri(), self.conf)
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        over = self.jvm.java.lang.reflect.Array.newInstance(rename.OVERWRITE.getClass(), 1)
        over[0] = rename.OVERWRITE
        context.rename(self._at(aside)[1], self._at(path)[1], over)

    def move(self, source: str, target: str) -> bool:
        """Rename a folder in one step; false if the target is there already, and the source is gone then."""
        fs, p = self._at(source)
        if fs.exists(self._at(target)[1]) or not fs.rename(p, self._at(target)[1]):
            fs.delete(p, True)
            return False
        return True

    def bring(self, local: str, path: str) -> None:
        """Copy a file of the driver's own disk into the store."""
        fs, p = self._at(path)
        fs.copyFromLocalFile(False, True, self.jvm.org.apache.hadoop.fs.Path(f"file://{local}"), p)
