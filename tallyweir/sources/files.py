"""Files and folders of any file system that Spark's Hadoop configuration knows, by the driver."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession) -> None:
        self._jvm = spark._jvm
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()

    def _at(self, path: str):
        at = self._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        at, fs = self._at(path)
        return fs.exists(at)

    def names(self, path: str) -> list[str]:
        """What lies in a folder; nothing if there is none."""
        at, fs = self._at(path)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def drop(self, path: str) -> None:
        at, fs = self._at(path)
        fs.delete(at, True)

    def drop_at_exit(self, path: str) -> None:
        """Removes the folder when the session's JVM ends."""
        at, fs = self._at(path)
        fs.deleteOnExit(at)

    def write(self, path: str, data: bytes) -> None:
        """Writes a file that readers see whole or not at all: it is renamed once it is complete."""
        at, fs = self._at(path)
        part = self._jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}.part")
        out = fs.create(part, True)
        try:
            out.write(data)
        finally:
            out.close()
        if fs.exists(at):
            fs.delete(at, False)
        if not fs.rename(part, at):
            raise OSError(f"could not write {path}")

    def read(self, path: str) -> bytes:
        at, fs = self._at(path)
        stream = fs.open(at)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()
