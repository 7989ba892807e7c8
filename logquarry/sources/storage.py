"""Names, sizes and first bytes of files on any file system that Spark reads, asked for by the driver."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Storage:
    """File systems by the scheme of a path; paths without one are those of the default file system."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def is_folder(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p) and fs.getFileStatus(p).isDirectory()

    def files(self, folder: str) -> list[str]:
        """Names of the files in a folder, sorted; those of folders below are not among them."""
        fs, p = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isFile())

    def matches(self, pattern: str) -> list[str]:
        """A path that exists, or the paths that a pattern fits, sorted."""
        fs, p = self._at(pattern)
        try:
            if fs.exists(p):
                return [pattern]
        except Exception:  # noqa: BLE001 - a pattern may be no path
            pass
        found = fs.globStatus(p)
        names = sorted(s.getPath().toString() for s in found) if found else []
        return [n.removeprefix("file:") for n in names] if "://" not in pattern and not pattern.startswith("file:") else names

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getFileStatus(p).getLen()

    def head(self, path: str, n: int) -> bytes:
        """The first n bytes."""
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readNBytes(n))
        finally:
            stream.close()

    def write(self, path: str, data: bytes) -> None:
        fs, p = self._at(path)
        stream = fs.create(p, True)
        try:
            stream.write(data)
        finally:
            stream.close()
