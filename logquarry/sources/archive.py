"""Lines of archives, which Spark has no reader for: a Python map over whole files, one task for each.

Formats: .tar (also .gz .tgz .zst .zstd .tzst), .zip, .7z if py7zr is installed, and .zstd. Members that
are folders, empty, or named upwards are left out; a member may itself be compressed. Plain .gz and .zst
files are read by Spark. An archive is a value of Spark's binary files, so it may have 2 GB at most.
"""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ARCHIVES = (".tar", ".tar.gz", ".tgz", ".tar.zst", ".tar.zstd", ".tzst", ".zip", ".7z")
ROWS = 20_000


def is_archive(name: str) -> bool:
    return name.lower().endswith((".zstd", *ARCHIVES))


def unpacked_name(name: str) -> str:
    """A name without its compression ending."""
    low = name.lower()
    return next((name[: -len(e)] for e in (".gz", ".zstd", ".zst") if low.endswith(e)), name)


def _inflate(stream, name: str):
    if name.lower().endswith((".gz", ".tgz")):
        return gzip.GzipFile(fileobj=stream)
    if name.lower().endswith((".zst", ".zstd", ".tzst")):
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(stream, read_across_frames=True)
    return stream


def inflated(head: bytes, name: str, n: int) -> bytes:
    """The first n bytes of what the start of a compressed file holds, as far as it goes."""
    stream, out = _inflate(io.BytesIO(head), name), b""
    try:
        while len(out) < n and (part := stream.read(min(4096, n - len(out)))):
            out += part
    except (EOFError, OSError):  # the start of a file ends within a block
        pass
    return out


def _wanted(name: str) -> bool:
    return not name.endswith("/") and ".." not in name.split("/")


def members(path: str, data) -> Iterator[tuple[str, io.BufferedIOBase]]:
    """(name, stream of content) of the members of an archive; data: its bytes."""
    low, raw = path.lower(), io.BytesIO(data)
    if low.endswith(".zip"):
        with zipfile.ZipFile(raw) as z:
            for info in z.infolist():
                if _wanted(info.filename) and info.file_size:
                    with z.open(info) as f:
                        yield unpacked_name(info.filename), _inflate(f, info.filename)
    elif low.endswith(".7z"):
        try:
            import py7zr
        except ImportError as e:
            raise RuntimeError("reading .7z needs the py7zr package") from e
        with py7zr.SevenZipFile(raw) as z:
            for name, content in z.readall().items():
                if _wanted(name):
                    yield unpacked_name(name), _inflate(content, name)
    elif low.endswith(ARCHIVES):
        with tarfile.open(fileobj=_inflate(raw, path), mode="r|") as t:
            for info in t:
                if info.isfile() and info.size and _wanted(info.name):
                    yield unpacked_name(info.name), _inflate(t.extractfile(info), info.name)
    else:
        yield unpacked_name(path.rsplit("/", 1)[-1]), _inflate(raw, path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    if path.lower().endswith(".7z"):
        try:
            import py7zr  # noqa: F401
        except ImportError as e:
            raise RuntimeError("reading .7z needs the py7zr package") from e
    return spark.read.format("binaryFile").load(path).select("path", "content")


def heads(spark: SparkSession, path: str, n: int) -> list[tuple[str, bytes]]:
    """The start of each member, for format detection."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for member, stream in members(name, content.as_buffer()):
                    yield pa.RecordBatch.from_pydict({"member": [member], "head": [stream.read(n)]})

    return [(r.member, bytes(r.head)) for r in _files(spark, path).mapInArrow(run, "member string, head binary").collect()]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """member, line_no, line of all members."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for member, stream in members(name, content.as_buffer()):
                    buffered = stream if isinstance(stream, io.BufferedIOBase) else io.BufferedReader(stream)
                    held, at = [], 0
                    for raw in iter(buffered.readline, b""):
                        held.append(raw.decode("utf-8", "replace").rstrip("\r\n"))
                        if len(held) == ROWS:
                            yield pa.RecordBatch.from_pydict({"member": [member] * ROWS, "line_no": range(at, at + ROWS), "line": held})
                            held, at = [], at + ROWS
                    if held:
                        yield pa.RecordBatch.from_pydict({"member": [member] * len(held), "line_no": range(at, at + len(held)), "line": held})

    return _files(spark, path).mapInArrow(run, "member string, line_no long, line string")
