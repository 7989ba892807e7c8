"""Shared pieces: stage tables in the shared folder, and numpy kernels over whole texts.

Kernels work on the UTF-8 bytes of many documents at once. ``Texts`` cuts an Arrow batch into
slices of bounded bytes so that memory does not grow with the batch; one document is never cut.
"""

from __future__ import annotations

import atexit
import ctypes
import hashlib
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 2_000_000
#: Rows of an Arrow batch, where the session has no setting of its own: whole texts are long rows.
BATCH_ROWS = 1000

_scratch: dict[str, str] = {}
_tables: dict[str, list[str]] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; where it is unset, a temporary one in local mode, and an error elsewhere."""
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="llm-scratch-")
            spark.conf.set("spark.checkpoint.dir", base)
        _scratch[app] = f"{base.rstrip('/')}/llm-{app}"
        atexit.register(release, spark)
    return _scratch[app]


def release(spark: SparkSession) -> None:
    """Delete the stage tables of this application."""
    try:
        app = spark.sparkContext.applicationId
        for name in _tables.pop(app, []):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        root = _scratch.pop(app, None)
        if root:
            path = spark._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the session may be gone at exit
        pass


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a stage table to the shared folder and read it back: lineage ends here, and a lost executor costs one stage."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def owned_table(df: DataFrame, name: str, buckets: int, by: str) -> DataFrame:
    """A stage table that is bucketed: steps that group or join it by ``by`` read it where it lies, without a shuffle."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}"
    _tables.setdefault(spark.sparkContext.applicationId, []).append(name)
    df.write.bucketBy(buckets, by).option("compression", "zstd").option("path", path).saveAsTable(name)
    return spark.table(name)


#: Rows of a part are 2**PART_BITS at most; bytes of input files for a bucket of parts.
PART_BITS, BUCKET_INPUT = 13, 16_000_000


def input_bytes(df: DataFrame) -> int:
    """What the optimizer knows of a table's size, from its files; 0 if it knows nothing."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 62 else 0


def held_rows(docs: DataFrame, name: str, *columns: Column) -> DataFrame:
    """part, row and columns of docs, written as a table bucketed by part: what is told of rows meets them by part, and they are not shuffled."""
    spark = docs.sparkSession
    base = docs.select(F.monotonically_increasing_id().alias("rid"), *columns)
    base = base.select(F.shiftright("rid", PART_BITS).alias("part"), F.col("rid").bitwiseAND((1 << PART_BITS) - 1).cast("int").alias("row"), *base.columns[1:])
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    buckets = min(most, max(int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(docs) // BUCKET_INPUT))
    return owned_table(base, f"{name}_{uuid.uuid4().hex[:12]}", buckets, "part")


def tidy() -> None:
    """Give freed memory back at the end of a partition: Python workers live on, beside each other, in one executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, and bound the batches of texts that Python gets."""
    app = spark.sparkContext.applicationId
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if app not in _shipped:
        _shipped.add(app)
        package = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="llm-code-")) / f"{package.parent.name}_llm.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in [package.parent / "__init__.py", *sorted(package.glob("*.py"))]:
                z.write(f, f.relative_to(package.parent.parent))
        spark.sparkContext.addPyFile(str(path))


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow whose function yields a dict of columns for each slice of a batch."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship(df.sparkSession)
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for cols in fn(batch):
                yield pa.RecordBatch.from_arrays([c if isinstance(c := cols[f.name], pa.Array) and c.type == f.type else pa.array(c, f.type) for f in target], schema=target)
        tidy()

    return df.mapInArrow(run, schema)


class Texts:
    """Adjacent documents of one slice: ``buf`` their bytes, ``off`` n+1 offsets, ``rows`` the row range in the batch."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, rows: tuple[int, int]):
        self.buf, self.off, self.rows = buf, off, rows
        self.n = len(off) - 1

    def text(self, i: int) -> bytes:
        return self.buf[self.off[i] : self.off[i + 1]].tobytes()

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.off, at, side="right") - 1


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Texts]:
    """Slices of a string column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("") if column.null_count or column.type != pa.large_string() else column
    if not len(column):
        return
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, side="right")) - 1)
        yield Texts(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], (lo, hi))
        lo = hi


WORD_BYTE = np.ones(256, bool)
WORD_BYTE[[0x20, *range(0x09, 0x0E)]] = False


def runs(t: Texts, buf: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a slice, and n+1 word offsets of its documents."""
    inside = is_word[buf]
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(t.n + 1, np.int64)
    first = np.zeros(len(buf), bool)
    first[t.off[:-1][t.off[:-1] < len(buf)]] = True
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | first[1:]
    closes[:-1] &= ~inside[1:] | first[1:]
    s, e = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return s, e, np.searchsorted(s, t.off)


class Hash64:
    """Polynomial hashes of byte ranges modulo 2**64 over a table of random values, finished by a bit mixer.

    Long texts can be made that collide for any base, so these hashes may choose what is compared or
    give statistics, but never tell that two texts are equal. ``grams`` is linear in hashes that are
    given, with a random odd factor for each place: as good as they are.
    """

    def __init__(self, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.table = rng.integers(0, 2**64, 256, dtype=np.uint64)
        self.base = int(rng.integers(0, 2**61, dtype=np.uint64)) * 8 + 5
        self.steps = rng.integers(0, 2**63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        ones = np.full(n, self.base, np.uint64)
        ones[0] = 1
        self.up = np.cumprod(ones)
        ones[1:] = pow(self.base, -1, 2**64)
        self.down = np.cumprod(ones)

    def prefix(self, buf: np.ndarray) -> np.ndarray:
        if len(buf) + 1 > len(self.up):
            self._grow(max(len(buf) + 1, 2 * len(self.up)))
        out = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self.table[buf] * self.up[: len(buf)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mix((prefix[e] - prefix[s]) * self.down[s] + (e - s).astype(np.uint64))

    def windows(self, prefix: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the n bytes from each place that has n-1 after it."""
        m = max(0, len(prefix) - n)
        return mix((prefix[n:] - prefix[: len(prefix) - n])[:m] * self.down[:m])

    def grams(self, h: np.ndarray, n: int) -> np.ndarray:
        """Hashes of n consecutive items, starting at each item that has n-1 after it."""
        m = max(0, len(h) - n + 1)
        out = np.zeros(m, np.uint64)
        for k in range(n):
            out += h[k : k + m] * self.steps[k]
        return mix(out)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finisher."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """64-bit hashes of words from a keyed library hash, each worked out once; cleared when it has grown to ``most`` words."""

    def __init__(self, key: str, most: int = 500_000):
        super().__init__()
        self.key, self.most = key.encode(), most

    def __missing__(self, word: bytes) -> int:
        self[word] = h = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=self.key).digest(), "little")
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_word_hashes: dict[str, WordHashes] = {}


def word_hashes(key: str) -> WordHashes:
    if key not in _word_hashes:
        _word_hashes[key] = WordHashes(key)
    return _word_hashes[key]


def split_words(t: Texts, table: bytes | None = None) -> tuple[list[bytes], np.ndarray]:
    """The words between white space (0x20, 0x09-0x0D) of a slice, after a byte-wise translation, and n+1 word offsets of its documents."""
    raw = t.buf.tobytes()
    if table is not None:
        raw = raw.translate(table)
    words: list[bytes] = []
    off = np.zeros(t.n + 1, np.int64)
    ends = t.off.tolist()
    for i in range(t.n):
        words += raw[ends[i] : ends[i + 1]].split()
        off[i + 1] = len(words)
    return words, off


_hashes: dict[int, Hash64] = {}


def hash64(seed: int) -> Hash64:
    if seed not in _hashes:
        _hashes[seed] = Hash64(seed)
    return _hashes[seed]


def within(off: np.ndarray, m: int, n: int) -> np.ndarray:
    """Of m gram starts, those whose n items lie in one document; off: n+1 item offsets."""
    ok = np.ones(m, bool)
    for k in range(1, n):
        at = off[1:-1] - k
        ok[at[(at >= 0) & (at < m)]] = False
    return ok


def covered(n: int, starts: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """A mask over n items: those in [start, start + length) of any start."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, n), -1)
    return np.cumsum(edge[:n]) > 0


def per_doc(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values over the item range of each document."""
    c = np.concatenate([[0], np.cumsum(values)])
    return c[off[1:]] - c[off[:-1]]
