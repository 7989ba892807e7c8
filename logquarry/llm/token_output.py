"""Training-order materialisation of token ids.

Documents are encoded and cut into sequences of fixed length, stored as fixed-stride little-endian
uint16 (uint32 for larger vocabularies), in a table bucketed by chunks of 8192 sequences. Only keys
(a hash of id and text, part) are shuffled to number the sequences: a window numbers them inside
buckets of the hash, whose counts are summed up, so the number of a sequence depends on the documents
and not on how their files were split. A keyed Feistel network with cycle-walking permutes the
numbers, so every sequence gets a global slot without a sort of the payload or shared state. The
slots meet the payload by chunk, and range partitions, whose bounds are known from the count, lie on
borders of shards: each holds whole shards, in order. ``write_shards`` writes a file for each shard,
and a reader finds any slot by its byte offset.
"""

from __future__ import annotations

import json
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import mix, owned_table, ship, slices, stage, tidy

PARTITION_BYTES = 32_000_000
CHUNK_BITS = 13
#: Sequences of a numbering bucket, about.
NUMBERED = 8192


def feistel(index: np.ndarray, n: int, key: int, rounds: int = 4) -> np.ndarray:
    """A keyed permutation of range(n): a balanced Feistel network on the next even number of bits, walked until inside."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) + np.uint64(key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> half, x & mask
        for k in keys:
            a, b = b, a ^ (mix(b + k) & mask)
        return (a << half) | b

    with np.errstate(over="ignore"):
        out = once(index.astype(np.uint64))
        while (far := out >= np.uint64(n)).any():
            out[far] = once(out[far])
    return out.astype(np.int64)


def _check(size: int, width: int) -> None:
    if size > 1 << 8 * width:
        raise ValueError(f"ids up to {size - 1} do not fit in {width} bytes")


def sequences(docs: DataFrame, tokenizer: str, length: int, end: int, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """chunk, ordinal (where a sequence was made), doc_id, h (hash of id and text), part, n_tokens, tokens: a document's ids and an end token, cut and padded with it."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    dtype = {2: "<u2", 4: "<u4"}[width]
    _check(end + 1, width)

    def run(batches):
        enc, pid, made = encoder(tokenizer), TaskContext.get().partitionId(), 0
        _check(enc.size, width)
        for batch in batches:
            for t in slices(batch.column(1)):
                rows = slice(*t.rows)
                ids = enc.ids([x or "" for x in batch.column(1).slice(rows.start, t.n).to_pylist()])
                size = np.array([len(x) for x in ids], np.int64) + 1
                parts = -(-size // length)
                first = np.concatenate([[0], np.cumsum(parts)])
                flat = np.full(first[-1] * length, end, dtype)
                doc = np.repeat(np.arange(t.n), size - 1)
                off = np.cumsum(size - 1) - (size - 1)
                flat[np.arange(len(doc)) - off[doc] + first[doc] * length] = np.concatenate(ids)
                own = np.repeat(np.arange(t.n), parts)
                part = np.arange(first[-1]) - first[own]
                payload = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer((np.arange(len(own) + 1, dtype=np.int32) * length * width).tobytes()), pa.py_buffer(flat.tobytes())])
                at = made + np.arange(len(own))
                take = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((pid << 32) + (at >> CHUNK_BITS)), pa.array(at & ((1 << CHUNK_BITS) - 1), pa.int32()), batch.column(0).slice(rows.start, t.n).take(take), batch.column(2).slice(rows.start, t.n).take(take), pa.array(part, pa.int32()), pa.array(np.minimum(length, size[own] - part * length), pa.int32()), payload],
                    names=["chunk", "ordinal", "doc_id", "h", "part", "n_tokens", "tokens"],
                )
                made += len(own)
        tidy()

    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"))
    return base.mapInArrow(run, f"chunk long, ordinal int, doc_id {kind}, h long, part int, n_tokens int, tokens binary")


def numbered(table: DataFrame, n: int) -> DataFrame:
    """chunk_, ordinal_, index: the sequences numbered from 0 in the order of (bucket of h, h, doc_id, part)."""
    bits = max(0, (n // NUMBERED).bit_length())
    keys = table.select("chunk", "ordinal", "h", "doc_id", "part").withColumn("b", F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long"))
    order = Window.partitionBy("b").orderBy("h", "doc_id", "part", "chunk", "ordinal")
    inside = keys.select("chunk", "ordinal", "b", (F.row_number().over(order) - 1).alias("i"))
    counts = keys.groupBy("b").agg(F.count(F.lit(1)).alias("c"))
    before = stage(counts.select(F.col("b").alias("b_"), (F.sum("c").over(Window.orderBy("b")) - F.col("c")).alias("before")), "before")  # a row for 8192 sequences
    return inside.join(before, F.col("b") == F.col("b_")).select(F.col("chunk").alias("chunk_"), F.col("ordinal").alias("ordinal_"), (F.col("before") + F.col("i")).alias("index"))


def training_order(docs: DataFrame, tokenizer: str, length: int = 512, end: int = 50256, key: int = 1, shard_rows: int = 8192, width: int = 2, **cols) -> DataFrame:
    """One row per sequence, in range partitions of whole shards sorted by slot: slot, shard, row, doc_id, part, n_tokens, tokens.

    slot: the global place, 0 to n-1, each once; shard and row: slot divided by shard_rows; tokens:
    ``length`` ids of ``width`` bytes. A document of k tokens has k + 1 with its end token, so a null
    or empty text gives one sequence with n_tokens 1. Repeated rows are repeated sequences; a null id
    is carried. An empty table gives no rows. The order depends on the documents and the key alone,
    not on files, splits or the number of executors. Ids that do not fit in ``width`` bytes are an error.
    """
    spark = docs.sparkSession
    made = sequences(docs, tokenizer, length, end, width, **cols)
    table = owned_table(made, f"tokens_{uuid.uuid4().hex[:12]}", int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk")
    n = table.count()

    @F.pandas_udf("long")
    def permuted(index):
        import pandas as pd

        return pd.Series(feistel(index.to_numpy().astype(np.int64), n, key))

    slots = numbered(table, n).select("chunk_", "ordinal_", permuted("index").alias("slot"))
    kind = table.schema["doc_id"].dataType.simpleString()

    def place(rows: pa.Table, places: pa.Table) -> pa.Table:
        slot = np.empty(rows.num_rows, np.int64)
        slot[np.argsort(rows.column("ordinal").to_numpy())] = places.column("slot").to_numpy()[np.argsort(places.column("ordinal_").to_numpy())]
        own = [rows.column(c) for c in ("doc_id", "part", "n_tokens", "tokens")]
        return pa.table([pa.array(slot), pa.array(slot // shard_rows), pa.array(slot % shard_rows), *own], names=["slot", "shard", "row", "doc_id", "part", "n_tokens", "tokens"])

    placed = table.groupBy("chunk").cogroup(slots.groupBy("chunk_")).applyInArrow(place, f"slot long, shard long, row long, doc_id {kind}, part int, n_tokens int, tokens binary")
    shards = max(1, -(-n // shard_rows))
    count = min(shards, max(1, -(-n * length * width // PARTITION_BYTES)))
    return placed.repartitionById(count, F.expr(f"cast(shard * {count} div {shards} as int)")).sortWithinPartitions("slot")


def _files(path: str):
    """A file system and a path in it; a plain path is a local one."""
    from pyarrow import fs

    if re.match(r"[a-z0-9]+:/", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def shard_file(path: str, shard: int) -> str:
    return f"{path}/shard-{shard:08d}.bin"


def write_shards(order: DataFrame, path: str) -> int:
    """Writes training_order() as a file for each shard in a shared folder: rows of equal stride, in the order of their slots. Returns the number of slots.

    A file appears under its name when it is whole, so a task that is run again after a lost executor
    replaces what it has written. ``layout.json`` tells stride, rows of a shard and slots.
    """
    def write(batches):
        files, root = _files(path)
        out, shard, rows, stride = None, None, 0, 0

        def done():
            out.close()
            files.move(temporary, shard_file(root, shard))
            return pa.RecordBatch.from_pydict({"shard": [shard], "rows": [rows], "stride": [stride]})

        for batch in batches:
            for s, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s != shard:
                    if out is not None:
                        yield done()
                    shard, rows, stride = s, 0, len(tokens)
                    temporary = f"{root}/.{shard}-{uuid.uuid4().hex}"
                    out = files.open_output_stream(temporary)
                out.write(tokens)
                rows += 1
        if out is not None:
            yield done()

    files, root = _files(path)
    files.create_dir(root, recursive=True)
    ship(order.sparkSession)
    written = order.select("shard", "tokens").mapInArrow(write, "shard long, rows long, stride long")
    total = written.agg(F.sum("rows").alias("n"), F.max("rows").alias("shard_rows"), F.max("stride").alias("stride")).first()
    layout = {"slots": total.n or 0, "shard_rows": total.shard_rows or 0, "stride": total.stride or 0}
    with files.open_output_stream(f"{root}/layout.json") as f:
        f.write(json.dumps(layout).encode())
    return layout["slots"]


def read_shards(path: str, slot: int = 0, width: int = 2):
    """The token ids of each sequence from a slot on, read sequentially: the first read begins at the slot's byte offset."""
    files, root = _files(path)
    with files.open_input_stream(f"{root}/layout.json") as f:
        layout = json.loads(f.read())
    while slot < layout["slots"]:
        shard, row = divmod(slot, layout["shard_rows"])
        with files.open_input_file(shard_file(root, shard)) as f:
            f.seek(row * layout["stride"])
            while tokens := f.read(layout["stride"]):
                yield np.frombuffer(tokens, f"<u{width}")
                slot += 1


def resume(path: str, spark, slot: int) -> DataFrame:
    """The rest of an order that was written as Parquet, from a slot on; files that end before it are not read."""
    return spark.read.parquet(path).where(F.col("slot") >= slot).sortWithinPartitions("slot")
