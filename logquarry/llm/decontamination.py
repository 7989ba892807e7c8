"""Benchmark decontamination: a broadcast hash set of the benchmark's n-grams, scanned over all documents.

Texts are lower-cased (A-Z) and split into runs of letters, digits and non-ASCII bytes. Windows of
the benchmark are hashed into sorted arrays that are broadcast; each document's windows are looked
up, and a hit is verified word by word against the item. What is broadcast is a block of at most
``BLOCK_BYTES`` of items, taken to the driver one at a time. A benchmark of one block needs one scan
and no shuffle. With more, each block has a scan of its own that keeps only what it hits, and is
freed before the next; the hits are then put together by row, so neither the driver nor a worker
ever holds more than one block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, arrow_map, covered, hash64, slices, split_words, stage, within, word_hashes

BLOCK_BYTES = 16_000_000
SEED = 501
#: A-Z to a-z; digits, letters and bytes above 0x7F stay; all others to a space.
ITEM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _words(t: Texts) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    words, off = split_words(t, ITEM_BYTES)
    return words, off, word_hashes("items").of(words)


class Index:
    """Windows of a block of items: all words one after another, and for each window length the sorted hashes, where each window stands, and its item."""

    def __init__(self, items: list[tuple[str | None, str]], n: int):
        self.ids = [k for k, _ in items]
        words, size, found = [], [], {}
        for t in slices(pa.array([x for _, x in items], pa.large_string())):
            own, off, h = _words(t)
            long_, grams = np.diff(off) >= n, hash64(SEED).grams(h, n)
            at = np.flatnonzero(within(off, len(grams), n)) if len(grams) else np.zeros(0, np.int64)
            doc = np.searchsorted(off, at, side="right") - 1
            found.setdefault(n, []).append((grams[at], at + sum(size), doc + t.rows[0]))
            for i in np.flatnonzero(~long_ & (np.diff(off) > 0)):
                k = int(off[i + 1] - off[i])
                found.setdefault(k, []).append((hash64(SEED).grams(h[off[i] : off[i + 1]], k), off[i : i + 1] + sum(size), np.array([i + t.rows[0]])))
            words += own
            size.append(len(own))
        self.text = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        self.starts = np.concatenate([[0], ends]).astype(np.int32)  # word i is text[starts[i] : starts[i + 1] - 1]
        self.by_size = []
        for k, parts in sorted(found.items()):
            h, at, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h)
            if len(h):
                self.by_size.append((k, h[order], at[order].astype(np.int32), doc[order].astype(np.int32)))

    def holders(self, size: int, h: np.ndarray, at: np.ndarray, doc: np.ndarray, gram: np.uint64, words: bytes) -> set[int]:
        """The items that hold a window: those of its hash whose words are the same."""
        lo, hi = np.searchsorted(h, gram), np.searchsorted(h, gram, side="right")
        return {int(d) for a, d in zip(at[lo:hi], doc[lo:hi], strict=True) if self.text[self.starts[a] : self.starts[a + size] - 1] == words}


def _blocks(benchmark: DataFrame, id_col: str, text_col: str):
    """Blocks of items (id as string, text), one after another on the driver; one empty block if there are no items."""
    b = benchmark.select(F.col(id_col).cast("string").alias("k"), F.col(text_col).alias("t")).where("t is not null")
    total = b.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    return n, (([(r.k, r.t) for r in b.where(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == i).collect()]) for i in range(n))


def _scan(docs: DataFrame, index, only_hits: bool) -> DataFrame:
    """row_, n_words, hits, items of rows (row_, text); index: a broadcast Index."""
    kind = docs.schema["row_"].dataType.simpleString()

    def run(batch: pa.RecordBatch):
        for t in slices(batch.column(1)):
            words, off, h = _words(t)
            hit, items = np.zeros(len(words), bool), [set() for _ in range(t.n)]
            for size, keys, at, doc in index.value.by_size:
                g = hash64(SEED).grams(h, size)
                near = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
                starts = np.flatnonzero((keys[near] == g) & within(off, len(g), size)) if len(g) else np.zeros(0, np.int64)
                sure = []
                for i, d in zip(starts.tolist(), (np.searchsorted(off, starts, side="right") - 1).tolist(), strict=True):
                    found = index.value.holders(size, keys, at, doc, g[i], b" ".join(words[i : i + size]))
                    if found:
                        sure.append(i)
                        items[d] |= found
                hit |= covered(len(words), np.array(sure, np.int64), size)
            places = np.flatnonzero(hit)
            owner = np.searchsorted(off, places, side="right") - 1
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(places, off), pa.int32()), pa.array(places - off[owner] if len(places) else places, pa.int32()))
            names = [sorted({k for i in x if (k := index.value.ids[i]) is not None}) for x in items]
            out = {"row_": batch.column(0).slice(t.rows[0], t.n), "n_words": pa.array(np.diff(off)), "hits": lists, "items": pa.array(names, pa.list_(pa.string()))}
            if only_hits:
                keep = pa.array(np.diff(np.searchsorted(places, off)) > 0)
                out = {k: v.filter(keep) for k, v in out.items()}
            yield out

    return arrow_map(docs.select("row_", "text"), run, f"row_ {kind}, n_words long, hits array<int>, items array<string>")


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, row_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """row_ (the column row_col), n_words, hits (positions of hit words), items (ids as strings) of every row.

    A window is n consecutive words of an item, or all of them if it has fewer but not none. A
    document word inside any occurrence of a window is hit. Null texts have no words. An item with a
    null text counts for nothing; one with a null id hits words, but has no id to be listed. Items
    with equal texts are both listed, an empty benchmark hits nothing. Repeated rows and null ids are
    scanned each by itself.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(row_col).alias("row_"), F.col(text_col).alias("text"))
    count, blocks = _blocks(benchmark, item_col, item_text_col)
    if count == 1:
        return _scan(rows, spark.sparkContext.broadcast(Index(next(blocks), n)), False)
    rows = stage(rows.withColumn("rid", F.monotonically_increasing_id()), "rows")
    parts = None
    for block in blocks:
        index = spark.sparkContext.broadcast(Index(block, n))
        part = stage(_scan(rows.select(F.col("rid").alias("row_"), "text"), index, True), "hits")
        index.destroy()
        parts = part if parts is None else parts.unionByName(part)
    hits = F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits")
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    found = stage(parts.groupBy(F.col("row_").alias("rid")).agg(hits, items), "found")
    none = spark.sparkContext.broadcast(Index([], n))
    counted = _scan(rows.select(F.struct("rid", "row_").alias("row_"), "text"), none, False).select("row_.rid", "row_.row_", "n_words")
    joined = counted.join(found, "rid", "left")
    return joined.select("row_", "n_words", F.coalesce("hits", F.array().cast("array<int>")).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """scan() with counts: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = scan(docs, benchmark, row_col=id_col, **how)
    return found.select(
        F.col("row_").alias("doc_id"),
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def clean_text(text: str | None, hits: list[int]) -> str | None:
    """The text without its hit words; what stands between the others stays."""
    if not hits:
        return text
    raw = text.encode()
    word = np.frombuffer(raw.translate(ITEM_BYTES), np.uint8) != 32
    edge = np.diff(np.concatenate([[0], word.astype(np.int8), [0]]))
    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    gone = np.zeros(len(raw) + 1, np.int64)
    np.add.at(gone, s[hits], 1)
    np.add.at(gone, e[hits], -1)
    return np.frombuffer(raw, np.uint8)[np.cumsum(gone[:-1]) == 0].tobytes().decode("utf-8")


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", n: int = 10, text_col: str = "text", **how) -> DataFrame:
    """docs without contaminated documents (remove="documents") or without their hit words (remove="spans").

    All columns of docs stay, whatever their names; with "spans" a text that loses words is rewritten.
    Each row is judged by its own text, whatever its id.
    """
    packed = docs.select(F.struct(*docs.columns).alias("row_"), F.col(text_col).alias("text"))
    names = docs.columns
    found = scan(packed, benchmark, n=n, row_col="row_", **how)
    if remove == "documents":
        return found.where(F.size("hits") == 0).select(*[F.col("row_")[c].alias(c) for c in names])
    cut = F.udf(clean_text, "string")
    return found.select(*[cut(F.col("row_")[c], "hits").alias(c) if c == text_col else F.col("row_")[c].alias(c) for c in names])
