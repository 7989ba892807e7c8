"""Finding repeated passages of a fixed length across a corpus, exactly.

A window is ``length`` consecutive items (bytes or words) of a text. Every window has an anchor: its
leftmost k-gram of least hash. Equal windows have equal anchors at the same place, so

1. the texts are written once as a table of parts (8192 rows each), bucketed by part: every later
   step meets its texts without a shuffle of them;
2. each part sends the hashes of its anchors, each once; a hash that occurs once settles its windows;
3. the windows of each anchor that is left form a run; the text a run spans is its context. Contexts
   of a part that are equal (compared as values) are one row, and all but the first of them are
   settled; the rows meet by anchor hash in blocks, each an index of all contexts in which its
   windows can occur;
4. a block merges equal contexts again, compares different ones of one anchor by an exact method of
   the operator, and answers with windows;
5. the windows meet the texts by part.

Hashes only choose who is compared; whether texts are equal is always told from their bytes. Nothing
is paired: work in a block is by sorting. All shuffles are of plain rows, so what is sent for a
megabyte of text does not depend on the number of partitions, and of a passage that occurs in many
documents a part sends each context once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTE, Texts, hash64, held_rows, input_bytes, runs, ship, slices, tidy

SEED = 201
#: Anchor hashes are sent without their lowest bits: a chance collision only makes a context be compared for nothing.
KEEP = np.uint64(16)
#: Bytes of input files for a block of contexts.
BLOCK_INPUT = 8_000_000
#: Anchor hashes that a task holds before it sends them, and bytes of contexts that are compared at once.
HELD, COMPARED = 4_000_000, 2_000_000
#: Bits of a place in a slice, beside which 40 bits of a hash choose the anchor.
PLACE = 24


@dataclass(frozen=True)
class Spec:
    """What an item is and how long a window is; k: items of an anchor."""

    kind: str
    length: int
    k: int


@dataclass
class Run:
    """The runs of a slice: anchor hash, document, first window, number of windows, byte range of the context."""

    key: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    n: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    buf: np.ndarray


def _leftmost_least(g: np.ndarray, w: int) -> np.ndarray:
    """For each start of w values, the place of the least by its first 40 bits, the leftmost of equals."""
    m = len(g) - w + 1
    if len(g) < 1 << PLACE:  # value and place in one number
        low = np.uint64((1 << PLACE) - 1)
        v, span = (g & ~low) | np.arange(len(g), dtype=np.uint64), 1
        while span * 2 <= w:
            v, span = np.minimum(v[:-span], v[span:]), span * 2
        return (np.minimum(v[:m], v[w - span : w - span + m]) & low).astype(np.int64)
    g = g >> np.uint64(PLACE)
    at, span = np.arange(len(g)), 1
    while span * 2 <= w:
        a, b = at[:-span], at[span:]
        at, span = np.where(g[a] <= g[b], a, b), span * 2
    a, b = at[:m], at[w - span : w - span + m]
    return np.where(g[a] <= g[b], a, b)


def _words(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of a slice with one space after each: buffer, starts, ends, and n+1 word offsets of the documents."""
    s0, e0, off = runs(t, t.buf, WORD_BYTE)
    size = e0 - s0 + 1
    s = np.cumsum(size) - size
    e = s + size - 1
    buf = np.full(int(size.sum()), 32, np.uint8)
    fill = np.ones(len(buf), bool)
    fill[e] = False
    buf[fill] = t.buf[WORD_BYTE[t.buf]]
    return buf, s, e, off


def find_runs(t: Texts, spec: Spec) -> Run:
    """All runs of a slice. For words, the buffer is rewritten with one space between words."""
    h = hash64(SEED)
    if spec.kind == "bytes":
        buf, off = t.buf, t.off
        grams = h.windows(h.prefix(buf), spec.k)
    else:
        buf, s, e, off = _words(t)
        grams = h.grams(h.ranges(h.prefix(buf), s, e), spec.k) if len(s) else np.zeros(0, np.uint64)
    w = spec.length - spec.k + 1
    m = len(grams) - w + 1
    none = np.zeros(0, np.int64)
    if m <= 0:
        return Run(np.zeros(0, np.uint64), none, none, none, none, none, buf)
    anchor = _leftmost_least(grams, w)
    valid = np.ones(m, bool)
    for d in off[1:-1]:
        valid[max(0, d - spec.length + 1) : d] = False
    change = anchor[1:] != anchor[:-1]
    new, end = valid.copy(), valid.copy()
    new[1:] &= change | ~valid[:-1]
    end[:-1] &= change | ~valid[1:]
    first, last = np.flatnonzero(new), np.flatnonzero(end)
    doc = np.searchsorted(off, first, side="right") - 1
    stop = last + spec.length - 1
    lo, hi = (first, stop + 1) if spec.kind == "bytes" else (s[first], e[stop])
    return Run(grams[anchor[first]] >> KEEP, doc, first - off[doc], last - first + 1, lo, hi, buf)


def _parts_of(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Array]]:
    """(part, texts) of a batch of (part, text); rows of one part are adjacent."""
    part = np.asarray(batch.column(0))
    cut = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
    for lo, hi in zip(cut, cut[1:]):
        if hi > lo:
            yield int(part[lo]), batch.column(1).slice(lo, hi - lo)


def _anchors(spec: Spec):
    """(key, part, many): the anchor hashes of each part, and whether the part has one twice."""

    def sent(part: int, held: list[np.ndarray]) -> pa.RecordBatch:
        key, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(key), part, np.int64)), pa.array(n > 1)], names=["key", "part", "many"])

    def run(batches):
        held, now, size = [], None, 0
        for batch in batches:
            for part, texts in _parts_of(batch):
                if held and (part != now or size > HELD):
                    yield sent(now, held)
                    held, size = [], 0
                now = part
                for t in slices(texts):
                    held.append(find_runs(t, spec).key)
                    size += len(held[-1])
        if held:
            yield sent(now, held)
        tidy()

    return run


def _repeated(batches):
    """(part, key) of the keys that occur in two rows, or twice in a part; all rows of a key are in the partition."""
    columns = [[np.asarray(b.column(i)) if i < 2 else b.column(i).to_numpy(zero_copy_only=False) for i in range(3)] for b in batches if b.num_rows]
    if columns:
        key, part, many = (np.concatenate(c) for c in zip(*columns, strict=True))
        del columns
        order = np.argsort(key)
        key, part, many = key[order], part[order], many[order].astype(bool)
        again = key[1:] == key[:-1]
        many[1:] |= again
        many[:-1] |= again
        part, key = part[many], key[many]
        for lo in range(0, len(key), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(part[lo : lo + 100_000]), pa.array(key[lo : lo + 100_000])], names=["part", "key"])
    tidy()


def ranks(ids: pa.Array) -> np.ndarray:
    """Dense ranks of ids of any type, null the smallest."""
    return pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)


def _chunk(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _binary(data: bytes, off: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(data)])


def joined(row: np.ndarray, first: np.ndarray, n: np.ndarray, touch: int = 0) -> np.ndarray:
    """(row, first, n) with runs of one row merged that follow each other; those that overlap by less than ``touch`` windows apart, too."""
    if not len(row):
        return np.zeros((0, 3), np.int64)
    key = (row.astype(np.int64) << 40) + first
    order = np.argsort(key, kind="stable")
    start = key[order]
    stop = np.maximum.accumulate(start + n[order] + touch)
    new = np.concatenate([[True], start[1:] > stop[:-1]])
    last = np.append(np.flatnonzero(new)[1:], len(start)) - 1
    s = start[new]
    return np.column_stack([s >> 40, s & ((1 << 40) - 1), stop[last] - touch - s])


def mask_runs(hit: np.ndarray, which: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first window, windows) of the runs of a mask over the windows of all contexts."""
    at = np.flatnonzero(hit)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (which[at[1:]] != which[at[:-1]])
    start = np.flatnonzero(new)
    return which[at[start]], inner[at[start]], np.diff(np.append(start, len(at)))


def settle(code: np.ndarray, position: np.ndarray, keep: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of equal contexts are settled as copies, and the first of each code by position; ``order``: all by (code, position).

    keep: "smallest" (those at the smallest position stay open), "first" (one of them stays open) or "none" (a context that has an equal one goes).
    """
    order = np.lexsort((position, code))
    head = np.concatenate([np.ones(min(1, len(order)), bool), np.diff(code[order]) != 0])
    lead = order[head]
    if keep == "smallest":
        return position > position[lead][code], lead, order
    if keep == "first":
        gone = np.ones(len(code), bool)
        gone[lead] = False
        return gone, lead, order
    return np.bincount(code)[code] > 1 if len(code) else np.zeros(0, bool), lead, order


def _contexts(spec: Spec, keep: str, names: list[str], id_type: pa.DataType):
    """The different contexts of a part's repeated anchors, and one row (text null) with the windows that the part settles by itself."""

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        part = docs.column("part")[0].as_py()
        keys = np.unique(_chunk(found.column("key")).to_numpy()) if found.num_rows else np.zeros(0, np.int64)
        ids, row, texts = _chunk(docs.column("doc_id")), np.asarray(_chunk(docs.column("row"))).astype(np.int64), _chunk(docs.column("text"))
        seen: dict[bytes, int] = {}
        cols: list[tuple] = []
        for t in slices(texts) if len(keys) else ():
            r = find_runs(t, spec)
            key = r.key.view(np.int64)
            p = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key)
            raw, add = r.buf.tobytes(), seen.setdefault
            code = [add(raw[a:b], len(seen)) for a, b in zip(r.lo[p].tolist(), r.hi[p].tolist(), strict=True)]
            cols.append((np.array(code, np.int64), key[p], r.doc[p] + t.rows[0], r.first[p], r.n[p]))
        code, key, doc, first, n = (np.concatenate(c) for c in zip(*cols, strict=True)) if cols else [np.zeros(0, np.int64)] * 5
        place = np.empty(len(code), np.int64)
        if keep == "smallest":
            place = ranks(ids)[doc]
        elif len(code):
            place[np.lexsort((first, row[doc], ranks(ids)[doc]))] = np.arange(len(code))
        sure, lead, order = settle(code, place, keep)
        own = order[~sure[order]]
        who = np.column_stack([row[doc[own]], first[own]]).astype(np.int32)
        off = np.searchsorted(code[own], np.arange(len(lead) + 1)) * 8
        texts = list(seen)  # by code
        size = np.cumsum([0, *map(len, texts)])
        told = joined(row[doc[sure]], first[sure], n[sure]).astype(np.int32)
        null = lambda value, kind: pa.concat_arrays([value.cast(kind), pa.nulls(1, kind)])
        columns = [
            pa.array(np.append(key[lead], part)), pa.array(np.full(len(lead) + 1, part, np.int64)), null(pa.array(n[lead].astype(np.int32)), pa.int32()),
            null(pa.array(row[doc[lead]].astype(np.int32)), pa.int32()), null(pa.array(first[lead].astype(np.int32)), pa.int32()), null(ids.take(pa.array(doc[lead])), id_type),
            null(_binary(b"".join(texts), size), pa.binary()), _binary(who.tobytes() + told.tobytes(), np.append(off, off[-1] + told.nbytes)).cast(pa.binary()),
        ]
        return pa.table(columns, names=names)

    return run


@dataclass
class Block:
    """An indexed reference block: different contexts one after another, each with its anchor, its number of windows and the rank of its first occurrence."""

    key: np.ndarray
    n: np.ndarray
    size: np.ndarray
    place: np.ndarray
    texts: list[bytes]


def _block(compare: Callable[[Block, Spec], tuple[np.ndarray, np.ndarray, np.ndarray]], spec: Spec, keep: str):
    """Windows that go, (part, row, first, n), of the contexts of a partition; all contexts of an anchor are in it."""

    def answer(part, row, first, n) -> pa.RecordBatch:
        kinds = (("part", part, np.int64), ("row", row, np.int32), ("first", first, np.int32), ("n", n, np.int32))
        return pa.RecordBatch.from_arrays([pa.array(x.astype(k)) for _, x, k in kinds], names=[name for name, _, _ in kinds])

    def solve(table: pa.Table) -> pa.RecordBatch:
        key, part, n, row, first = (np.asarray(_chunk(table.column(i))).astype(np.int64) for i in range(5))
        texts, who = table.column(6).to_pylist(), table.column(7).to_pylist()
        seen: dict[bytes, int] = {}
        code = np.array([seen.setdefault(x, len(seen)) for x in texts], np.int64)
        place = ranks(_chunk(table.column(5)))
        if keep != "smallest":
            order = np.lexsort((first, row, part, place))
            place[order] = np.arange(len(order))
        gone, lead, order = settle(code, place, keep)
        # an anchor with several contexts: the first of each is compared
        _, of = np.unique(key[lead], return_inverse=True)
        several = lead[np.bincount(of)[of] > 1] if len(lead) else lead
        several = several[np.argsort(place[several], kind="stable")]
        open_ = np.flatnonzero(gone)
        entry, start, count = [open_], [np.zeros(len(open_), np.int64)], [n[open_]]
        if len(several):
            c, s, k = compare(Block(key[several], n[several], np.array([len(texts[i]) for i in several]), place[several], [texts[i] for i in several]), spec)
            rest = order[~gone[order]]  # every open context gets the answer of its first
            lo, hi = np.searchsorted(code[rest], code[several[c]]), np.searchsorted(code[rest], code[several[c]], side="right")
            many = hi - lo
            entry.append(rest[np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())])
            start.append(np.repeat(s, many))
            count.append(np.repeat(k, many))
        entry, start, count = np.concatenate(entry), np.concatenate(start), np.concatenate(count)
        pairs = [np.frombuffer(who[i], np.int32).reshape(-1, 2) for i in entry]
        many = np.array([len(x) for x in pairs], np.int64)
        places = np.concatenate([np.zeros((0, 2), np.int32), *pairs])
        return answer(np.repeat(part[entry], many), places[:, 0], places[:, 1] + np.repeat(start, many), np.repeat(count, many))

    def run(batches):
        held = []
        for b in batches:
            told = b.column(6).is_null()
            for part, windows in zip(b.column(1).filter(told).to_pylist(), b.column(7).filter(told).to_pylist(), strict=True):
                x = np.frombuffer(windows, np.int32).reshape(-1, 3)
                yield answer(np.full(len(x), part), x[:, 0], x[:, 1], x[:, 2])
            held.append(b.filter(pc.invert(told)))
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            del held
            key = np.asarray(_chunk(table.column(0)))
            order = np.argsort(key, kind="stable")
            size = pc.binary_length(table.column(6)).to_numpy().astype(np.int64)[order]
            upto = np.cumsum(size)
            edge = np.flatnonzero(np.diff(key[order])) + 1  # an anchor is never cut
            lo = 0
            while lo < len(order):
                done = upto[lo] - size[lo]
                near = edge[np.searchsorted(edge, lo, side="right") :]
                fits = near[upto[near - 1] - done <= COMPARED]
                hi = int(fits[-1]) if len(fits) else int(near[0]) if len(near) else len(order)
                if len(near) == 0 or upto[-1] - done <= COMPARED:
                    hi = len(order)
                yield solve(table.take(pa.array(order[lo:hi])))
                lo = hi
        tidy()

    return run


def _finish(spec: Spec, cut: Callable[[bytes, np.ndarray], tuple[int, bytes]], names: list[str], id_type: pa.DataType):
    """doc_id, n_items, spans, kept of the texts of a part."""

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        row = np.asarray(_chunk(docs.column("row"))).astype(np.int64)
        spans = np.zeros((0, 3), np.int64)
        if found.num_rows:
            spans = joined(*(np.asarray(_chunk(found.column(c))).astype(np.int64) for c in ("row", "first", "n")), touch=spec.length - 1)
            spans[:, 2] += spans[:, 1] + spec.length - 1
        lo, hi = np.searchsorted(spans[:, 0], row), np.searchsorted(spans[:, 0], row, side="right")
        n, kept = [], []
        for text, a, b in zip(_chunk(docs.column("text")).cast(pa.large_binary()).to_pylist(), lo.tolist(), hi.tolist(), strict=True):
            size, rest = cut(text, spans[a:b, 1:].tolist())
            n.append(size)
            kept.append(rest)
        many = hi - lo
        at = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
        pairs = pa.StructArray.from_arrays([pa.array(spans[at, 1]), pa.array(spans[at, 2])], names=["start", "stop"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), pairs)
        return pa.table([_chunk(docs.column("doc_id")).cast(id_type), pa.array(n, pa.int64()), lists, pa.array(kept, pa.binary())], names=names)

    return run


def remove_repeats(docs: DataFrame, spec: Spec, compare, cut, keep: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_items, spans (start and stop of what goes, in items) and kept (the bytes that stay) of every row.

    compare(block, spec) returns (context, first window, windows) of what is to go; cut(text, spans)
    returns the number of items and the kept bytes of a text. keep: what stays of equal windows, see
    settle(). Every row is a document of its own, whatever its id; ids may be of any type that has an
    order, null is the smallest.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    ship(spark)
    texts = held_rows(docs, "texts", F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind, id_type = texts.schema["doc_id"].dataType.simpleString(), to_arrow_type(texts.schema["doc_id"].dataType)
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(texts) // BLOCK_INPUT)
    repeated = texts.select("part", "text").mapInArrow(_anchors(spec), "key long, part long, many boolean").repartition(blocks, "key").mapInArrow(_repeated, "part long, key long")
    names = ["key", "part", "n", "row", "first", "doc_id", "text", "who"]
    made = texts.groupBy("part").cogroup(repeated.groupBy("part")).applyInArrow(_contexts(spec, keep, names, id_type), f"key long, part long, n int, row int, first int, doc_id {kind}, text binary, who binary")
    answers = made.repartition(blocks, "key").mapInArrow(_block(compare, spec, keep), "part long, row int, first int, n int")
    out = ["doc_id", "n_items", "spans", "kept"]
    return texts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_finish(spec, cut, out, id_type), f"doc_id {kind}, n_items long, spans array<struct<start: bigint, stop: bigint>>, kept binary")


def with_counts(out: DataFrame) -> DataFrame:
    """n_removed, n_spans and kept_sha256, from the spans and the kept text."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, span: n + span["stop"] - span["start"])
    return out.withColumns({"n_removed": removed, "n_spans": F.size("spans").cast("long"), "kept_sha256": F.sha2("kept", 256)})
