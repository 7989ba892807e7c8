"""Suffix-array dedup: strings of a fixed number of bytes that occur more than once.

repeats.py narrows the corpus to contexts that may repeat, and brings together in a block all
contexts in which a string can occur. A block sorts the suffixes that start a string, cut at the
length asked for, by prefix doubling, equal ones by position: doc_id, row, place. Over this order
the previous and the next smaller position of a suffix, with the least common prefix on the way, give
its longest previous factor; the larger positions give its longest next factor. The previous factor
reaches the length for all but the first of equal strings, the next factor for all but the last: with
both, every copy goes; with the first alone, the first copy stays. Of contexts that are equal as a
whole (compared byte by byte), all but the first have a previous factor and all but the last a next
one; the first alone is sorted against other contexts.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame

from .repeats import Block, Spec, mask_runs, remove_repeats, with_counts

KEY = 8
#: Rounds of jumps over all open places at once, before the rest is walked one by one.
JUMPS = 40


def _ranks(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1].astype(np.int64)


def _levels(buf: np.ndarray, length: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The first bytes at each place as a number, and ranks of the places by their first h bytes, h doubling."""
    n = len(buf)
    padded = np.concatenate([buf, np.zeros(KEY, np.uint8)]).astype(np.uint64)
    step = min(KEY, length)
    first = np.zeros(n, np.uint64)
    for k in range(step):
        first = (first << np.uint64(8)) | padded[k : k + n]
    levels = [(step, _ranks(first))]
    while levels[-1][0] * 2 <= length:
        h, r = levels[-1]
        nxt = np.zeros(n, np.int64)
        nxt[: max(0, n - h)] = r[h:] + 1
        levels.append((2 * h, _ranks(r * (n + 2) + nxt)))
    return first, levels


def _order(levels: list[tuple[int, np.ndarray]], at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    n, offset, keys = len(levels[0][1]), 0, []
    for h, r in reversed(levels):
        while offset + h <= length:
            keys.append(r[np.minimum(at + offset, n - 1)])
            offset += h
    if offset < length:
        step, rank = levels[0]
        keys.append(rank[at + length - step])
    order = np.lexsort(keys[::-1])
    same = np.zeros(len(at), bool)
    if len(at):
        same[1:] = np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in keys])
    return order, same


def window_order(buf: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``at`` by their first ``length`` bytes, and whether each in that order equals the one before."""
    return _order(_levels(buf, length)[1], at, length)


def _common(first: np.ndarray, levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, cut at ``length``."""
    n, out = len(first), np.zeros(len(a), np.int64)
    for h, r in reversed(levels):
        go = (out + h <= length) & (r[np.minimum(a + out, n - 1)] == r[np.minimum(b + out, n - 1)])
        out += h * go
    step = levels[0][0]
    differ = first[np.minimum(a + out, n - 1)] ^ first[np.minimum(b + out, n - 1)]
    for k in range(1, step):  # the bytes before the first that differs
        out += differ < np.uint64(1 << 8 * k)
    return np.minimum(out, length)


def smaller_before(value: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest one before with a smaller value (-1: none), and the least of ``common`` on the way.

    common[i] belongs to the step from i - 1 to i; common[0] is 0.
    """
    at, low = np.arange(-1, len(value) - 1), common.copy()
    todo = np.arange(1, len(value))
    for _ in range(JUMPS):
        todo = todo[at[todo] >= 0]
        todo = todo[value[at[todo]] >= value[todo]]
        if not len(todo):
            return at, low
        over = at[todo]
        low[todo] = np.minimum(low[todo], low[over])
        at[todo] = at[over]
    values, ats, lows = value.tolist(), at.tolist(), low.tolist()
    for i in todo.tolist():  # long chains: from left to right, over settled places only
        j, least, own = ats[i], lows[i], values[i]
        while j >= 0 and values[j] >= own:
            least = min(least, lows[j])
            j = ats[j]
        ats[i], lows[i] = j, least
    return np.array(ats, np.int64), np.array(lows, np.int64)


def _longest(value: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The longer common prefix with the previous and the next smaller value."""
    back = np.concatenate([common[:1], common[:0:-1]])
    return np.maximum(smaller_before(value, common)[1], smaller_before(value[::-1], back)[1][::-1])


def factors(buf: np.ndarray, at: np.ndarray, length: int, following: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Longest previous and, if asked for, longest next factor of the suffixes at ``at``, cut at ``length``; earlier in ``at`` is previous."""
    previous = np.zeros(len(at), np.int64)
    after = np.zeros(len(at), np.int64) if following else None
    if len(at):
        first, levels = _levels(buf, length)
        order, same = _order(levels, at, length)
        common = np.zeros(len(at), np.int64)
        common[same] = length
        new = np.flatnonzero(~same)[1:]
        common[new] = _common(first, levels, at[order[new]], at[order[new - 1]], length)
        previous[order] = _longest(order, common)
        if following:
            after[order] = _longest(-order, common)
    return previous, after


def copies(b: Block, spec: Spec, keep_first: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first string, strings) of what occurs elsewhere, or before if the first copy stays; contexts are in the order of their positions."""
    start = np.cumsum(b.size) - b.size
    which = np.repeat(np.arange(len(b.n)), b.n)
    inner = np.arange(b.n.sum()) - np.repeat(np.cumsum(b.n) - b.n, b.n)
    previous, after = factors(np.frombuffer(b"".join(b.texts), np.uint8), start[which] + inner, spec.length, not keep_first)
    hit = previous >= spec.length
    if not keep_first:
        hit |= after >= spec.length
    return mask_runs(hit, which, inner)


def cut(text: bytes, spans: list[list[int]]) -> tuple[int, bytes]:
    """The number of bytes, and the bytes outside the spans."""
    if not spans:
        return len(text), text
    at = [0, *(x for span in spans for x in span), len(text)]
    return len(text), b"".join([text[a:z] for a, z in zip(at[::2], at[1::2], strict=True)])


def remove_repeated_strings(docs: DataFrame, length: int = 200, k: int = 32, keep_first: bool = False, **cols) -> DataFrame:
    """One row per input row: doc_id, n_bytes, spans, kept, n_removed, n_spans, kept_sha256.

    ``spans`` has start and stop of the bytes that go, ``kept`` the bytes that stay (binary: a string
    may begin or end within a character).

    Every byte covered by a string of ``length`` bytes that also starts elsewhere goes, in the same
    document too; overlaps count, and strings are judged on the input. Matches never cross
    documents. A null text is empty; a text shorter than ``length`` loses nothing; of repeated rows
    each is the other's copy. A null id is kept as it is. An empty table gives no rows.

    With ``keep_first`` a string goes only if it also starts earlier: in a smaller doc_id (null is the
    smallest; under one id, rows in the order in which they are read) or at an earlier place of the
    same text. Of repeated rows, one is the first. Ids may be of any type that has an order.
    """
    out = remove_repeats(docs, Spec("bytes", length, min(k, length)), partial(copies, keep_first=keep_first), cut, "first" if keep_first else "none", **cols)
    return with_counts(out).withColumnRenamed("n_items", "n_bytes")
