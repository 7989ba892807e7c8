"""Substring dedup by relative Lempel-Ziv parsing.

repeats.py brings to each reference block all contexts in which a window can occur, so a document
is factored against every block that can hold a match for it. A block names its words (equal names
for equal words, told from their bytes) and sorts the suffixes of its contexts by prefix doubling.
With each suffix the index keeps the nearest ones before and after it that stand in a document of
smaller id: one of the two has the longest match that any earlier source offers.

Contexts are parsed greedily from left to right, all contexts of a block in step. At the head of a
factor its longest match is taken word by word from the two sources; the next factor begins where
it ends. A factor of at least a window covers its windows without another look. The windows that
cross a factor's end are looked up by themselves: the greedy choice may have cut them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import Block, Spec, mask_runs, remove_repeats, with_counts
from .suffix_dedup import smaller_before


class Reference:
    """The index of a block: word offsets of its contexts, ranks of all suffixes by their first 1, 2, 4 ... words, and two sources of each suffix."""

    def __init__(self, b: Block):
        words = b" ".join(b.texts).split(b" ")
        self.size = np.array([x.count(b" ") + 1 for x in b.texts], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.end = np.repeat(self.start + self.size, self.size)
        n, longest = len(words), int(self.size.max())
        rank = pd.factorize(np.array(words, object))[0].astype(np.int64) + 1
        self.levels, span = [(1, rank)], 1
        at = np.arange(n)
        while span < longest:  # 0 stands for the end of a context
            nxt = np.where(at + span < self.end, rank[np.minimum(at + span, n - 1)], 0)
            rank = np.unique(rank * (n + 1) + nxt, return_inverse=True)[1].astype(np.int64) + 1
            span *= 2
            self.levels.append((span, rank))
        owner = np.repeat(b.place, self.size)
        order = np.lexsort((owner, rank))
        before, _ = smaller_before(owner[order], np.zeros(n, np.int64))
        after, _ = smaller_before(owner[order][::-1], np.zeros(n, np.int64))
        after = np.where(after[::-1] >= 0, n - 1 - after[::-1], -1)
        self.sources = []
        for near in (before, after):
            source = np.full(n, -1, np.int64)
            source[order] = np.where(near >= 0, order[near], -1)
            self.sources.append(source)

    def match(self, at: np.ndarray) -> np.ndarray:
        """The number of words, from each place on, of the longest match in a document of smaller id."""
        best = np.zeros(len(at), np.int64)
        for source in self.sources:
            other, out = source[at], np.zeros(len(at), np.int64)
            there = other >= 0
            room = np.where(there, np.minimum(self.end[at] - at, self.end[other] - other), 0)
            for span, rank in reversed(self.levels):
                go = out + span <= room
                a, o = np.where(go, at + out, 0), np.where(go, other + out, 0)
                out += span * (go & (rank[a] == rank[o]))
            best = np.maximum(best, out)
        return best


def factors(ref: Reference, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first word, words) of the factors of a greedy parse of every context, as far as a window of ``length`` words can begin."""
    found = [(np.zeros(0, np.int64),) * 3]
    context, head = np.arange(len(ref.size)), ref.start.copy()
    while len(context):
        size = np.maximum(ref.match(head), 1)  # a word without a source is a factor of its own
        found.append((context, head - ref.start[context], size))
        head = head + size
        go = head + length <= ref.start[context] + ref.size[context]
        context, head = context[go], head[go]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def duplicates(b: Block, spec: Spec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first window, windows) of the windows that also start in a document of smaller id."""
    ref = Reference(b)
    context, first, size = factors(ref, spec.length)
    base = np.cumsum(b.n) - b.n
    which = np.repeat(np.arange(len(b.n)), b.n)
    inner = np.arange(b.n.sum()) - base[which]

    def marked(c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The windows lo to hi - 1 of contexts c."""
        lo, hi = np.clip(lo, 0, b.n[c]), np.clip(hi, 0, b.n[c])
        edge = np.zeros(len(which) + 1, np.int64)
        np.add.at(edge, base[c] + lo, 1)
        np.add.at(edge, base[c] + np.maximum(lo, hi), -1)
        return np.cumsum(edge[:-1]) > 0

    long_ = size >= spec.length
    hit = marked(context[long_], first[long_], first[long_] + size[long_] - spec.length + 1)
    across = np.flatnonzero(marked(context, first + size - spec.length + 1, first + size) & ~hit)
    hit[across] = ref.match(ref.start[which[across]] + inner[across]) >= spec.length
    return mask_runs(hit, which, inner)


def cut(text: bytes, spans: list[list[int]]) -> tuple[int, bytes]:
    """The number of words, and the words outside the spans, one space between."""
    words = text.split()
    if not spans:
        return len(words), b" ".join(words)
    at = [0, *(x for span in spans for x in span), len(words)]
    return len(words), b" ".join([w for a, z in zip(at[::2], at[1::2], strict=True) for w in words[a:z]])


def remove_repeated_passages(docs: DataFrame, length: int = 13, k: int = 4, **cols) -> DataFrame:
    """One row per input row: doc_id, n_words, spans, kept, n_removed, n_spans, kept_sha256.

    ``spans`` has start and stop of the words that go, ``kept`` the words that stay, one space between.

    A word goes if a window of ``length`` words that covers it also starts in a document of smaller
    id; windows are judged on the input. A null or empty text has no words; a text of fewer words
    than a window loses nothing; rows that share an id are no earlier sources for each other; a null
    id is smaller than any; ids may be of any type that has an order. An empty table gives no rows.
    """
    out = remove_repeats(docs, Spec("words", length, min(k, length)), duplicates, cut, "smallest", **cols)
    return with_counts(out.withColumn("kept", F.col("kept").cast("string"))).withColumnRenamed("n_items", "n_words")
