"""Token counts with overlap resynchronisation for huge documents.

Texts are encoded by the tokenizer library. One longer than a chunk is encoded in overlapping chunks
with offsets, so that what the library holds is bounded. Two neighbours are spliced at a piece
boundary that both have inside the overlap. Splitting reads only forwards, so from a common boundary
on, the later chunk has the pieces of the whole text; and the earlier chunk's boundaries are those
of the whole text but for its last two pieces, which its end may have cut. If no such boundary
exists the overlap is doubled, and at last the chunk. For a vocabulary whose splitting rule is not
known to read only forwards, or that normalises texts, a text is encoded whole. Of texts within a
chunk, each different piece is encoded once (see bpe.Encoder).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder, encoder
from .common import arrow_map, slices

CHUNK = 32_768
OVERLAP = 512
#: Bytes of texts that the library encodes at once.
BATCH_BYTES = 500_000


def chunk_counts(enc: Encoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[int, int, int]]:
    """Yields (start, end, tokens) of whole pieces that cover the text, one for each chunk."""
    n, begin, sure = len(text), 0, 0  # pieces from sure on are still to come
    size = chunk
    own = None  # the pieces of the chunk at begin, if they are known
    while True:
        end = min(begin + size, n)
        if own is None:
            start, tokens = enc.pieces(text[begin:end])
            own = start + begin, tokens
        start, tokens = own
        if end == n:
            yield sure, n, int(tokens[start >= sure].sum())
            return
        stable, back, found = start[:-2], overlap, None
        while found is None and back < end - sure:
            nxt = end - back
            other, more = enc.pieces(text[nxt : min(nxt + size, n)])
            other = other + nxt
            common = np.intersect1d(stable[stable > max(sure, nxt)], other[1:])
            if len(common):
                found = int(common[0])
            back *= 2
        if found is None:
            size, own = size * 2, None
            continue
        yield sure, found, int(tokens[(start >= sure) & (start < found)].sum())
        begin, sure, own = nxt, found, (other, more)
        if size > chunk:  # the chunk that was widened is done
            begin, size, own = found, chunk, None


def count_one(enc: Encoder, text: str, chunk: int = CHUNK) -> int:
    """Tokens of a text; special strings inside it are what the library makes of them."""
    if len(text) <= chunk or not enc.forward:
        return enc.counts([text])[0]
    parts, total = [text], 0
    for name in enc.special:
        split = [p.split(name) for p in parts]
        total += sum(len(x) - 1 for x in split)
        parts = [p for x in split for p in x]
    return total + sum(n for p in parts if p for _, _, n in chunk_counts(enc, p, chunk))


def count(enc: Encoder, texts: list[str], chunk: int = CHUNK) -> list[int]:
    """Tokens of each text."""
    short = [i for i, x in enumerate(texts) if len(x) <= chunk]
    out = dict(zip(short, enc.counts([texts[i] for i in short]), strict=True))
    return [out[i] if i in out else count_one(enc, x, chunk) for i, x in enumerate(texts)]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    tokenizer: path of a vocabulary file (.json, .tiktoken, .model), readable on every executor. Null
    or empty texts have no tokens; no begin, end or other special tokens are added; a null id is
    carried and repeated rows are counted each. No shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch):
        enc = encoder(tokenizer)
        for t in slices(batch.column(1), BATCH_BYTES):
            n = np.array(count(enc, [x or "" for x in batch.column(1).slice(t.rows[0], t.n).to_pylist()], chunk), np.int64)
            yield {"doc_id": batch.column(0).slice(t.rows[0], t.n), "n_bytes": np.diff(t.off), "n_tokens": n, "over_limit": n > limit}

    return arrow_map(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
