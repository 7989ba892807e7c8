"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text becomes a vector of statistics, transformed so that classes are near Gaussian. Each class
has a mean and a covariance shrunk towards the pooled diagonal; a score is the logistic of the
difference of the Mahalanobis log-densities, computed with Cholesky factors that are kept in the
model. Moments are sums over all labelled training rows, combined on the way; only the sums (two
vectors and matrices of the number of statistics) reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTE, Texts, arrow_map, hash64, per_doc, runs, ship, slices, stage

SEED = 701
STATISTICS = (
    "words", "letters", "upper", "digits", "marks", "symbols", "bars", "space", "other_bytes",
    "word_length", "distinct_words", "distinct_pairs", "line_words", "distinct_lines", "top_word", "marked_words",
)

_kinds = np.zeros((7, 256), np.int64)
_kinds[0, [*range(65, 91), *range(97, 123)]] = 1
_kinds[1, 65:91] = 1
_kinds[2, 48:58] = 1
_kinds[3, [ord(c) for c in "!?"]] = 1
_kinds[4, [ord(c) for c in "#$%&*@^~=+_<>\\{}[]"]] = 1
_kinds[5, [ord(c) for c in "|/:;"]] = 1
_kinds[6, 128:] = 1


def _distinct(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each document, and the count of its most frequent one."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    key = h ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    k, d = key[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    most = np.zeros(n)
    np.maximum.at(most, d[first], np.diff(np.concatenate([first, [len(k)]])))
    return np.bincount(d[first], minlength=n).astype(float), most


def statistics(t: Texts) -> np.ndarray:
    """A row of transformed statistics for each document of a slice; zeros for an empty text."""
    size = np.maximum(np.diff(t.off), 1).astype(float)
    counts = [per_doc(k[t.buf], t.off) for k in _kinds]
    s, e, off = runs(t, t.buf, WORD_BYTE)
    n_words = np.diff(off).astype(float)
    some = np.maximum(n_words, 1)
    h = hash64(SEED)
    prefix = h.prefix(t.buf)
    words = h.ranges(prefix, s, e) if len(s) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(t.n), np.diff(off))
    distinct, most = _distinct(words, doc, t.n)
    pairs = h.grams(words, 2)
    inside = doc[:-1] == doc[1:] if len(doc) else np.zeros(0, bool)
    two, _ = _distinct(pairs[inside], doc[:-1][inside], t.n) if len(pairs) else (np.zeros(t.n), None)
    line_byte = np.ones(256, bool)
    line_byte[10] = False
    ls, le, loff = runs(t, t.buf, line_byte)
    n_lines = np.maximum(np.diff(loff), 1).astype(float)
    lines, _ = _distinct(h.ranges(prefix, ls, le) if len(ls) else np.zeros(0, np.uint64), np.repeat(np.arange(t.n), np.diff(loff)), t.n)
    ends = t.buf[e - 1] if len(e) else np.zeros(0, np.uint8)
    marked = per_doc((_kinds[3] + _kinds[4] + _kinds[5])[ends], off) if len(e) else np.zeros(t.n)
    share = lambda x, of: np.sqrt(x / of)
    out = np.column_stack([
        np.log1p(n_words), share(counts[0], size), share(counts[1], size), share(counts[2], size), share(counts[3], size),
        share(counts[4], size), share(counts[5], size), share(size - per_doc(WORD_BYTE[t.buf].astype(np.int64), t.off), size),
        share(counts[6], size), np.log1p(per_doc(e - s, off) / some), share(distinct, some), share(two, np.maximum(n_words - 1, 1)),
        np.log1p(n_words / n_lines), share(lines, n_lines), share(most, some), share(marked, some),
    ])
    out[np.diff(t.off) == 0] = 0
    return out


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its vector of statistics, for every row and whole text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch):
        for t in slices(batch.column(1)):
            x = statistics(t)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(t.n + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield {"doc_id": batch.column(0).slice(t.rows[0], t.n), "x": lists}

    return arrow_map(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, x array<double>")


@dataclass
class Discriminant:
    """Two Gaussian classes; ``inverse`` has the inverted Cholesky factor of each covariance, worked out once."""

    mean: np.ndarray
    inverse: np.ndarray
    offset: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        """log density of class 1 less that of class 0, priors included."""
        d = []
        for c in (0, 1):
            z = (x - self.mean[c]) @ self.inverse[c].T
            d.append(self.offset[c] - 0.5 * np.einsum("ij,ij->i", z, z))
        return d[1] - d[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -500, 500)))


def fit(train: DataFrame, shrinkage: float = 0.1, ridge: float = 1e-3) -> Discriminant:
    """train: rows (x, label) with label 0 or 1. Without rows of a class, the other is always predicted."""

    def sums(batches):
        n = np.zeros(2)
        first, second = np.zeros((2, len(STATISTICS))), np.zeros((2, len(STATISTICS), len(STATISTICS)))
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column(0).flatten()).reshape(b.num_rows, -1)
                y = np.asarray(b.column(1))
                for c in (0, 1):
                    own = x[y == c]
                    n[c] += len(own)
                    first[c] += own.sum(0)
                    second[c] += own.T @ own
        if n.sum():
            yield pa.RecordBatch.from_pydict({"m": [np.concatenate([n, first.ravel(), second.ravel()])]})

    k = len(STATISTICS)
    ship(train.sparkSession)
    parts = train.select("x", F.col("label").cast("int")).mapInArrow(sums, "m array<double>")
    total = parts.select(F.posexplode("m").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    m = np.array([r.v for r in total]) if total else np.zeros(2 + 2 * k + 2 * k * k)
    n, first, second = m[:2], m[2 : 2 + 2 * k].reshape(2, k), m[2 + 2 * k :].reshape(2, k, k)
    some = np.maximum(n, 1)
    mean = first / some[:, None]
    cov = second / some[:, None, None] - np.einsum("ci,cj->cij", mean, mean)
    pooled = np.maximum(np.einsum("c,cii->i", n, cov) / max(n.sum(), 1), 0) + ridge
    inverse, offset = [], []
    for c in (0, 1):
        a = shrinkage if n[c] > 5 * k else 1.0
        shrunk = (1 - a) * cov[c] + a * np.diag(pooled) + ridge * np.eye(k)
        chol = np.linalg.cholesky(shrunk)
        inverse.append(np.linalg.solve(chol, np.eye(k)))
        offset.append(np.log(max(n[c], 1e-9) / max(n.sum(), 1)) - np.log(np.diag(chol)).sum())
    return Discriminant(mean, np.array(inverse), np.array(offset))


def held_out(id_column: Column, buckets: int = 4, out: int = 2) -> Column:
    return F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(buckets)) == out


def _trained(vectors: DataFrame, labels: DataFrame, id_col: str, label_col: str, buckets: int, out: int):
    """The model of the labelled rows of vectors outside the held-out fold, as a broadcast."""
    y = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    train = vectors.join(y, "doc_id").where(~held_out(F.col("doc_id"), buckets, out)).select("x", "label")
    return vectors.sparkSession.sparkContext.broadcast(fit(train))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.7, buckets: int = 4, out: int = 2) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted.

    Learns from labelled rows outside the held-out fold: crc32 of the id as text, modulo buckets,
    is not ``out``. Null or empty texts have zero statistics and are scored like any text; null
    labels and labels without a document teach nothing; a null id is never held out and never
    labelled; repeated rows are scored alike, each row of one id by its own text, and count as often
    in training as they occur. An empty table gives no rows.
    """
    vectors = stage(describe(docs, id_col, text_col), "statistics")
    model = _trained(vectors, labels, id_col, label_col, buckets, out)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch):
        if batch.num_rows:
            x = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
            score = model.value.score(x)
            yield {"doc_id": batch.column(0), "score": score, "predicted": (score >= threshold).astype(np.int32)}

    scored = arrow_map(vectors, run, f"doc_id {kind}, score double, predicted int")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id"), buckets, out), F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.7, buckets: int = 4, out: int = 2) -> DataFrame:
    """docs without the rows that the classifier scores below ``threshold``.

    Every row is scored by its own text as it passes, so null ids and ids with several texts get
    decisions of their own, and the documents are not shuffled; all columns of docs stay.
    """
    ship(docs.sparkSession)

    @F.arrow_udf("array<double>")
    def vector(text: pa.Array) -> pa.Array:
        x = np.concatenate([np.zeros((0, len(STATISTICS))), *(statistics(t) for t in slices(text))])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))

    rows = stage(docs.select(F.struct(*docs.columns).alias("row_"), vector(F.col(text_col)).alias("x")), "rows")
    model = _trained(rows.select(F.col("row_")[id_col].alias("doc_id"), "x"), labels, id_col, label_col, buckets, out)

    @F.arrow_udf("boolean")
    def good(x: pa.Array) -> pa.Array:
        return pa.array(model.value.score(np.asarray(x.flatten()).reshape(len(x), -1)) >= threshold)

    return rows.where(good("x")).select(*[F.col("row_")[c].alias(c) for c in docs.columns])
