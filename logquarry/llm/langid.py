"""Language identification: averaged hashed subword embeddings with a linear softmax.

Subwords are the byte n-grams (2 to 4) of a text, hashed into buckets. A text is the average of its
buckets' embeddings; a linear layer and a softmax give the language. Embeddings and layer are
trained together by stochastic gradient descent in numpy. Only bucket counts of a bounded sample of
documents reach the driver: whole texts, about ``SAMPLE`` in all, as many of each language, chosen by
a hash of id and text, of equal rows one. ``LANGUAGES`` bounds how many languages are learned, the most frequent
ones. For
prediction the two layers are multiplied out to one table of buckets x languages, so a text costs a
gather and a sum. A temperature, fitted on a part of the sample, calibrates the probabilities, and
``detect`` rejects texts below a threshold as ``und``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Texts, arrow_map, slices

#: Documents that the model is fitted on, in all, and the most languages it tells apart.
SAMPLE, LANGUAGES = 2000, 500
BUCKETS = 1 << 13
DIMENSION = 16
GRAMS = (2, 3, 4)


def subwords(t: Texts):
    """For each n-gram length: bucket of every n-gram of a slice, and the document offsets into them."""
    x = t.buf.astype(np.uint32)
    for n in GRAMS:
        m = max(0, len(x) - n + 1)
        h = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h ^= x[k : k + m]
            h *= np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        start = np.minimum(t.off, m)
        yield n, (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - 13), start


def _sums(t: Texts, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of table rows over each document's n-grams, and their number. N-grams that cross a border are left out."""
    total, count = np.zeros((t.n, table.shape[1])), np.zeros(t.n)
    for n, h, start in subwords(t):
        end = np.maximum(start[:-1], np.minimum(t.off[1:] - n + 1, len(h)))
        for c in range(table.shape[1]):
            acc = np.zeros(len(h) + 1)
            np.cumsum(table[h, c], out=acc[1:])
            total[:, c] += acc[end] - acc[start[:-1]]
        count += end - start[:-1]
    return total, count


def _counts(t: Texts, i: int) -> tuple[np.ndarray, np.ndarray]:
    one = Texts(t.buf[t.off[i] : t.off[i + 1]], np.array([0, t.off[i + 1] - t.off[i]]), (0, 1))
    all_ = np.concatenate([h for _, h, _ in subwords(one)]) if len(one.buf) else np.zeros(0, np.uint32)
    return np.unique(all_, return_counts=True)


class Model:
    def __init__(self, names: list[str], table: np.ndarray, bias: np.ndarray, temperature: float):
        self.names, self.table, self.bias, self.temperature = names, table, bias, temperature

    def predict(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Index of the likeliest language, and its calibrated probability."""
        total, count = _sums(t, self.table)
        z = (total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        return p.argmax(1), p.max(1)


def sample(docs: DataFrame, most: int = SAMPLE, languages: int = LANGUAGES) -> list[tuple]:
    """(lang, buckets, shares) of about ``most`` documents of rows (lang, text, order_), about as many of each language: those whose hash order_ lies below a share, so nothing is sorted or gathered first."""
    counts = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "lang").limit(languages).collect()
    if not counts:
        return []
    quota, left = {}, most
    for i, r in enumerate(sorted(counts, key=lambda r: (r.c, r.lang))):  # what a small language leaves goes to the others
        quota[r.lang] = min(r.c, -(-left // (len(counts) - i)))
        left = max(0, left - quota[r.lang])
    shares = [(r.lang, int(quota[r.lang] / r.c * (1 << 30))) for r in counts]

    def run(batch: pa.RecordBatch):
        for t in slices(batch.column(1)):
            rows = [_counts(t, i) for i in range(t.n)]
            yield {"lang": batch.column(0).slice(t.rows[0], t.n), "k": [r[0].astype(np.uint16).tobytes() for r in rows], "v": [(r[1] / max(r[1].sum(), 1)).astype(np.float32).tobytes() for r in rows]}

    below = F.create_map(*[F.lit(x) for pair in shares for x in pair])
    chosen = docs.where(F.pmod("order_", F.lit(1 << 30)) < below[F.col("lang")]).dropDuplicates(["order_"]).select("lang", "text")
    rows = arrow_map(chosen, run, "lang string, k binary, v binary").collect()
    rows.sort(key=lambda r: (r.lang, bytes(r.k), bytes(r.v)))  # the same model whatever order the tasks ended in
    return [(r.lang, np.frombuffer(r.k, np.uint16), np.frombuffer(r.v, np.float32)) for r in rows]


def train(rows: list[tuple], epochs: int = 12, rate: float = 20.0, seed: int = 4) -> Model:
    """Stochastic gradient descent, one document at a time, the rate falling to 0; a tenth is held for the temperature."""
    names = sorted({r[0] for r in rows})
    if not names:
        return Model(["und"], np.zeros((BUCKETS, 1)), np.zeros(1), 1.0)
    rng = np.random.Generator(np.random.PCG64(seed))
    e = rng.normal(0, 0.1, (BUCKETS, DIMENSION))
    w, b = rng.normal(0, 0.1, (DIMENSION, len(names))), np.zeros(len(names))
    y = np.array([names.index(r[0]) for r in rows])
    order = rng.permutation(len(rows))
    held, used = (order[: len(rows) // 10], order[len(rows) // 10 :]) if len(rows) >= 50 else (order[:0], order)
    steps, step = epochs * len(used), 0
    for _ in range(epochs):
        for i in rng.permutation(used):
            _, k, v = rows[i]
            lr = rate * (1 - step / steps)
            step += 1
            x = v @ e[k] if len(k) else np.zeros(DIMENSION)
            z = x @ w + b
            g = np.exp(z - z.max())
            g /= g.sum()
            g[y[i]] -= 1
            back = w @ g
            w -= 0.05 * lr * np.outer(x, g)
            b -= 0.002 * lr * g
            if len(k):
                e[k] -= lr * v[:, None] * back[None, :]
    table = e @ w
    z = np.array([rows[i][2] @ table[rows[i][1]] + b for i in held]) if len(held) else np.zeros((0, len(names)))

    def loss(temperature: float) -> float:
        s = z / temperature
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), y[held]]).mean())

    grid = [0.25 * 1.25**i for i in range(16)]
    return Model(names, table, b, min(grid, key=loss) if len(held) else 1.0)


def held_out(id_column: Column, buckets: int = 3, out: int = 1) -> Column:
    return F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(buckets)) == out


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", reject: float = 0.0, buckets: int = 3, out: int = 1, most: int = SAMPLE, languages: int = LANGUAGES) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Learns from rows with a text and a language outside the held-out fold. ``und`` (score 0) for a
    null text or one without letters, and for a score below ``reject``. Repeated rows are predicted
    alike, each row of one id by its own text; a null id is never held out. Without any row to learn
    from, all is ``und``. ``most`` and ``languages`` bound the training sample. An empty table gives no rows.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    own = F.coalesce(held_out(F.col("doc_id"), buckets, out), F.lit(False))
    learn = base.where("lang is not null and text is not null").where(~own).select("lang", "text", F.xxhash64("doc_id", "text").alias("order_"))
    model = docs.sparkSession.sparkContext.broadcast(train(sample(learn, most, languages)))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch):
        names = np.array([*model.value.names, "und"], object)
        for t in slices(batch.column(1)):
            best, p = model.value.predict(t)
            ok = np.asarray(batch.column(2).slice(t.rows[0], t.n).to_numpy(zero_copy_only=False), bool) & (p >= reject) & (model.value.names != ["und"])
            yield {"doc_id": batch.column(0).slice(t.rows[0], t.n), "held_out": batch.column(3).slice(t.rows[0], t.n), "lang_pred": pa.array(names[np.where(ok, best, len(names) - 1)], pa.string()), "score": np.where(ok, p, 0.0)}

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return arrow_map(base.select("doc_id", "text", lettered.alias("lettered"), own.alias("held_out")), run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
