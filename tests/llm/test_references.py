"""The two classifiers against plain versions of themselves, one text at a time."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from logquarry.llm import common, langid, quality

TEXTS = [
    "", " \n", "a", "One two two.\nThree: 4 | five!\n\none two two.", "ÄÖ ü ü\tx#y ?", "same same same same\nsame same", "A" * 300 + " b " * 50, "1 2 3 {x} [y] <z> /w/ ;",
    "The quick brown fox jumps over the lazy dog. The end!",
]


def plain_statistics(text):
    raw = text.encode()
    if not raw:
        return [0.0] * len(quality.STATISTICS)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
    n, size = max(len(words), 1), len(raw)
    kinds = ["?!".encode(), b"#$%&*@^~=+_<>\\{}[]", b"|/:;"]
    share = lambda x, of: math.sqrt(x / of)
    count = lambda test: sum(1 for c in raw if test(c))
    space = {0x20, *range(9, 14)}
    pairs = list(zip(words, words[1:]))
    return [
        math.log1p(len(words)), share(count(lambda c: chr(c).isalpha() and c < 128), size), share(count(lambda c: 65 <= c <= 90), size), share(count(lambda c: 48 <= c <= 57), size),
        *[share(count(lambda c, k=k: c in k), size) for k in kinds], share(count(lambda c: c in space), size), share(count(lambda c: c > 127), size),
        math.log1p(sum(map(len, words)) / n), share(len(set(words)), n), share(len(set(pairs)), max(len(words) - 1, 1)), math.log1p(len(words) / max(len(lines), 1)), share(len(set(lines)), max(len(lines), 1)),
        share(max(Counter(words).values(), default=0), n), share(sum(any(w[-1] in k for k in kinds) for w in words), n),
    ]


def test_statistics():
    t = next(common.slices(pa.array(TEXTS, pa.large_string())))
    assert np.allclose(quality.statistics(t), [plain_statistics(x) for x in TEXTS])


def test_scores_are_those_of_two_gaussians(spark):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(300):
        good = i % 3 > 0
        words = [f"w{rng.integers(400)}" if good else f"X{rng.integers(9)}!" for _ in range(rng.integers(5, 60))]
        rows.append((i, " ".join(words) + ("\n" if i % 2 else ".")))
        labels.append((i, int(good) if i % 5 else None))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.score_quality(docs, known).collect()}
    x = np.array([plain_statistics(t) for _, t in rows])
    train = [i for i, y in labels if y is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    y = np.array([labels[i][1] for i in train])
    parts = [x[[i for i, c in zip(train, y) if c == k]] for k in (0, 1)]
    mean = [p.mean(0) for p in parts]
    cov = [np.cov(p.T, bias=True) for p in parts]
    pooled = sum(len(p) * np.diag(c) for p, c in zip(parts, cov)) / len(train) + 1e-3
    shrunk = [(0.9 * c + 0.1 * np.diag(pooled) if len(p) > 5 * x.shape[1] else np.diag(pooled)) + 1e-3 * np.eye(x.shape[1]) for p, c in zip(parts, cov)]

    def density(v, k):
        d = v - mean[k]
        return math.log(len(parts[k]) / len(train)) - 0.5 * np.linalg.slogdet(shrunk[k])[1] - 0.5 * d @ np.linalg.inv(shrunk[k]) @ d

    for i in range(0, 300, 7):
        margin = np.clip(density(x[i], 1) - density(x[i], 0), -500, 500)
        assert abs(got[i] - 1 / (1 + math.exp(-margin))) < 1e-6


def plain_buckets(text):
    raw, out = text.encode(), []
    for n in langid.GRAMS:
        for i in range(len(raw) - n + 1):
            h = n * 0x9E3779B1 & 0xFFFFFFFF
            for c in raw[i : i + n]:
                h = (h ^ c) * 0x01000193 & 0xFFFFFFFF
                h ^= h >> 15
            out.append((h * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - 13))
    return out


def test_language_probabilities_are_those_of_averaged_embeddings():
    rng = np.random.default_rng(6)
    names = ["aa", "bb", "cc"]
    letters = {"aa": "abcd", "bb": "cdef", "cc": "xyéü"}
    rows = []
    for i in range(120):
        text = "".join(rng.choice(list(letters[names[i % 3]] + " "), rng.integers(2, 40)))
        k, v = np.unique(plain_buckets(text), return_counts=True)
        rows.append((names[i % 3], k.astype(np.uint16), (v / max(v.sum(), 1)).astype(np.float32)))
    model = langid.train(rows)
    texts = TEXTS + ["abcd dcba", "xy éü"]
    best, p = model.predict(next(common.slices(pa.array(texts, pa.large_string()))))
    for i, text in enumerate(texts):
        b = plain_buckets(text)
        z = ((np.mean(model.table[b], axis=0) if b else np.zeros(3)) + model.bias) / model.temperature
        q = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert best[i] == q.argmax() and abs(p[i] - q.max()) < 1e-6
    assert [model.names[i] for i in best[-2:]] == ["aa", "cc"]


def test_a_rare_language_is_learned(spark):
    rows = [(i, "the cat and the dog sat on the mat " * 3, "en") for i in range(3000)] + [(5000 + i, "żółw gęś łąka źdźbło " * 3, "pl") for i in range(12)] + [(i, "the cat and the dog sat on the mat " * 3, "en") for i in range(500)]
    docs = spark.createDataFrame([(i, f"{t}{i % 50}", lang) for i, t, lang in rows], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.detect(docs, most=100).collect()}
    assert {got[5000 + i] for i in range(12)} == {"pl"} and got[1] == "en"
