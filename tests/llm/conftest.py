import random

import pytest

WORDS = [f"w{i}" for i in range(4000)]


@pytest.fixture
def corpus(spark):
    """Documents with copies, near copies, shared passages, repeats, nulls, empties, ties and columns with clashing names."""

    def make(n=120, seed=5):
        rng = random.Random(seed)
        prose = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
        shared = prose(60)
        texts = []
        for i in range(n):
            kind = i % 12
            if kind == 1 and i > 12:
                t = texts[i - 9]
            elif kind == 2 and i > 12:
                w = (texts[i - 12] or "x").split(" ")
                w[len(w) // 2] = "changed"
                t = " ".join(w)
            elif kind == 3:
                t = prose(20) + " " + shared + "\n" + prose(15)
            elif kind == 4:
                t = (prose(30) + " ") * 4
            elif kind == 5:
                t = ["", None, "  \n", "a", "a b", "É ünï" * 40][(i // 12) % 6]
            elif kind == 6:
                t = prose(2000)
            else:
                t = prose(rng.randint(5, 200))
            texts.append(t)
        rows = [(i, t, None if i % 17 == 0 else ["s1", "s2", None, "s3"][i % 4], "zz", i % 3, "x") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, size int, keep_id string").repartition(3)

    return make


@pytest.fixture
def odd(spark):
    """Repeated rows, a null id, ids with two texts."""
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "other text here"), (2, "a b c d e f"), (3, None)]
    return spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
