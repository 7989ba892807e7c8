import hashlib
import itertools
import re
from collections import Counter, defaultdict

import pytest

from logquarry.llm import exact_dedup, near_dedup, substring_dedup, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(df):
    return {r.doc_id: r.text or "" for r in df.collect()}


def test_exact(corpus):
    docs = corpus()
    groups = defaultdict(list)
    for k, t in texts(docs).items():
        groups[t].append(k)
    got = {r.doc_id: r for r in exact_dedup.exact_groups(docs, block_bytes=64).collect()}
    for t, ks in groups.items():
        for k in ks:
            r = got[k]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(ks), len(ks), k == max(ks), hashlib.sha256(t.encode()).hexdigest())
    assert len(got) == docs.count()


def test_exact_blocks_differ_in_one_place(spark):
    a = "x" * 1000
    rows = [(i, a[: i % 7 * 100] + "y" + a[i % 7 * 100 :]) for i in range(14)] + [(20, a), (21, a)]
    got = {r.doc_id: r.group_size for r in exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=64).collect()}
    assert set(got.values()) == {2} and len(got) == 16


def test_exact_odd(odd):
    got = exact_dedup.exact_groups(odd).collect()
    assert len(got) == 6 and sum(r.kept for r in got) == 3
    assert {r.keep_id for r in got if r.group_size == 4} == {2}


def brute_words(t, length):
    words = {k: WORD.findall(x) for k, x in t.items()}
    first = {}
    for k in sorted(words):
        for i in range(len(words[k]) - length + 1):
            first.setdefault(tuple(words[k][i : i + length]), k)
    out = {}
    for k, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < k:
                gone[i : i + length] = [True] * length
        out[k] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    return out


@pytest.mark.parametrize("length, k", [(13, 4), (5, 5), (7, 2)])
def test_substring(corpus, length, k):
    docs = corpus()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeated_passages(docs, length, k).collect()}
    assert got == brute_words(texts(docs), length)


def brute_bytes(t, length):
    raw = {k: x.encode() for k, x in t.items()}
    seen = Counter(x[i : i + length] for x in raw.values() for i in range(len(x) - length + 1))
    out = {}
    for k, x in raw.items():
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[k] = (len(x), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(x, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("length, k", [(200, 32), (20, 8), (37, 37), (5, 2)])
def test_suffix(corpus, length, k):
    docs = corpus()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeated_strings(docs, length, k).collect()}
    assert got == brute_bytes(texts(docs), length)


def test_suffix_order_is_lexicographic():
    import numpy as np

    rng = np.random.default_rng(1)
    for length in (1, 7, 8, 23, 64):
        buf = rng.integers(97, 99, 400).astype(np.uint8)
        at = np.arange(400 - length)
        order, same = suffix_dedup.window_order(buf, at, length)
        cut = [buf[i : i + length].tobytes() for i in at[order]]
        assert cut == sorted(cut) and [a == b for a, b in zip(cut, cut[1:])] == same[1:].tolist()


def test_repeats_with_other_ids(corpus):
    """Ids as text, in the order of their characters."""
    from pyspark.sql import functions as F

    docs = corpus().withColumn("doc_id", F.format_string("k%05d", 1000 - F.col("doc_id")))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeated_passages(docs, 7, 2).collect()}
    assert got == brute_words(texts(docs), 7)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeated_strings(docs, 20, 8, keep_first=True).collect()}
    assert got == brute_keep_first(texts(docs), 20)


def test_factors_decide_what_goes(monkeypatch):
    """Factors are the longest matches; only windows inside a factor, or across the end of one, are found."""
    import numpy as np

    from logquarry.llm import repeats

    texts_ = [b"a b c d e f g h", b"x a b c d y d e f g z", b"a b c d e f q", b"d e f g h a b c"]
    b = repeats.Block(np.zeros(4, np.int64), np.array([6, 9, 5, 6]), np.array([len(x) for x in texts_]), np.arange(4), texts_)

    def windows():
        c, s, n = substring_dedup.duplicates(b, repeats.Spec("words", 3, 2))
        return sorted((int(i), int(j)) for i, a, k in zip(c, s, n) for j in range(a, a + k))

    context, first, size = substring_dedup.factors(substring_dedup.Reference(b), 3)
    assert sorted((int(c), int(f), int(s)) for c, f, s in zip(context, first, size) if s >= 3) == [(1, 1, 4), (1, 6, 4), (2, 0, 6), (3, 0, 5), (3, 5, 3)]
    assert windows() == [(1, 1), (1, 2), (1, 6), (1, 7), (2, 0), (2, 1), (2, 2), (2, 3), (3, 0), (3, 1), (3, 2), (3, 5)]
    monkeypatch.setattr(substring_dedup, "factors", lambda ref, length: (np.zeros(0, np.int64),) * 3)
    assert windows() == []


def test_repeats_odd(odd):
    got = substring_dedup.remove_repeated_passages(odd, 3, 2).collect()
    # the null id is smaller than any, so every later holder of its windows loses them
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_removed) for r in got) == [(-1, 0), (1, 6), (1, 6), (2, 0), (2, 6), (3, 0)]
    got = suffix_dedup.remove_repeated_strings(odd, 5, 3).collect()
    assert len(got) == 6 and sum(r.n_removed == r.n_bytes > 0 for r in got) == 4


def brute_near(t, n, percent):
    sets = {}
    for k, x in t.items():
        w = WORD.findall(x.translate({i: i + 32 for i in range(65, 91)}))
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    up = {k: k for k in sets}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}


@pytest.mark.parametrize("words, percent", [(3, 85), (5, 80)])
def test_near(corpus, words, percent):
    docs = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, words, percent).collect()}
    assert got == brute_near(texts(docs), words, percent)


def test_near_star_does_not_hide_links(spark):
    """A group of near copies of one base with other distances among themselves, and pairs that only reach each other."""
    import random

    rng = random.Random(3)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(i % 9):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, 3, 85).collect()}
    assert got == brute_near(texts(docs), 3, 85)


def test_near_odd_and_empty(odd):
    want = [(-1, 4, 1, False), (1, 4, 1, True), (1, 4, 1, True), (2, 1, 2, True), (2, 4, 1, False), (3, 0, 3, True)]
    for n in (1, 3):
        got = near_dedup.near_duplicates(odd.repartition(n), 3, 85).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want
        kept = near_dedup.keep_one(odd.repartition(n), 3, 85)
        assert kept.columns == odd.columns and sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "a b c d e f"), (2, "other text here"), (3, None)]
    nulls = near_dedup.near_duplicates(odd.where("doc_id is null").union(odd.where("doc_id is null")), 3, 85).collect()
    assert [(r.component_id, r.kept) for r in nulls] == [(None, True)] * 2
    for f in (near_dedup.near_duplicates, exact_dedup.exact_groups, substring_dedup.remove_repeated_passages, suffix_dedup.remove_repeated_strings):
        assert f(odd.where("false")).count() == 0


def test_near_ids_with_several_texts(spark):
    """Links of every text of an id are found, however the rows are split."""
    x, y = [" ".join(f"{c}{i}" for i in range(9)) for c in "xy"]
    rows = [(1, x), (2, x + " x9"), (2, y), (3, y + " y9"), (4, "none of these")]
    for n in (1, 2, 3, 5):
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), 3, 85).collect()
        assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 1), (2, 2), (3, 2), (4, 4)]


def test_intersections():
    import numpy as np

    rng = np.random.default_rng(8)
    for distinct, fast in ((30, 10**9), (30, 0), (5000, 10**9), (5000, 0)):
        sets = [np.unique(rng.integers(0, distinct, rng.integers(1, 60))) for _ in range(25)]
        off = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        asked, known = np.array([1, 4, 9]), np.arange(10, 25)
        was, near_dedup.FAST, columns, near_dedup.COLUMNS = near_dedup.FAST, fast, near_dedup.COLUMNS, 7
        got = near_dedup.shared(np.concatenate(sets), off, asked, known)
        near_dedup.FAST, near_dedup.COLUMNS = was, columns
        assert got.tolist() == [[len(np.intersect1d(sets[i], sets[j])) for j in known] for i in asked]


def test_near_copies_that_are_not_near_enough(spark):
    """Documents of one template that are all alike, but less than asked for, with one pair that is."""
    import random

    rng = random.Random(12)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        for k in rng.sample(range(2, 118), 3):
            w[k] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows.append((900, rows[137][1] + " more"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, 3, 85).collect()}
    assert got == brute_near(texts(docs), 3, 85) and got[900][1] == 137


def test_sketch_estimates():
    import numpy as np

    rng = np.random.default_rng(2)
    for share in (0.5, 0.8, 0.95):
        n, m = 1000, 126
        common = rng.integers(0, 2**63, int(n * share), dtype=np.uint64)
        sides = [np.concatenate([common, rng.integers(0, 2**63, n - len(common), dtype=np.uint64)]) for _ in range(2)]
        value = np.concatenate([near_dedup.mix(s) for s in sides])
        regs = near_dedup.registers(value, np.array([0, n, 2 * n]), m)
        j = len(common) / (2 * n - len(common))
        got = near_dedup.estimate(regs[:1], regs[1:], np.array([n]), np.array([n]))[0]
        assert abs(got - j) < 0.16
        whole = near_dedup.registers(np.sort(value), np.array([0, 2 * n]), m)
        assert (near_dedup.merge(regs[0], regs[1]) == whole[0]).all()
    rows, bands = near_dedup.bands_for(0.85)
    assert (1 - 0.85**rows) ** bands < 1e-4


def brute_keep_first(t, length):
    raw = {k: x.encode() for k, x in t.items()}
    seen, out = set(), {}
    for k in sorted(raw):
        x = raw[k]
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if x[i : i + length] in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(x[i : i + length])
        out[k] = (len(x), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(c for c, g in zip(x, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("length, k", [(200, 32), (20, 8), (5, 2)])
def test_suffix_keeps_first(corpus, length, k):
    docs = corpus()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeated_strings(docs, length, k, keep_first=True).collect()}
    assert got == brute_keep_first(texts(docs), length)


def test_suffix_keeps_first_odd(odd):
    got = suffix_dedup.remove_repeated_strings(odd, 5, 3, keep_first=True).collect()
    # one of the four rows with the same text stays, that of the null id
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_removed) for r in got) == [(-1, 0), (1, 11), (1, 11), (2, 0), (2, 11), (3, 0)]
    got = suffix_dedup.remove_repeated_strings(odd.where("doc_id = 1"), 5, 3, keep_first=True).collect()
    assert sorted(r.n_removed for r in got) == [0, 11]


def test_factors():
    import numpy as np

    def common(x, y):
        return next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), len(x))

    rng = np.random.default_rng(4)
    for length, letters in ((1, 2), (5, 2), (7, 2), (8, 1), (23, 2), (37, 2), (64, 1)):
        buf = rng.integers(97, 97 + letters, 160).astype(np.uint8)
        buf[90:130] = buf[10:50]
        at = rng.permutation(161 - length)
        cut = [buf[i : i + length].tobytes() for i in at]
        previous, after = suffix_dedup.factors(buf, at, length)
        assert previous.tolist() == [max((common(x, y) for y in cut[:i]), default=0) for i, x in enumerate(cut)]
        assert after.tolist() == [max((common(x, y) for y in cut[i + 1 :]), default=0) for i, x in enumerate(cut)]


def test_smaller_before_with_long_chains():
    import numpy as np

    value = np.concatenate([np.arange(1000, 2000), np.arange(999, 0, -1)])
    common = np.arange(len(value)) % 7
    at, low = suffix_dedup.smaller_before(value, common)
    for i in range(0, len(value), 13):
        j = next((j for j in range(i - 1, -1, -1) if value[j] < value[i]), -1)
        assert at[i] == j and low[i] == (common[j + 1 : i + 1].min())


def test_repeats_return_texts_and_spans(corpus, odd):
    docs = corpus(60)
    raw = {k: x.encode() for k, x in texts(docs).items()}
    want = brute_bytes(texts(docs), 20)
    for keep_first in (False, True):
        for r in suffix_dedup.remove_repeated_strings(docs, 20, 8, keep_first=keep_first).collect():
            x, spans = raw[r.doc_id], [(s.start, s.stop) for s in r.spans]
            assert all(a < z for a, z in spans) and all(z < a for (_, z), (a, _) in zip(spans, spans[1:]))
            left = b"".join(x[a:z] for a, z in zip([0] + [z for _, z in spans], [a for a, _ in spans] + [len(x)]))
            assert bytes(r.kept) == left and hashlib.sha256(left).hexdigest() == r.kept_sha256
            assert keep_first or want[r.doc_id][3] == r.kept_sha256
    for r in substring_dedup.remove_repeated_passages(docs, 7, 2).collect():
        gone = {i for s in r.spans for i in range(s.start, s.stop)}
        assert r.kept == " ".join(w for i, w in enumerate(WORD.findall(raw[r.doc_id].decode())) if i not in gone) and len(gone) == r.n_removed
    got = suffix_dedup.remove_repeated_strings(odd, 5, 3, keep_first=True).collect()
    assert sorted(bytes(r.kept) for r in got if r.n_bytes == 11) == [b"", b"", b"", b"a b c d e f"]
