"""Texts on which polynomial hashes modulo a power of two collide: strings of two letters that differ, of the same length."""

import numpy as np
import pyarrow as pa
import pytest

from logquarry.llm import bpe, common, near_dedup, substring_dedup, suffix_dedup, token_counts, token_output
from logquarry.llm.queries import tokenizer

from test_dedup import brute_bytes, brute_near, brute_words, texts


def pair(n, one="a", two="b"):
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(two if x else one for x in bits), "".join(one if x else two for x in bits)


@pytest.mark.parametrize("n", [1024, 4096, 8192])
def test_the_strings_collide(n):
    h = common.hash64(901)
    a, b = (np.frombuffer(x.encode(), np.uint8) for x in pair(n))
    e = np.array([n])
    assert h.ranges(h.prefix(a), e - n, e) == h.ranges(h.prefix(b), e - n, e)


@pytest.fixture
def hostile(spark):
    rows = []
    for i, n in enumerate((1024, 2048, 4096, 8192)):
        a, b = pair(n)
        rows += [(10 * i, " ".join(f"w{k}" for k in range(8)) + f" {a} " + " ".join(f"v{k}" for k in range(8))), (10 * i + 1, " ".join(f"w{k}" for k in range(8)) + f" {b} " + " ".join(f"v{k}" for k in range(8)))]
        rows += [(10 * i + 2, f"{a} " * 12), (10 * i + 3, f"{b} " * 12), (10 * i + 4, a), (10 * i + 5, b)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_repeats(hostile):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeated_passages(hostile).collect()}
    assert got == brute_words(texts(hostile), 13)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeated_strings(hostile).collect()}
    assert got == brute_bytes(texts(hostile), 200)


def test_near(hostile):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(hostile, 3, 85).collect()}
    assert got == brute_near(texts(hostile), 3, 85)


def test_tokens(hostile):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    want = {k: library.encode(x, add_special_tokens=False).ids for k, x in texts(hostile).items()}
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(hostile, tokenizer("byte_bpe_50k.json")).collect()}
    assert got == {k: len(x) for k, x in want.items()}
    ids = {}
    for r in sorted(token_output.training_order(hostile, tokenizer("byte_bpe_50k.tiktoken")).collect(), key=lambda r: r.part):
        ids.setdefault(r.doc_id, []).extend(np.frombuffer(r.tokens, "<u2")[: r.n_tokens].tolist())
    assert ids == {k: x + [50256] for k, x in want.items()}


def test_words_of_a_slice():
    t = next(common.slices(pa.array(["A b\x0bC\x1cd", None, "é  ü"], pa.large_string())))
    words, off = common.split_words(t)
    assert words == [b"A", b"b", b"C\x1cd", "é".encode(), "ü".encode()] and off.tolist() == [0, 3, 3, 5]
    assert isinstance(bpe.Encoder(tokenizer("byte_bpe_50k.json")).size, int)
