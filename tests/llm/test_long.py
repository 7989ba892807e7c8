"""One very long text, and one without a single space, through every operator."""

import random

import pytest

from logquarry.llm import decontamination, exact_dedup, langid, mixing, near_dedup, quality, substring_dedup, suffix_dedup, token_counts, token_output
from logquarry.llm.queries import tokenizer


@pytest.fixture(scope="module")
def long_docs(spark):
    rng = random.Random(9)
    prose = " ".join(f"w{rng.randrange(50000)}" for _ in range(300_000))
    solid = "".join(rng.choices("abcdefgh", k=200_000))
    return spark.createDataFrame([(1, prose, "en", "s"), (2, solid, "en", "s"), (3, "short one", "en", None)], "doc_id long, text string, lang string, source string")


def test_every_operator(spark, long_docs):
    n = {r.doc_id: len(r.text) for r in long_docs.collect()}
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, "short one")], "item_id long, text string")
    assert {r.group_size for r in exact_dedup.exact_groups(long_docs).collect()} == {1}
    assert {r.doc_id: r.n_bytes for r in suffix_dedup.remove_repeated_strings(long_docs).collect()} == n
    assert {r.doc_id: r.n_words for r in substring_dedup.remove_repeated_passages(long_docs).collect()} == {1: 300_000, 2: 1, 3: 2}
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(long_docs).collect()} == {1: 1, 2: 2, 3: 3}
    assert {r.doc_id: r.n_items for r in decontamination.contamination(long_docs, bench).collect()} == {1: 0, 2: 0, 3: 1}
    assert quality.score_quality(long_docs, labels).count() == 3 and langid.detect(long_docs).count() == 3
    assert {r.doc_id: r.size for r in mixing.mix_plan(long_docs).collect()} == {1: 300_000, 2: 1, 3: 2}
    counts = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(long_docs.where("doc_id <> 2"), tokenizer("byte_bpe_50k.json")).collect()}
    made = token_output.training_order(long_docs.where("doc_id <> 2"), tokenizer("byte_bpe_50k.tiktoken")).groupBy("doc_id").sum("n_tokens").collect()
    assert {r[0]: r[1] - 1 for r in made} == counts
