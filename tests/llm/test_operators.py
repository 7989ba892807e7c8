import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logquarry.llm import bpe, common, decontamination, langid, mixing, quality, token_counts, token_output
from logquarry.llm.queries import tokenizer

ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


def test_decontamination(spark, corpus):
    docs = corpus()
    rows = {r.doc_id: r.text for r in docs.collect()}
    items = [(1, " ".join(rows[6].split()[100:140]).upper()), (2, "A, b!"), (3, None), (4, ""), (5, " ".join(rows[7].split()[:12]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for k, t in items:
        w = ITEM.findall(lower(t))
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(k))
    want = {}
    for k, t in rows.items():
        w = ITEM.findall(lower(t))
        hit, found = [False] * len(w), set()
        for win, ids in windows.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit[i : i + len(win)] = [True] * len(win)
                    found |= ids
        want[k] = (len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontamination.contamination(docs, bench).collect()}
    assert got == want and sum(x[4] for x in want.values()) > 1
    clean = decontamination.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not x[4] for x in want.values())
    cut = {r.doc_id: r.text for r in decontamination.decontaminate(docs, bench, remove="spans").collect()}
    assert len(ITEM.findall(lower(cut[6]))) == want[6][0] - want[6][1] and cut[8] == rows[8]
    assert decontamination.contamination(docs, bench.where("false")).where("contaminated").count() == 0


def test_decontamination_odd(spark, odd):
    bench = spark.createDataFrame([(None, "B c d"), (7, "b c"), (7, "b c"), (8, None)], "item_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id, r.n_words, r.n_hit, r.n_items) for r in decontamination.contamination(odd, bench).collect())
    assert got == [(False, 1, 6, 3, 1), (False, 1, 6, 3, 1), (False, 2, 3, 0, 0), (False, 2, 6, 3, 1), (False, 3, 0, 0, 0), (True, None, 6, 3, 1)]
    assert sorted(r.text or "" for r in decontamination.decontaminate(odd, bench).collect()) == ["", "other text here"]
    kept = decontamination.decontaminate(odd.where("doc_id = 1").withColumn("text", F.lit("A b C-d E")), bench, remove="spans").collect()
    assert {r.text for r in kept} == {"A  - E"}


def test_decontamination_in_blocks(spark, corpus, monkeypatch):
    docs = corpus(48)
    t = {r.doc_id: r.text for r in docs.collect()}
    bench = spark.createDataFrame([(i, " ".join((t[6] if i % 2 else t[18]).split()[i * 20 : i * 20 + 15])) for i in range(20)], "item_id long, text string")
    whole = sorted(map(tuple, decontamination.contamination(docs, bench).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 600)
    assert sorted(map(tuple, decontamination.contamination(docs, bench).collect())) == whole


def fill(sizes, weights, cap=3):
    """Targets by repeated sharing."""
    total, target = sum(sizes), [0.0] * len(sizes)
    free, left = set(range(len(sizes))), float(sum(sizes))
    while free:
        w = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / w > cap * sizes[i]]
        if not over:
            for i in free:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = float(cap * sizes[i])
            left -= target[i]
            free.discard(i)
    assert total == 0 or abs(sum(target) - total) < 1e-6 * total
    return target


def test_mixing(spark, corpus):
    docs = corpus(400)
    plan = mixing.mix_plan(docs).collect()
    assert len(plan) == 400 and sorted(map(tuple, plan)) == sorted(map(tuple, mixing.mix_plan(docs).collect()))
    src = {r.doc_id: r.source for r in docs.collect()}
    names = sorted({s for s in src.values() if s is not None}) + [None]
    sizes = [sum(r.size for r in plan if src[r.doc_id] == s) for s in names]
    want = dict(zip(names, fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])))
    for r in plan:
        assert abs(r.target - want[src[r.doc_id]]) < 1e-6 and r.taken in (0, r.size, 2 * r.size, 3 * r.size)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in plan)
    assert mixing.mix_plan(docs.where("false")).count() == 0


def test_mixing_odd(odd):
    plan = mixing.mix_plan(odd).collect()
    assert sorted((r.doc_id or 0, r.size) for r in plan) == [(0, 6), (1, 6), (1, 6), (2, 3), (2, 6), (3, 0)]
    assert len({r.copies for r in plan if r.doc_id == 1}) == 1


def test_mixing_caps(spark):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(5, "a"), (5, "a"), (300, "b"), (40, "c"), (0, "d"), (2, None)])]
    plan = mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    got = {r.doc_id: r.target for r in plan}
    assert [round(got[i], 6) for i in (0, 2, 3, 4, 5)] == [round(x, 6) for x in fill([10, 300, 40, 0, 2], [5, 2, 1, 5, 2])]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))


def test_token_counts_on_hostile_texts(library):
    rng = random.Random(1)
    alphabet = [*"ab's'tre vell \n\t  é1２!漢😀-́\x85\x1c", "<|endoftext|>", "'s", "'ll", "  ", "\r\n", "word ", "don't "]
    enc = bpe.Encoder(tokenizer("byte_bpe_50k.json"))
    assert enc.forward and enc.special == ["<|endoftext|>"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(1500)]
    want = [len(e) for e in library.encode_batch(texts, add_special_tokens=False)]
    for chunk in (5, 12, 100):
        assert token_counts.count(enc, texts, chunk) == want


def test_resynchronisation_widens(library):
    text = "a" * 5000 + " " + "b " * 3000
    enc = bpe.Encoder(tokenizer("byte_bpe_50k.json"))
    parts = list(token_counts.chunk_counts(enc, text, 64, 4))
    assert len(parts) > 3 and sum(n for _, _, n in parts) == len(library.encode(text, add_special_tokens=False).ids)
    assert parts[0][0] == 0 and parts[-1][1] == len(text) and [p[0] for p in parts[1:]] == [p[1] for p in parts[:-1]]


@pytest.mark.parametrize("pattern, forward", [(r"\p{N}{1,3}|\s*[\r\n]+|[^\r\n\p{L}\p{N}]?\p{L}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", True), (r"(?<=a)b+|\s+|\S", False)])
def test_token_counts_with_another_splitting_rule(tmp_path, pattern, forward):
    import json

    from tokenizers import Tokenizer

    spec = json.load(open(tokenizer("byte_bpe_50k.json")))
    split = {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False}
    spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [split, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
    (tmp_path / "other.json").write_text(json.dumps(spec))
    enc, library = bpe.Encoder(str(tmp_path / "other.json")), Tokenizer.from_file(str(tmp_path / "other.json"))
    assert enc.forward == forward
    rng = random.Random(6)
    texts = ["".join(rng.choices([*"ab 12\n\t!é", "  ", "12345", "word"], k=300)) for _ in range(40)]
    assert token_counts.count(enc, texts, 40) == [len(library.encode(x, add_special_tokens=False).ids) for x in texts]


def test_token_counts_of_other_libraries():
    import sentencepiece

    texts = ["Hello  world", "", "a\nb " * 30]
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    assert token_counts.count(bpe.Encoder(tokenizer("piece_bpe_32k.model")), texts, 10) == [len(sp.encode(x)) for x in texts]
    assert not bpe.Encoder(tokenizer("word_bpe_49k.json")).forward


def test_token_counts_query(corpus, library, odd):
    docs = corpus()
    got = {r.doc_id: r for r in token_counts.count_tokens(docs, tokenizer("byte_bpe_50k.json"), chunk=500).collect()}
    for r in docs.collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_bytes, got[r.doc_id].over_limit) == (n, len((r.text or "").encode()), n > 1024)
    assert token_counts.count_tokens(odd, tokenizer("byte_bpe_50k.json")).count() == 6


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_feistel_is_a_permutation(n):
    out = token_output.feistel(np.arange(n), n, 7)
    assert sorted(out.tolist()) == list(range(n))
    assert n < 64 or not np.array_equal(out, token_output.feistel(np.arange(n), n, 8))


def test_token_output_round_trip(corpus, library, tmp_path, spark):
    docs = corpus()
    order = token_output.training_order(docs, tokenizer("byte_bpe_50k.tiktoken"), length=64, shard_rows=50)
    rows = order.collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    ids = {}
    for r in sorted(rows, key=lambda r: r.part):
        assert len(r.tokens) == 128 and (r.shard, r.row) == divmod(r.slot, 50)
        ids.setdefault(r.doc_id, []).extend(np.frombuffer(r.tokens, "<u2")[: r.n_tokens].tolist())
    for r in docs.collect():
        assert ids[r.doc_id] == library.encode(r.text or "", add_special_tokens=False).ids + [50256]
    order.write.parquet(str(tmp_path / "o"))
    rest = token_output.resume(str(tmp_path / "o"), spark, 10).collect()
    assert sorted(r.slot for r in rest) == list(range(10, len(rows)))
    # files of equal stride, read from a byte offset
    n = token_output.write_shards(order, str(tmp_path / "shards"))
    files = sorted((tmp_path / "shards").glob("shard-*.bin"))
    assert n == len(rows) and len(files) == -(-n // 50) and all(f.stat().st_size == 50 * 128 for f in files[:-1])
    by_slot = [bytes(r.tokens) for r in sorted(rows, key=lambda r: r.slot)]
    for slot in (0, 49, 50, 73, n - 1, n):
        assert [x.tobytes() for x in token_output.read_shards(str(tmp_path / "shards"), slot)] == by_slot[slot:]
    assert token_output.training_order(docs.where("false"), tokenizer("byte_bpe_50k.tiktoken")).count() == 0


def test_token_output_does_not_depend_on_splits(corpus, odd, monkeypatch):
    path = tokenizer("byte_bpe_50k.tiktoken")
    monkeypatch.setattr(token_output, "NUMBERED", 16)
    for docs, most in ((corpus(), 16), (odd, 7)):
        got = [sorted((r.slot, r.doc_id, r.part, bytes(r.tokens)) for r in token_output.training_order(docs.repartition(k), path, length=16).collect()) for k in (2, 5, most)]
        assert got[0] == got[1] == got[2] and len(got[0]) >= docs.count()


def test_token_output_refuses_narrow_ids(corpus):
    with pytest.raises(ValueError):
        token_output.training_order(corpus(12), tokenizer("byte_bpe_50k.tiktoken"), end=70000)
    wide = token_output.training_order(corpus(12), tokenizer("byte_bpe_50k.tiktoken"), end=70000, width=4, length=8).collect()
    assert any(np.frombuffer(r.tokens, "<u4").max() == 70000 for r in wide)


def labelled(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(["the", "quick", "brown", "fox", "jumps", "over", "lazy", "dogs", "and", f"word{rng.randrange(500)}"]) for _ in range(rng.randint(20, 150))]
        good = i % 4 != 0
        text = " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words[:5] * 8) if i % 8 else " ".join(w + "$$#" for w in words)
        rows.append((i, text, "x", "en"))
        labels.append((i, int(good), 0))
    docs = spark.createDataFrame(rows + [(1000, None, "x", "en"), (1001, "", None, None)], "doc_id long, text string, label string, quality string")
    return docs, spark.createDataFrame(labels + [(None, 1, 0), (5000, 0, 0), (1, None, None)], "doc_id long, quality int, toxic int")


def test_quality_held_out(spark):
    docs, labels = labelled(spark)
    got = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    assert len(got) == 402
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i in got if got[i].held_out} == {i for i in got if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([got[i].predicted == (i % 4 != 0) for i in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got.values())
    assert quality.score_quality(docs.where("false"), labels).count() == 0
    twice = docs.where("doc_id < 40").union(docs.where("doc_id < 40")).union(docs.where("doc_id < 40").withColumn("doc_id", F.lit(None).cast("long")))
    assert len(quality.score_quality(twice, labels).collect()) == 120 and quality.keep_good(twice, labels).count() % 3 == 0
    assert quality.score_quality(docs, labels.where("false")).count() == 402


def test_language_held_out(spark):
    rng = random.Random(3)
    parts = {"en": ["the", "ing", "tion", "and", "er"], "de": ["sch", "ung", "ein", "keit", "ich"], "fr": ["eau", "oi", "ment", "aux", "que"]}
    rows = []
    for i in range(300):
        lang = list(parts)[i % 3]
        rows.append((i, " ".join("".join(rng.choices(parts[lang], k=2)) for _ in range(rng.randint(3, 60))), lang if i % 7 else None, "s"))
    rows += [(900, None, "en", "s"), (901, "12 !?", "en", "s"), (902, "", None, None), (None, "the and", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in langid.detect(docs).collect()}
    assert [got[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3 and len(got) == 304
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in held) for i in range(300))
    assert np.mean([got[i].lang_pred == list(parts)[i % 3] for i in held]) > 0.95
    assert langid.detect(docs.where("doc_id < 20"), reject=1.1).where("lang_pred <> 'und'").count() == 0
    assert langid.detect(docs.where("false")).count() == 0
    assert langid.detect(docs.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0


def test_slices_keep_documents_whole():
    col = pa.array(["a" * 10, None, "", "b" * 25, "c"])
    got = [(t.rows, [t.text(i) for i in range(t.n)]) for t in common.slices(col, 12)]
    assert [x for _, part in got for x in part] == [b"a" * 10, b"", b"", b"b" * 25, b"c"] and got[-1][0][1] == 5
    assert [t.n for t in common.slices(col.slice(3), 12)] == [1, 1]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    docs, labels = labelled(spark)
    docs = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("doc_id") % 3).alias("source"), F.length("text").cast("long").alias("n_chars"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, docs.where("doc_id = 5").first().text)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    seen = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, step in p.STAGES:
        new = step(spark, seen, str(tmp_path))
        ids = {r.doc_id for r in new.select("doc_id").collect()}
        if name != "token_output":
            assert new.columns == docs.columns
        if name == "quality":
            assert {i for i in range(400) if i % 4} <= ids and not {i for i in range(400) if i % 8 == 4} & ids
        if name == "decontamination":
            assert 5 not in ids
        seen = common.stage(new, name)
    assert [n for n, _ in p.STAGES] == ["quality", "near_dedup", "decontamination", "mixing", "token_output"]
