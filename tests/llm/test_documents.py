"""Near duplicates, decontamination and encoding against brute force; the pipeline on small tables."""
import hashlib
import math
import random

import brute
import numpy as np
import public_tokenizers
import pytest
from data import DOCS, documents, prose
from tokenizers import Tokenizer

import corpus_pipeline
from logcase.llm import bpe_chunks, decontaminate, near_dup
from logcase.llm.components import components
from logcase.llm.fm_index import FMIndex

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(100, 140)] + [(200, k) for k in range(201, 240)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(35)]
    top = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            top[a] = top[b] = min(top[a], top[b])
    want = {x: c for x, c in top.items() if any(x in e and e[0] != e[1] for e in edges)}
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


@pytest.mark.parametrize("block", [256, 4])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)  # small blocks deal one bucket to many
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted(((d, *x) for (d, _), x in zip(rows, brute.near_dup(rows))), key=str)
    left = near_dup.drop_near_duplicates(docs)
    assert left.dtypes == docs.dtypes
    assert left.count() == sum(k for *_, k in got)


def test_near_duplicates_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(140)]
    rows = []
    for d in range(150):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6])):
            w[rng.randrange(140)] = f"n{rng.randrange(10 ** 6)}"
        rows.append((d * 3, " ".join(w)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(docs).collect()}
    assert got == {d: x for (d, _), x in zip(rows, brute.near_dup(rows))}


def test_near_duplicates_rows_of_one_id(spark):
    rng = random.Random(3)
    a, b, c = (prose(rng, 50) for _ in range(3))
    rows = [(5, a), (5, b), (7, a), (9, b), (3, c), (9, c), (4, "")]
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {5: 3, 7: 3, 9: 3, 3: 3, 4: 4}
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert near_dup.near_duplicates(empty).collect() == []


def test_needed_matches_miss_less_than_promised():
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    for union in (1, 2, 3, 4, 5, 8, 12, 20, 37, 64, 100, 170, 333, 600, 2000, 30_000):
        common = -(-3 * union // 4)  # the fewest that link
        for seen in sorted({1, 2, 5, 17, 64, 128, 200, 300, 512, union, union - 1, union * 9 // 10} - {0}):
            if seen > min(union, near_dup.BINS):
                continue
            need = int(near_dup.needed_matches(np.array([seen]), np.array([union + common]))[0])
            low = max(0, seen - (union - common))
            miss = sum(math.exp(choose(common, m) + choose(union - common, seen - m) - choose(union, seen)) for m in range(low, min(need, common + 1)))
            assert miss <= near_dup.MISS, (union, seen, need, miss)
    assert near_dup.needed_matches(np.array([160]), np.array([280]))[0] >= 0.74 * 160 - 1  # the whole union was seen


def test_miss_probability_is_chosen():
    """The bound is the exact least number of matches for each miss probability: one match fewer is below it."""
    choose = math.comb
    for union, seen in ((8, 5), (16, 16), (32, 20), (512, 64), (512, 300)):
        total, marked = union + 3 * union // 4, 3 * union // 4
        tail, weights = 0.0, [choose(marked, m) * choose(union - marked, seen - m) / choose(union, seen) for m in range(seen + 1)]
        for m, w in enumerate(weights):
            tail += w
            if tail > 0.5:
                break
            miss = tail * 1.0001  # below it with m matches, not with one more
            if 1e-12 < tail and sum(weights[:m + 2]) > miss:
                assert near_dup.needed_matches(np.array([seen]), np.array([total]), miss)[0] == m + 1
    seen, total = np.arange(1, 513), np.full(512, 10_000_000)
    strict, usual, loose = (near_dup.needed_matches(seen, total, miss) for miss in (1e-9, near_dup.MISS, 1e-2))
    assert (strict <= usual).all() and (usual <= loose).all() and (strict < loose).sum() > 490
    # binomial of an endless union, at 64 of its elements
    tails = np.cumsum([choose(64, m) * 0.75**m * 0.25**(64 - m) for m in range(65)])
    assert usual[63] == int((tails < near_dup.MISS).sum())


def test_fm_index():
    rng = random.Random(3)
    for n in (1, 2, 30, 400):
        for sigma in (2, 5, 40):
            text = np.array([rng.randrange(1, sigma) for _ in range(n)])
            index = FMIndex(text, sigma, rng.choice([1, 4, 16]))
            for size in (1, 2, 4):
                patterns = np.array([[rng.randrange(1, sigma) for _ in range(size)] for _ in range(12)])
                which, place = index.occurrences(patterns)
                want = [(i, k) for i in range(12) for k in range(n - size + 1) if (text[k:k + size] == patterns[i]).all()]
                assert sorted(zip(which.tolist(), place.tolist())) == want


def leak_case(spark):
    rng = random.Random(8)
    items = [(k, prose(rng, rng.choice([3, 9, 10, 11, 40]), 60)) for k in range(30)] + [(30, None), (31, ""), (31, "!!"), (0, prose(rng, 14, 60)), (None, prose(rng, 12, 60))]
    texts = [None, "", "...", *(prose(rng, 400, 60) for _ in range(4)), prose(rng, 9000, 60)]
    texts += [f"{prose(rng, 20)} {items[k][1].upper()}! {prose(rng, 5)}" for k in range(12)] * 2
    rows = [(i, t, "en", None, 3, "b", "k", 1, "s", 2, "x") for i, t in enumerate(texts)] + [(None, texts[9], *[None] * 9)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame([(*x, "z") for x in items], "item_id bigint, text string, found string"), items


@pytest.mark.parametrize("block,shard", [(1 << 26, 1 << 20), (400, 64)])
def test_leaks(spark, monkeypatch, block, shard):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard)
    docs, benchmark, items = leak_case(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate.leak_report(docs, benchmark).collect()]
    want = [(d, *x, x[1] > 0) for (d, _), x in zip(rows, brute.leaks(rows, items))]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(w[2] for w in want)


def test_leaks_removed(spark):
    docs, benchmark, items = leak_case(spark)
    left = decontaminate.remove_leaks(docs, benchmark)
    assert left.dtypes == docs.dtypes and left.count() == docs.count()
    for r in left.where("doc_id > 7").collect():
        text = docs.where(docs.doc_id == r["doc_id"]).first()["text"]
        hit = brute.leaks([(0, text)], items)[0][1]
        assert len(brute.LEAK_WORD.findall(r["text"])) == len(brute.LEAK_WORD.findall(text)) - hit
        assert r["n_chars"] == (len(r["text"]) if hit else 3)
    none = spark.createDataFrame([], benchmark.schema)
    assert {r["n_hit"] for r in decontaminate.leak_report(docs, none).collect()} == {0}
    assert decontaminate.leak_report(spark.createDataFrame([], DOCS), benchmark).collect() == []


def encoded(text):
    ids = TOKENIZER.encode(text or "", add_special_tokens=False).ids
    return np.array(ids, "<u4").tobytes(), TOKENIZER.decode(ids, skip_special_tokens=False)


TOKENIZER = Tokenizer.from_file(VOCABULARY)


def odd_texts():
    rng = random.Random(6)
    bits = ["a", "B", "1", " ", "  ", "\n", "'s", "'LL", "é", "日", " x", " ", "<|endoftext|>", "<|endof", "!", "|", "\U0001F600", "\t", "word", "ing ", "\x85", " "]
    return ["".join(rng.choices(bits, k=rng.randrange(1, 3000))) for _ in range(30)] + ["日本語" * 900, "x" * 40000, " " * 9000 + "a", "a b " * 9000, "é " * 9000]


def test_encoding_is_exact(spark):
    docs = documents(spark)
    both = bpe_chunks.decode_documents(bpe_chunks.encode_documents(docs, VOCABULARY), VOCABULARY)
    got = sorted(((r["row"]["doc_id"], bytes(r["ids"]), r["decoded"]) for r in both.collect()), key=str)
    assert got == sorted(((r["doc_id"], *encoded(r["text"])) for r in docs.collect()), key=str)
    assert bpe_chunks.token_counts(spark.createDataFrame([], DOCS), VOCABULARY).collect() == []


@pytest.mark.parametrize("least,mask", [(512, 0xFFE0), (8, 0x00E0), (1, 0x0060)])
def test_joins_are_repaired(monkeypatch, least, mask):
    monkeypatch.setattr(bpe_chunks, "MIN_CHUNK", least)
    monkeypatch.setattr(bpe_chunks, "CUT_MASK", np.uint16(mask))
    encoder = bpe_chunks.ChunkEncoder(bpe_chunks.Vocabulary(*bpe_chunks.read_vocabulary(VOCABULARY)), cache_bytes=1 << 16)
    for text in odd_texts()[:: 1 if least > 1 else 4]:
        data = np.frombuffer(text.encode(), np.uint8)
        ids = encoder.encode(text.encode(), bpe_chunks.rolling_cuts(data), bpe_chunks.safe_places(data))
        assert (ids.astype("<u4").tobytes(), encoder.vocabulary.decode(ids)) == encoded(text)
    again = encoder.reused
    encoder.encode(text.encode(), bpe_chunks.rolling_cuts(data), bpe_chunks.safe_places(data))
    assert encoder.reused > again


def test_decoding_of_any_ids():
    vocabulary = bpe_chunks.Vocabulary(*bpe_chunks.read_vocabulary(VOCABULARY))
    ids = np.array([50256, 128, 129, 255, 300, 7], np.uint32)
    assert vocabulary.decode(ids) == TOKENIZER.decode(ids.tolist(), skip_special_tokens=False)


def test_pipeline(spark, tmp_path):
    """Every stage on what its predecessor kept, against the brute-force versions."""
    rng = random.Random(12)
    items = [(k, prose(rng, 25)) for k in range(3)]
    line = prose(rng, 10)
    texts = ["\n".join(prose(rng, 20) for _ in range(5)) for _ in range(12)]
    texts += [texts[0], texts[1].replace("w1", "x1"), texts[2] + "\n" + line, texts[3] + "\n" + line, texts[4] + "\n" + line, prose(rng, 40) + " " + items[0][1] + " " + prose(rng, 40)]
    texts += [None, "", "too short", " | ".join(prose(rng, 90).split(" "))]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS.split(", body")[0]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    good = [(i, t) for i, t, *_ in rows if t and not brute.quality(t)[5] and " | " not in t]
    good = [(i, x[2]) for (i, _), x in zip(good, brute.line_dedup(good))]
    good = [r for r, x in zip(good, brute.near_dup(good)) if x[2]]
    want = {}
    for i, t in good:
        for _, item in items:
            t = t.replace(item.rstrip(".,"), "")
        ids, text = encoded(t)
        want[i] = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    got = {r["doc_id"]: tuple(r)[1:] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want
    assert len(good) < 17 and [name for name, _ in corpus_pipeline.STAGES][2] == "near duplicates"
