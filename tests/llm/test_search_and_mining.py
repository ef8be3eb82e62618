"""Embedding near-duplicates, ranked search and phrase mining against brute force on difficult small tables."""
import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from data import DOCS, documents, prose

from logcase.llm import embedding_dup, lexical_search, phrase_mining

VECTORS = "vec_id bigint, embedding array<float>, label int, node bigint, vector string, links int, kept string"


def brute_links(rows):
    """(n_links, component) of each row (id, vector, label), every pair compared."""
    def usable(r):
        return r[0] is not None and r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])
    unit = [np.array(r[1], float) / np.linalg.norm(np.array(r[1], float)) if usable(r) else None for r in rows]
    near = [[j for j, v in enumerate(unit) if j != i and u is not None and v is not None and rows[i][2] == rows[j][2]
             and len(u) == len(v) and float(u @ v) >= 0.98] for i, u in enumerate(unit)]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((len(near[i]), min((rows[j][0] for j in seen), default=None) if rows[i][0] is not None else None))
    return out


def vectors(seed=3, n=260, width=16):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, width))
    rows = []
    for k in range(n):
        v = centres[rng.integers(12)] + rng.standard_normal(width) * rng.choice([0.05, 0.12, 0.2, 0.6])
        rows.append((int(rng.permutation(5 * n)[0]) * 10 + k % 10, [float(np.float32(x)) for x in v], int(rng.integers(3))))
    rows = [(i * 7, v, label) for i, (_, v, label) in enumerate(rows)]
    rng.shuffle(idx := list(range(len(rows))))
    rows = [rows[i] for i in idx]
    first = rows[0]
    rows += [(5001 + k, first[1], first[2]) for k in range(30)]  # copies
    rows += [(6000, [4 * x for x in first[1]], first[2]), (6001, first[1], None), (6002, None, 1), (6003, [], 1), (6004, [0.0] * width, 1),
             (6005, [None] + first[1][1:], first[2]), (6006, [math.nan] + first[1][1:], first[2]), (6007, [math.inf] + first[1][1:], first[2]),
             (6008, first[1] + [0.0], first[2]), (6009, first[1] + [0.0], first[2]), (None, first[1], first[2]), (first[0], first[1], first[2]),
             (6010, [-0.0, 1.0], 2), (6011, [0.0, 1.0], 2), (6012, [1e-30, 0.0], 2), (6013, [1e30, 0.0], 2)]
    return rows


@pytest.mark.parametrize("block", [2048, 8])
def test_embedding_links(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dup, "BLOCK", block)
    rows = vectors()
    table = spark.createDataFrame([(*r, 1, "v", 2, "k") for r in rows], VECTORS).repartition(3)
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dup.near_duplicates(table).collect()), key=str)
    want = sorted(((r[0], n, c, r[0] == c) for r, (n, c) in zip(rows, brute_links(rows))), key=str)
    assert sum(w[1] for w in want) > 1000
    assert got == want
    assert embedding_dup.drop_near_duplicates(table).columns == table.columns


def test_embedding_tables_without_rows_or_links(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert embedding_dup.near_duplicates(empty).collect() == []
    alone = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, None, 1), (None, None, None)], "vec_id bigint, embedding array<float>, label int")
    assert sorted(tuple(r) for r in embedding_dup.near_duplicates(alone).where("vec_id is not null").collect()) == [(1, 0, 1, True), (2, 0, 2, True)]


@pytest.mark.parametrize("width, n, classes", [(64, 400, 10 ** 4), (64, 400, 10 ** 9), (20, 300, 10 ** 6)])
def test_any_rotation_meets_every_link_once(width, n, classes):
    """Whatever rotation and table width, both sides of a link enter a common bucket in which it counts, once."""
    rng = np.random.default_rng(width + n)
    base = rng.standard_normal((n, width))
    x = np.concatenate([base, base + rng.standard_normal((n, width)) * 0.19 * np.linalg.norm(base, axis=1, keepdims=True) / math.sqrt(width)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = {(i, j) for i, j in zip(*np.nonzero(x @ x.T >= embedding_dup.COSINE)) if i < j}
    rotation = embedding_dup.Rotation.fit(x[:50], turns=3)
    z = rotation(x)
    code, cost = embedding_dup.codes(z), embedding_dup.costs(z)
    tables = embedding_dup.Tables(z.shape[1], classes)
    found = Counter()
    for t in range(len(tables.cuts) - 1):
        rows, masks = tables.flips(cost, t)
        bucket = (code[rows] ^ masks) & tables.masks[t]
        order = np.lexsort((rows, bucket))
        rows, masks, bucket = rows[order], masks[order], bucket[order]
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        for a, b in zip(starts, [*starts[1:], len(rows)]):
            if b - a > 1:
                i, j = np.triu_indices(b - a, 1)
                members = rows[a:b]
                good = embedding_dup.linked(i, j, np.full(b - a, t), masks[a:b], code[members], cost[members], x[members], tables, embedding_dup.COSINE)
                found.update(zip(members[i[good]].tolist(), members[j[good]].tolist()))
    assert len(links) > 50
    assert set(found) == links and set(found.values()) == {1}


def test_learned_codes_are_balanced_and_cheaper_than_unlearned():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 32)) @ rng.standard_normal((32, 32)) + 2
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    learned, start = (embedding_dup.Rotation.fit(x, turns)(x) for turns in (embedding_dup.TURNS, 0))
    assert np.abs((learned >= 0).mean(0) - 0.5).max() < 0.2
    tables = embedding_dup.Tables(32, len(x))
    n_flips = [sum(len(tables.flips(embedding_dup.costs(z), t)[0]) for t in range(len(tables.cuts) - 1)) for z in (learned, start)]
    assert n_flips[0] <= n_flips[1]


def brute_terms(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if ("0" <= c <= "9") or ("a" <= c <= "z") or ("A" <= c <= "Z") or ord(c) >= 0x80:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
        elif word:
            out.append(word)
            word = ""
    return out


def brute_search(docs, items, top=10):
    texts = [(d, brute_terms(t)) for d, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in texts), sum(len(w) for _, w in texts)
    df = Counter(t for _, w in texts for t in set(w))
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(brute_terms(t))
    out = []
    for i, query in asked.items():
        scores = []
        for d, w in texts:
            tf, m = Counter(w), 100 - 90 + (90 * len(w) * n_docs) // max(n_terms, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in query if tf[t])
            if s > 0:
                scores.append((-s, math.inf if d is None else d))
        out += [(i, k + 1, None if d == math.inf else d, -s) for k, (s, d) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_terms, block_terms", [(1 << 21, 2_000_000), (60, 7)])
def test_search(spark, monkeypatch, shard_terms, block_terms):
    monkeypatch.setattr(lexical_search, "SHARD_TERMS", shard_terms)
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", block_terms)
    monkeypatch.setattr(lexical_search, "_SLICE", 1000)
    rng = random.Random(8)
    rows = [(d, t) for d, t in ((r["doc_id"], r["text"]) for r in documents(spark).collect())]
    rows += [(1000 + k, " ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 40)))) for k in range(150)]
    rows += [(2000 + k, "tie tie break") for k in range(25)]
    docs = spark.createDataFrame([(*r, "x", 1, "t") for r in rows], "doc_id bigint, text string, term string, shard int, ids string").repartition(3)
    asked = [("q1", "A b, c"), ("q2", "tie!"), ("q3", None), ("q4", ""), ("q5", "unknown-word zz"), ("q6", prose(rng, 60)), ("q7", "a b c d e f g h aa bb cc"),
             ("q8", "W1 w2 w3 again é 日本"), ("q1", "d"), ("q2", "tie!"), (None, "break hh")]
    items = spark.createDataFrame([(*a, 3, "z") for a in asked], "item_id string, text string, doc_id int, score string")
    got = lexical_search.search(lexical_search.build_index(docs), items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["rank"] == "int"
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_search(rows, asked)


def test_search_in_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([("a", "one two")], "item_id string, text string")
    assert lexical_search.search(lexical_search.build_index(none), items).collect() == []
    docs = spark.createDataFrame([(1, "one two"), (2, "...")], "doc_id bigint, text string")
    index = lexical_search.build_index(docs)
    assert lexical_search.search(index, items.where("item_id = 'b'")).collect() == []
    assert [tuple(r)[:3] for r in lexical_search.search(index, items).collect()] == [("a", 1, 1)]


def test_pair_bounds_skip_more_and_lose_nothing():
    """Terms that rarely stand together: their pair bound is far below the sum of their single ones."""
    rng = np.random.default_rng(2)
    n_docs, lists = 20_000, []
    of = rng.integers(0, 12, n_docs)
    for t in range(12):
        places = np.flatnonzero(of == t) if t < 10 else np.sort(rng.choice(n_docs, 300, replace=False))
        lists.append((places, rng.integers(1, 60 if t < 10 else 320, len(places)) * 1000))
    with_pairs, without = (lexical_search.Shard(lists, n_docs) for _ in range(2))
    whole = np.zeros(n_docs, np.int64)
    for p, x in lists:
        whole[p] += x
    want = sorted(whole.tolist(), reverse=True)[:10]
    for shard, use in ((with_pairs, True), (without, False)):
        places, scores = shard.search(list(range(12)), use)
        assert (whole[places] == scores).all() and sorted(scores.tolist(), reverse=True)[:10] == want
    assert with_pairs.scored["candidates"] + with_pairs.scored["lookups"] < 0.9 * (without.scored["candidates"] + without.scored["lookups"])


def brute_phrases(rows, least):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang, text = lang or "und", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\n\x0b\x0c\r":
            text = text.replace(c, "\n")
        for piece in text.split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            totals[lang] += len(w)
            for n in range(1, 6):
                for i in range(len(w) - n + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i:i + n])] += 1
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        for p, a in often.items():
            cuts = [(Fraction(1000 * a * totals[lang], f[p[:k]] * f[p[k:]]).__floor__(), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            inside = any(len(q) > len(p) and b >= a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in often.items())
            if not inside:
                out.append((lang, " ".join(p), a, left, right, totals[lang], score))
    return sorted(out)


def phrase_rows(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(30)] + ["é", "日本", "\x00", "a\x85b", "\xa0"]
    fixed = [["red", "deer", "run", "far", "away"], ["to", "be"], ["be", "to", "be"], ["x"] * 7]
    rows = []
    for k in range(250):
        w = []
        while len(w) < 60:
            w += rng.choice(fixed) if rng.random() < 0.3 else [rng.choice(vocabulary)]
        text = "".join(x + rng.choice([" "] * 8 + ["\t", ". ", ",", "\n", " ? "]) for x in w)
        rows.append((text.upper() if k % 9 == 0 else text, rng.choice(["en", "en", "de", None])))
    rows += [(None, "en"), ("", None), (" ,. ", "fr"), ("solo", "it"), ("only here " * 400, "nl"), ("rare pair " * 30 + "\n" + "rare pair of", "en")]
    return rows + rows[:40]


@pytest.mark.parametrize("rate, tokens, part", [(4, 1 << 20, 4 << 20), (1, 500, 64), (50, 3000, 300)])
def test_collocations(spark, monkeypatch, rate, tokens, part):
    """A whole sample, a usual one, and one that proposes next to nothing, so that nearly all comes from expansion."""
    monkeypatch.setattr(phrase_mining, "RATE", rate)
    monkeypatch.setattr(phrase_mining, "TOKENS", tokens)
    monkeypatch.setattr(phrase_mining.slices, "__defaults__", (part,))
    rows = phrase_rows()
    docs = spark.createDataFrame([(*r, 1, "p", 5) for r in rows], "text string, lang string, n int, phrase string, key int").repartition(3)
    want = brute_phrases(rows, 25)
    got = sorted(tuple(r) for r in phrase_mining.collocations(docs, 25).collect())
    assert len(want) > 60
    assert got == want


def test_collocations_of_an_empty_table(spark):
    assert phrase_mining.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []


def test_a_full_filter_only_adds_work(spark, monkeypatch):
    monkeypatch.setattr(phrase_mining, "MOST_BITS", 10)
    rows = phrase_rows(2)
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(tuple(r) for r in phrase_mining.collocations(docs, 20).collect()) == brute_phrases(rows, 20)
