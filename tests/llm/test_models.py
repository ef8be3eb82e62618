"""Held-out accuracy and edge cases of the two classifiers."""
import random

import pytest
from data import DOCS, documents, prose

from logcase.llm import quality_model, toxicity


def labelled(spark, make, n=260):
    rng = random.Random(11)
    rows = [(k, make(rng, k % 4 == 0), k % 4 == 0) for k in range(n)]
    docs = spark.createDataFrame([(d, t, "x", 0.5) for d, t, _ in rows], "doc_id bigint, text string, label string, score double")
    labels = spark.createDataFrame([(d, int(y)) for d, _, y in rows if d < n // 2] + [(0, 7), (1, None)], "doc_id bigint, label int")
    return docs, labels, {d: int(y) for d, _, y in rows}


def junk_or_prose(rng, good):
    w = prose(rng, rng.randrange(40, 300)).split(" ")
    return " ".join(w) if good else rng.choice(["### ", "!! ", " | "]).join(w)


def test_quality(spark):
    docs, labels, truth = labelled(spark, junk_or_prose)
    stats = quality_model.measured(docs)
    model = quality_model.fit(stats.join(labels, "doc_id"))
    assert quality_model.Discriminant.from_json(model.to_json()).offset == model.offset
    out = quality_model.score(stats, model).collect()
    held = [r for r in out if r["doc_id"] >= 130]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)


def insult_or_prose(rng, bad):
    w = prose(rng, rng.randrange(40, 300)).split(" ")
    for _ in range(rng.randrange(2, 5) if bad else 0):
        w.insert(rng.randrange(len(w)), rng.choice(["numpty", "pillock", "wazzock", "dunderhead"]) + rng.choice(["", ".", "s"]))
    return " ".join(w)


def test_toxicity(spark):
    docs, labels, truth = labelled(spark, insult_or_prose)
    grammar = toxicity.fit(docs, labels)
    assert any(s.startswith("num") for s in grammar.stems)
    assert toxicity.Grammar.from_json(grammar.to_json()).stems == grammar.stems
    out = toxicity.score(docs, grammar).collect()
    held = [r for r in out if r["doc_id"] >= 130]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_clauses_are_read_not_words():
    read = lambda text: dict(zip(toxicity.EVIDENCE, toxicity.Reader({"idiot": 2.0}).sums(text)))
    assert read("An idiot went.")["plain"] == 2 and read("You are an IDIOT!")["aimed"] == 2
    assert read("not an idiot")["negated"] == 2 and read("he said you idiots")["reported"] == 2
    assert read("You left. An idiot came")["plain"] == 2  # the target is in another clause
    assert read("I will kill you")["threat"] == read("you, I kill you")["threat"] == 1 and read("They kill time")["threat"] == 1
    assert read("we kill time")["threat"] == 0 and read("")["n_words"] == 0
    assert read("idiot " * 3 + "x" * 3_000_000)["plain"] == 6
    assert read("idiot, idiot. fine")["clauses"] == 2


@pytest.mark.parametrize("labels", [[], [(0, 1)], [(0, 0), (1, 0)]])
def test_one_class_or_none(spark, labels):
    docs = documents(spark)
    table = spark.createDataFrame(labels, "doc_id bigint, label int")
    want = float(labels[0][1]) if labels else 0.0
    stats = quality_model.measured(docs)
    for out in (quality_model.score(stats, quality_model.fit(stats.join(table, "doc_id"))), toxicity.score(docs, toxicity.fit(docs, table))):
        scores = [r["score"] for r in out.collect()]
        assert len(scores) == docs.count() and set(scores) == {want}


def test_difficult_texts(spark):
    docs = documents(spark)
    table = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id bigint, label int")
    stats = quality_model.measured(docs)
    for out in (quality_model.score(stats, quality_model.fit(stats.join(table, "doc_id"))), toxicity.score(docs, toxicity.fit(docs, table))):
        scores = [r["score"] for r in out.collect()]
        assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)
    empty = spark.createDataFrame([], DOCS)
    assert quality_model.score(quality_model.measured(empty), quality_model.Discriminant(constant=0.0)).collect() == []
    assert toxicity.score(empty, toxicity.Grammar(constant=0.0)).collect() == []


def test_repeated_label_rows_count_once(spark, monkeypatch):
    """However often a label row is repeated, the sample holds both classes and the scores stay the same."""
    monkeypatch.setattr(toxicity, "FIT_ROWS", 400)
    rows = [(i, ("you are a complete idiot " if i % 2 else "a quiet walk by the river ") + f"word{i}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id bigint, label int")
    scores = lambda table: {r["doc_id"]: round(r["score"], 9) for r in toxicity.score(docs, toxicity.fit(docs, table)).collect()}
    once = scores(labels)
    assert scores(labels.crossJoin(spark.range(300)).drop("id")) == once
    assert all((s >= 0.3) == (i % 2 == 1) for i, s in once.items())
