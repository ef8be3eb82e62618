"""Line dedup, quality rules, URL rules, secret scan, chat snapshots against brute force."""
import random
import uuid

import brute
import pytest
from data import DOCS, documents, prose
from pyspark.sql import functions as F

from logcase.llm import chat_snapshots, line_dedup, quality_rules, secret_scan, url_rules


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_line_dedup(spark):
    docs = documents(spark)
    got = [(r["row"]["doc_id"], r["row"]["text"], r["n_lines"], r["n_dropped"], r["kept"]) for r in line_dedup.dedup_lines(docs).collect()]
    source = rows_of(docs)
    want = [(d, t, *x) for (d, t), x in zip(source, brute.line_dedup(source))]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(x[3] for x in want)
    cleaned = line_dedup.clean_documents(docs)
    assert cleaned.dtypes == docs.dtypes and cleaned.count() == docs.count()
    assert cleaned.where((F.col("doc_id") == 22) & (F.col("n_chars") != F.char_length("text"))).count() == 0


def test_line_dedup_same_id_other_texts(spark):
    line = "the same long line of text here"
    rows = [(1, line), (1, line + "\nx"), (2, line), (3, "y\n" + line), (3, line)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r["row"]["doc_id"], r["row"]["text"], r["n_lines"], r["n_dropped"], r["kept"]) for r in line_dedup.dedup_lines(docs).collect())
    assert got == sorted((d, t, *x) for (d, t), x in zip(rows, brute.line_dedup(rows)))


@pytest.mark.parametrize("run", [lambda d: line_dedup.clean_documents(d), lambda d: quality_rules.clean_documents(d)])
def test_empty_table(spark, run):
    empty = spark.createDataFrame([], DOCS)
    assert run(empty).collect() == [] and run(empty).dtypes == empty.dtypes


def test_quality_measures(spark):
    docs = documents(spark)
    out = quality_rules.measures(docs).collect()
    assert len(out) == docs.count()
    for r in out:
        want = brute.quality(r["row"]["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
        assert not (r["base_failed"] and r["kept"])


def test_quality_lines(spark):
    rng = random.Random(5)
    good = "\n".join(prose(rng, 30) for _ in range(4))
    nav = " | ".join(prose(rng, 15).split(" "))
    rows = [(1, good), (2, good + "\n" + nav), (3, good + "\n" + "\n".join([nav + str(i) for i in range(9)])), (4, good + "\nAccept all cookies")]
    out = {r["doc_id"]: r["text"] for r in quality_rules.clean_documents(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert out == {1: good, 2: good, 4: good}


MARKDOWN = """# Getting started

## Usage & notes
* Terms & Conditions
* short item
> A quoted line.
**Note** costs rose 5% to $20 this year, not *much* more.
***Very important***
- dash item
1. first step
Read on... and wait.
"""


def test_quality_keeps_markdown_and_cuts_marks(spark):
    rng = random.Random(6)
    clean = MARKDOWN + "\n".join(prose(rng, 30) for _ in range(30))
    keywords = " ".join(f"word{k}" for k in range(150))
    bad = ["Contents .......... 12", "Chapter . . . . . . . . . . 3", "&lt;&lt; | * home * | >>", "$$$ *** buy now", keywords, "# ### && %%"]
    good = ["keywords " + keywords[:1000].rsplit(" ", 1)[0], keywords + " 。", "a... b?! c", "12:30:15,123 at 10.0.0.1", "* **a** *b* ***c***"]
    rows = [(1, clean), (2, clean + "\n" + "\n".join(bad)), (3, clean + "\n" + "\n".join(good))]
    out = {r["doc_id"]: r["text"] for r in quality_rules.clean_documents(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert out == {1: clean, 2: clean, 3: rows[2][1]}


def test_quality_slow_way_agrees(spark, monkeypatch):
    docs = documents(spark)
    want = {(r["row"]["doc_id"], r["n_repeat_words"]) for r in quality_rules.measures(docs).collect()}
    monkeypatch.setattr(quality_rules, "PLACE_BITS", 6)  # nearly every text is too long for the places then
    assert {(r["row"]["doc_id"], r["n_repeat_words"]) for r in quality_rules.measures(docs).collect()} == want


URLS = [None, "", "no scheme", "http://", "http://Net", "http://NET/", "http://a.net/en/x", "http://example.net/en/1?q#f", "http://www.Example.NET/en/",
        "http://notexample.net/en/1", "https://example.com/de/9", "https://x.example.com/de", "https://example.com/DE/9", "ftp://b.org/fr/#x",
        "http://c.org/fr?x", "http://c.org?x=/fr/", "http://casino-win.example.org/en/1", "http://m.CASINO.example.org", "http://casinos.example.org/",
        "http://example.org/poker/1", "http://adult-x.example.net/en/5", "http://a.org/fr/poker", "http://a://b/c", "http://é.org/fr/ü", "http://x.net:80/"]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS + URLS[:6])], "page_id bigint, url string, host string")
    out = url_rules.judge_urls(pages, ("page_id",)).collect()
    assert len(out) == len(URLS) + 6
    for r in out:
        host, path, rule, verdict = brute.url((URLS + URLS)[r["page_id"]] if r["page_id"] < len(URLS) else URLS[r["page_id"] - len(URLS)])
        assert (r["host"], r["path"], r["rule"] if r["site"] else None) == (host, path, rule)
        assert verdict is None or r["verdict"] == verdict
    by = {r["page_id"]: (r["rule"], r["verdict"]) for r in out}
    assert by[16] == ("casino-win", "block") and by[17] == ("casino", "block") and by[18] == (None, "allow")
    assert by[19] == ("poker", "block") and by[20] == ("example.net/en/", "allow") and by[21] == ("org/fr/", "allow")
    assert url_rules.judge_urls(spark.createDataFrame([], pages.schema), ("page_id",)).collect() == []


def test_url_index_takes_the_rarest_literal(spark):
    urls = spark.createDataFrame([("casino.example.org/win",), ("a.example.org/win",), ("b.example.org/casino",)], "target string")
    rule = url_rules.Rule("r", "block", "x", ("casino", "win", "rare"))
    assert [r["token"] for r in url_rules.rule_index(urls, (rule,)).collect()] == ["rare"]
    rule = url_rules.Rule("r", "block", "x", ("example", "win"))
    assert [r["token"] for r in url_rules.rule_index(urls, (rule,)).collect()] == ["win"]


def token(rng, alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_secrets(spark):
    rng = random.Random(2)
    hexa, b64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    long_words = [token(rng, "eeeaaattooinnsrhld", rng.randrange(16, 60)) for _ in range(3000)]
    rows = [None, "", "password: abc", "token=token: abcdefgh", "Password = 'abc123XYZ' TOKEN=\"x\"", "é日 api_key:" + token(rng, b64, 30),
            "AKIAABCD", "xAKIA" + "AB12" * 5 + " AKIAAKIA" + "Z" * 14, token(rng, hexa, 23) + " " + token(rng, hexa, 24) + "g" + token(rng, hexa, 64),
            "secret:" + token(rng, hexa, 40) + " passwd", " ".join(long_words), "see " + token(rng, b64, 44) + " here", "1234567890123456789012345",
            "token=" * 50, "\n".join("secret=abcdef" for _ in range(300))]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(rows + rows[:8])], "doc_id int, text string, start int")
    out = secret_scan.find_secrets(docs, ("doc_id",)).collect()
    assert len(out) == len(rows) + 8
    for r in out:
        text = (rows + rows[:8])[r["doc_id"]]
        assert [tuple(s) for s in r["spans"] if s["kind"] != "random"] == brute.secrets(text)
    extra = {r["doc_id"]: [tuple(s) for s in r["spans"] if s["kind"] == "random"] for r in out}
    assert extra[11] == [(4, 48, "random")]  # random, and in no fixed pattern
    assert not extra[10] and not extra[12]
    assert secret_scan.find_secrets(spark.createDataFrame([], docs.schema), ("doc_id",)).collect() == []


def random_places(spark, texts):
    """[(row, start, end)] of the spans found by the randomness tests."""
    out = secret_scan.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), ("doc_id",)).collect()
    return sorted((r["doc_id"], s["start"], s["end"]) for r in out for s in r["spans"] if s["kind"] == "random")


B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def test_secrets_need_no_number_of_other_tokens(spark):
    rng = random.Random(3)
    # Draws with at least a digit and a mark, so that no key is of letters alone.
    keys = [token(rng, B64, 30) + "7+" for _ in range(20)]
    assert random_places(spark, ["the key is " + keys[0] + " here", "nothing in this text"]) == [(0, 11, 43)]
    plain = "how to make the best of your new garden with little work and some good water every day in summer winter after long rain".split()
    slugs = ["-".join(rng.choice(plain) for _ in range(rng.randrange(5, 8))) for _ in range(4000)]
    pages = [" ".join(slugs[i:i + 40]) for i in range(0, 4000, 40)]
    assert random_places(spark, pages + keys) == [(100 + i, 0, 32) for i in range(20)]


def test_secrets_of_letters_or_digits_alone(spark):
    rng = random.Random(4)
    lower, upper, digits = B64[26:52], B64[:26], B64[52:62]
    keys = [token(rng, a, n) for a, n in ((lower, 32), (lower, 40), (upper, 20), (upper + lower, 20), (upper + lower, 32), (digits, 20))]
    plain = ("internationalization", "Verantwortungsbewusstsein", "anticonstitutionnellement", "responsabilidades-extraordinarias", "2020/05/12/13/00",
             "================", "A===============", "-=--------------", "0000000000000000")
    assert random_places(spark, [*keys, *plain]) == [(i, 0, len(k)) for i, k in enumerate(keys)]
    # One of 28 tokens of 16 characters has letters alone; the tests themselves reject up to 1 % of random tokens.
    short = [token(rng, B64, 16) for _ in range(500)]
    assert len(random_places(spark, short)) > 480


def test_secrets_between_separators(spark):
    """Keys with separators are found; identifiers, dates, cards and dialled numbers are not."""
    rng = random.Random(5)
    alnum = B64[:62]
    uuids = [str(uuid.UUID(int=rng.getrandbits(128), version=4)) for _ in range(100)]
    slack = [f"xoxb-{token(rng, '123456789', 12)}-{token(rng, '123456789', 13)}-{token(rng, alnum, 24)}" for _ in range(100)]
    url64 = [token(rng, alnum + "-_", 43) + "=" for _ in range(100)]

    def card():
        digits = [4] + [rng.randrange(10) for _ in range(14)]
        total = sum(d if k % 2 else d * 2 - 9 * (d > 4) for k, d in enumerate(digits))
        return "".join(map(str, digits)) + str(-total % 10)

    cards = [card() for _ in range(100)]
    cards[50:] = ["-".join(c[k:k + 4] for k in range(0, 16, 4)) for c in cards[50:]]
    moments = [f"20{rng.randrange(10, 30)}{rng.randrange(1, 13):02}{rng.randrange(1, 29):02}{rng.randrange(24):02}{rng.randrange(60):02}{rng.randrange(60):02}{rng.randrange(1000):03}"
               for _ in range(50)] + [str(rng.randrange(10 ** 15, 2 * 10 ** 15)) for _ in range(50)]
    dialled = ["00" + token(rng, "123456789", 14) for _ in range(100)]
    names = ["ubuntu-jammy-arm64-server-cloudimg", "TLS_ECDHE_RSA_WITH_AES_128_GCM_SHA256", "bicycle_repair_workshop_2019", "grandmothers-apple-strudel-recipe", "ENABLE_LEGACY_CHECKOUT_FLOW",
             "a---------------", "a-b-c-d-e-f-g-h-i", "_______________b", "2024-11-05_17-45-09-123", "win32-x64-msvc-14.29"] * 10
    found = {k for k, _, _ in random_places(spark, uuids + slack + url64 + cards + moments + dialled + names)}
    share = [len(found & set(range(k, k + 100))) for k in range(0, 700, 100)]
    assert min(share[:3]) >= 95 and max(share[3:]) <= 1, share


def test_chat(spark, monkeypatch):
    monkeypatch.setattr(chat_snapshots, "BLOCK", 4)
    monkeypatch.setattr(chat_snapshots, "PART", 3)
    rng = random.Random(1)
    talk = [(("user", "assistant")[k % 2], prose(rng, 3)) for k in range(11)]
    rows = []
    for conv, (start, n, change) in enumerate([(0, 2, None), (0, 5, None), (5, 11, None), (0, 11, None), (0, 11, None), (0, 7, 6), (0, 6, 5), (1, 1, None)]):
        for k in range(n):
            rows.append((conv, start + k, *(talk[k] if k != change else ("user", "other"))))
    rows += rows[:9] + [(50, None, None, None), (51, 0, "user", ""), (51, 0, "user", "b"), (51, 0, None, "b"), (52, 0, "user", None),
                        (None, 0, "user", "anon"), (None, 3, "assistant", "yes")]
    rows += [(60, k, "user", "x") for k in range(40)] + [(61, k * 7, "user", "x") for k in range(39)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn int, role string, text string, place int")
    parts = {}
    for r in chat_snapshots.format_conversations(df).orderBy("part").collect():
        old = parts.get(r["conv_id"], (0, 0, ""))
        parts[r["conv_id"]] = (r["n_turns"], r["n_logged"], old[2] + r["text"])
    assert parts == brute.conversations(rows)
    assert 61 not in parts and 60 in parts
    assert chat_snapshots.format_conversations(spark.createDataFrame([], df.schema)).collect() == []


def test_url_rules_without_literals(spark):
    """A rule that names no literal is tried on every url; others are fetched by theirs as before."""
    pages = spark.createDataFrame([(1, "http://a.org/x.exe"), (2, "http://b.net/y"), (3, None), (4, "http://c.io/")], "page_id bigint, url string")
    rules = (url_rules.Rule("exe", "block", r"\.[e]xe$", ()), url_rules.site_rule("net", "/", "block"))
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_rules.judge_urls(pages, ("page_id",), rules=rules).collect()}
    assert got == {1: ("exe", "block"), 2: ("net/", "block"), 3: (None, "allow"), 4: (None, "allow")}
