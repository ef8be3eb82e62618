"""Small documents with the difficult cases."""
from __future__ import annotations

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, body string, kept string, row int, spans string, ids int, key string"


def prose(rng: random.Random, n: int, vocabulary: int = 4000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", "", ".", ","]) for _ in range(n))


def texts(seed: int = 0) -> list[str | None]:
    """Exact copies, near copies, shared lines and passages, junk, blanks, one very long text, nulls."""
    rng = random.Random(seed)
    shared = [prose(rng, 12) for _ in range(3)]
    out: list[str | None] = [None, "", " \t\n ", "one", "Two words", "a b c d e", "A B  C\nD E", "a b a b a b a b a b", "é ß 日本 word"]
    base = prose(rng, 120)
    for edits in (0, 0, 1, 1, 2, 2, 3, 4, 5, 8):
        w = base.split(" ")
        for _ in range(edits):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10 ** 6)}"
        out.append(" ".join(w))
    out += [base.upper(), prose(rng, 60) + "\n" + shared[0], shared[0] + "\n" + prose(rng, 80), "  " + shared[0].upper() + "\t\n" + shared[1]]
    out += [shared[1] + "\n" + shared[1] + "\n" + prose(rng, 55), prose(rng, 70) + "\n" + shared[1], shared[2] + "\n" + shared[0], shared[2]]
    out += ["\n".join(prose(rng, 9) for _ in range(40)), " ".join(["again"] * 200), "| ".join(prose(rng, 60).split(" "))]
    out += ["!! ".join(prose(rng, 70).split(" ")) + "!!", "### ".join(prose(rng, 70).split(" ")), prose(rng, 30_000)]
    out += [prose(rng, 64) + "\n" + " | ".join(prose(rng, 20).split(" ")) + "\nCookie policy and more"]
    return out


def documents(spark, extra: bool = True):
    rows = [(i, t, None if i % 3 else "en", None if i % 4 else "s", None if t is None else len(t)) for i, t in enumerate(texts())]
    rows += [rows[9], rows[9], (None, rows[10][1], None, None, None), (None, None, None, None, None)]
    wide = [(*r, "x", "y", 1, None, 5, "k") for r in rows]
    return spark.createDataFrame(wide, DOCS) if extra else spark.createDataFrame(rows, DOCS.split(", body")[0])
