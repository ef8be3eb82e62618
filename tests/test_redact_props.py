"""Differential check of redaction: Spark's fold against Python ``re`` with the
same fixed patterns (Python semantics, e.g. Unicode ``\\s``), on random texts."""
import random
import re

from pyspark.sql import functions as F

from logcase.functions.redact import SECRET_PATTERNS, redact

ALPHABET = "abcXYZ019 -_.~+/=\t\n é漢 　"
PIECES = ["Bear" + "er ", "Bear" + "er ", "sk_" + "live_", "sk_" + "test_", "AK" + "IA", "ey" + "J", ".",
          "-----BEGIN RSA PRIV" + "ATE KEY-----", "-----END RSA PRIV" + "ATE KEY-----", "gh" + "p_", "xo" + "xb-",
          "xo" + "xq-"]


def python_fold(text: str) -> str:
    for p in SECRET_PATTERNS:
        text = re.sub(p.regex, p.replacement, text)
    return text


def random_text(rng: random.Random) -> str:
    out = []
    token_chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789abcdef-_="
    for _ in range(rng.randint(1, 12)):
        if rng.random() < 0.5:
            out.append(rng.choice(PIECES))
            if rng.random() < 0.2:
                out.append(rng.choice(["\u00a0", "\u3000", "\t", "  "]))   # Unicode / repeated white space
            for _ in range(rng.choice([1, 1, 3])):                          # JWT-like a.b.c tokens
                out.append("".join(rng.choice(token_chars) for _ in range(rng.randint(8, 40))))
                out.append(rng.choice(["", ".", "\n"]))
        out.append("".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))))
    return "".join(out)


def test_spark_redaction_equals_python_fold(spark):
    rng = random.Random(20261203)
    texts = [random_text(rng) for _ in range(600)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(redact(F.col("t"))).collect()]
    want = [python_fold(t) for t in texts]
    diffs = [(t, g, w) for t, g, w in zip(texts, got, want) if g != w]
    assert not diffs, diffs[:3]
    assert sum(g != t for g, t in zip(got, texts)) > 100          # the generator does produce secrets
    again = [r[0] for r in spark.createDataFrame([(i, g) for i, g in enumerate(got)], "i int, t string")
             .orderBy("i").select(redact(F.col("t"))).collect()]
    assert again == got                                            # idempotent
