"""Redaction (R1-R10). Secret-shaped strings are assembled from parts."""
import hashlib

import pytest
from pyspark.sql import functions as F

from logcase.functions.redact import SECRET_PATTERNS, redact, redaction_audit

def _drawn(what: str, n: int, upper: bool = False) -> str:
    text = "".join(hashlib.sha256(f"{what} {k}".encode()).hexdigest() for k in range(4))[:n]
    return text.upper() if upper else text


STRIPE = "sk_" + "live_" + _drawn("payments", 24)
STRIPE_TEST = "sk_" + "test_" + _drawn("rehearsal", 24)
AWS = "AK" + "IA" + _drawn("kiln archive", 16, upper=True)
JWT = "ey" + "J" + _drawn("header", 17) + ".ey" + "J" + _drawn("claims", 16) + "." + _drawn("seal", 19)
BEARER = _drawn("bearer of the redaction tests", 23)
PEM_BODY = _drawn("pem", 40)
PEM = "-----BEGIN RSA PRIV" + f"ATE KEY-----\n{PEM_BODY}\n-----END RSA PRIV" + "ATE KEY-----"
GH = "gh" + "p_" + _drawn("forge", 36)
SLACK = "xo" + "xb-" + _drawn("chat", 10) + "-" + _drawn("room", 6)


def run(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(redact(F.col("t"))).collect()]


@pytest.mark.parametrize("secret,marker", [
    (f"kiln 4 called the scheduler with Bearer {BEARER} and was refused", "Bearer [REDACTED_BEARER]"),
    (f"refund batch b-17 used {STRIPE}, see the ledger", "[REDACTED_STRIPE_KEY]"),
    (f"dry run of batch b-18 with {STRIPE_TEST}.", "[REDACTED_STRIPE_TEST_KEY]"),
    (f"archiver could not reach its bucket as {AWS} (3 tries)", "[REDACTED_AWS_ACCESS_KEY]"),
    (f"session {JWT} went stale after 90 minutes", "[REDACTED_JWT]"),
    (f"glaze-service printed its key: {PEM} and stopped", "[REDACTED_PRIVATE_KEY]"),
    (f"mirror job cloned with {GH} at dawn", "[REDACTED_GITHUB_TOKEN]"),
    (f"alert relay posts through {SLACK} to the night shift", "[REDACTED_SLACK_TOKEN]"),
])
def test_each_pattern(spark, secret, marker):
    (out,) = run(spark, [secret])
    assert marker in out
    for part in (BEARER, STRIPE, STRIPE_TEST, AWS, JWT, PEM_BODY, GH, SLACK):
        assert part not in out


def test_benign_and_null_unchanged(spark):
    s = "kiln 7 reached 1,180 degrees; batch b-204 is half done (50%)"
    assert run(spark, [s, None]) == [s, None]


def test_order_bearer_before_jwt(spark):
    (out,) = run(spark, [f"Authorization: Bearer {JWT}"])
    assert out == "Authorization: Bearer [REDACTED_BEARER]"


def test_unicode_whitespace_after_bearer(spark):
    (out,) = run(spark, [f"Bearer {BEARER}"])
    assert out == "Bearer [REDACTED_BEARER]"


def test_pkcs8_header_not_matched(spark):
    pem = "-----BEGIN PRIV" + "ATE KEY-----\nabc\n-----END PRIV" + "ATE KEY-----"
    assert run(spark, [pem]) == [pem]


def test_idempotent(spark):
    texts = [f"a Bearer {BEARER} b {STRIPE} c {JWT} {PEM} {GH} {SLACK} {AWS}"]
    once = run(spark, texts)
    assert run(spark, once) == once


def test_audit_counts(spark):
    df = spark.createDataFrame([(f"x {STRIPE}",), ("clean",), (f"Bearer {BEARER}",)], "msg string")
    red = df.select(redact(F.col("msg")).alias("msg"))
    rows = {r.pattern: r for r in redaction_audit(red, cols=("msg",)).collect()}
    assert len(rows) == len(SECRET_PATTERNS)
    assert all(r.leaked_rows == 0 for r in rows.values())
    assert rows["stripe_live"].redacted_rows == 1 and rows["bearer"].redacted_rows == 1
    raw = {r.pattern: r for r in redaction_audit(df, cols=("msg",)).collect()}
    assert raw["stripe_live"].leaked_rows == 1
