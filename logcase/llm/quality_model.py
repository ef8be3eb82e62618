"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

One scan turns each text into a dozen statistics (counts of byte classes and words, on Arrow batches), written once to
the shared scratch folder: ids and numbers only. Class means and covariances are sums of products over all labelled
rows, in one partial-then-final aggregation; the covariance of each class is shrunk towards the pooled one and towards
the diagonal. Inverse Cholesky factors are computed once and kept in the model; a score is the difference of two
Mahalanobis log-densities plus the log prior ratio, passed through a logistic function whose slope and offset are
fitted on the same rows.

Defined results: null and empty texts have statistics too (all counts 0) and get a score. Rows that repeat count each.
Rows without a label are scored alike. If the labelled rows hold only one class, every score is that class (0 if there
are none). An empty table gives an empty table. Labels, language, source and id never enter a score. Only the id and
the text are read, so other columns cannot clash.
"""
from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logcase.plans.sizing import materialize

SHRINK_POOLED = 0.1
SHRINK_DIAGONAL = 0.02
THRESHOLD = 0.3
FEATURES = ("size", "word_size", "distinct", "symbol", "bar", "shout", "upper", "digit", "other", "stop", "line_size", "dull_lines")

_CLASSES = (b"#*$%&<>", b"|", b"!", bytes(range(65, 91)), b"0123456789", b".?", b"\n", b" \t\x0b\x0c\r")
_KIND = np.full(256, len(_CLASSES) + 2)
_KIND[33:127] = len(_CLASSES) + 1
_KIND[[*range(97, 123)]] = len(_CLASSES) + 2
for _i, _chars in enumerate(_CLASSES):
    _KIND[list(_chars)] = _i
_KIND = _KIND.astype(np.uint8)


def statistics(text: bytes) -> tuple[float, ...]:
    """The transformed statistics of a text, named as in ``FEATURES``."""
    symbol, bar, shout, upper, digit, stop, breaks, blank, other, rest = (
        int(x) for x in np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=len(_CLASSES) + 3)[[*range(8), 9, 10]])
    words = text.split()
    n = len(words) + 1.0
    chars = len(text) - breaks - blank + 1.0
    lines = [x for x in text.split(b"\n") if x]
    dull = sum(len(x) for x in lines if len(set(y := x.split())) * 2 < len(y)) / (len(text) + 1.0)
    return (math.log(n), math.log(chars / n), math.log(len(set(words)) + 1.0) / math.log(n + 1), math.sqrt(symbol / n),
            math.sqrt(bar / n), math.sqrt(shout / n), math.sqrt(upper / chars), math.sqrt(digit / chars),
            math.sqrt(other / chars), math.sqrt(stop / n), math.log(n / (breaks + 1.0)), math.sqrt(dull))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and statistics of every row, written once to the shared folder: fitting and scoring both read them."""
    schema = docs.select("doc_id").schema.simpleString()[7:-1].replace(":", " ", 1)
    schema = f"{schema}, " + ", ".join(f"{f} double" for f in FEATURES)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics((x.as_py() or "").encode()) for x in batch.column(1)]
            columns = [pa.array(c, pa.float64()) for c in zip(*found, strict=True)] or [pa.array([], pa.float64())] * len(FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *FEATURES])

    return materialize(docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(rows, schema), "quality-statistics")


@dataclass(frozen=True)
class Discriminant:
    """For class 1, then 0: mean and inverse Cholesky factor. ``offset`` is the difference of the log terms that do not
    depend on the text; ``slope`` and ``shift`` calibrate the margin. ``constant`` replaces all of it if set."""
    means: tuple = ()
    factors: tuple = ()
    offset: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None

    def margin(self) -> Column:
        """Difference of the log-densities."""
        def distance(mean: list, factor: list) -> Column:
            total = F.lit(0.0)
            for i, row in enumerate(factor):
                z = F.lit(0.0)
                for f, m, a in zip(FEATURES[: i + 1], mean, row, strict=False):
                    z = z + (F.col(f) - F.lit(m)) * F.lit(a)
                total = total + F.pow(z, F.lit(2.0))
            return total

        one, zero = (distance(m, a) for m, a in zip(self.means, self.factors, strict=True))
        return F.lit(self.offset) + (zero - one) / 2

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Discriminant:
        return Discriminant(**json.loads(text))


def squashed(margin: Column) -> Column:
    """The far tails drawn in, so that one extreme text cannot steer the calibration."""
    return F.signum(margin) * F.log1p(F.abs(margin))


def fit(rows: DataFrame, label: str = "label") -> Discriminant:
    """``rows``: the statistics and a 0/1 label (rows with another label are left out)."""
    d = len(FEATURES)
    rows = rows.where(F.col(label).isin(0, 1))
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = rows.groupBy(F.col(label).cast("int").alias("y")).agg(
        F.count("*").alias("n"), *[F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)],
        *[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i, j in pairs]).collect()
    sums = {r["y"]: r for r in sums}
    if len(sums) < 2:
        return Discriminant(constant=float(next(iter(sums), 0)))
    count = {y: r["n"] for y, r in sums.items()}
    mean = {y: np.array([r[f"s{i}"] for i in range(d)]) / count[y] for y, r in sums.items()}
    cov = {}
    for y, r in sums.items():
        c = np.zeros((d, d))
        for i, j in pairs:
            c[i, j] = c[j, i] = r[f"p{i}_{j}"] / count[y] - mean[y][i] * mean[y][j]
        cov[y] = c
    pooled = sum(cov[y] * count[y] for y in cov) / sum(count.values())
    means, factors, offset = [], [], math.log(count[1] / count[0])
    for y, sign in ((1, -1.0), (0, 1.0)):
        c = (1 - SHRINK_POOLED) * cov[y] + SHRINK_POOLED * pooled
        c = (1 - SHRINK_DIAGONAL) * c + SHRINK_DIAGONAL * np.diag(np.diag(pooled)) + 1e-6 * np.eye(d)
        lower = np.linalg.cholesky(c)
        offset += sign * float(np.log(np.diag(lower)).sum())
        means.append(mean[y].tolist())
        factors.append(np.tril(np.linalg.inv(lower)).tolist())
    return calibrated(Discriminant(tuple(means), tuple(factors), offset), rows, label)


def calibrated(model: Discriminant, rows: DataFrame, label: str, bins: int = 400) -> Discriminant:
    """Fits slope and shift by logistic regression on a histogram of margins: at most ``bins`` rows a class come to the driver."""
    rows = rows.select(F.col(label).cast("int").alias("y"), model.margin().alias("m"))
    at = F.least(F.lit(10.0), F.greatest(F.lit(-10.0), squashed(F.col("m"))))
    hist = rows.groupBy(F.round(at * (bins / 20)).alias("x"), "y").agg(F.count("*").alias("n")).collect()
    x, y, n = (np.array([r[k] for r in hist], float) for k in "xyn")
    start = np.array([1.0, 0.0])
    design, beta = np.stack([x * 20 / bins, np.ones_like(x)], 1), start
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hess = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, design.T @ (n * (y - p)) - 1e-2 * (beta - start))
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return Discriminant(model.means, model.factors, model.offset, float(max(beta[0], 1e-3)), float(beta[1]))


def score(stats: DataFrame, model: Discriminant) -> DataFrame:
    if model.constant is not None:
        out = stats.select("doc_id", F.lit(model.constant).alias("score"))
    else:
        x = squashed(F.col("m")) * F.lit(model.slope) + F.lit(model.shift)
        out = stats.select("doc_id", model.margin().alias("m")).select("doc_id", (1 / (1 + F.exp(-x))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
