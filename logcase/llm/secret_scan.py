"""Secret scan: fixed patterns, plus tokens that a battery of randomness tests tells from prose.

All of it is DataFrame functions. Matches come with their places by splitting the text at the same pattern: the
running sum of gaps and matches in a row's order is where a match ends. One row per match goes through one shuffle by
row number; texts do not.

A candidate is a run of 16 or more of ``A-Za-z0-9+/_=-`` outside the fixed patterns' spans. ``-`` and ``_`` separate:
the longest piece between them is judged if it has 16 characters, else all pieces together. Its encoding is inferred
from the characters it has (``ENCODINGS``), and over that alphabet three statistics are taken: chi-squared against
uniform use, the number of runs of the alphabet's halves, and the correlation of neighbours. Their squared normal scores
are summed; a sum above ``REJECTED``, the chi-squared distribution's 0.1 % tail, is not random. A token that passes has
the p-value P(token | prose) / P(token | uniform draws from its alphabet), at most 1, prose being the fixed chain of
``prose_model`` and each alphabet, with or without separators, having the same share; separators are given on both sides
and their neighbours judged as neighbours of marks. Text without small letters is held against prose in capitals. Under
that chain the p-value falls below x with a probability of at most x, and it has no floor. No other token enters it.
Within each length class the Benjamini-Hochberg rule at ``RATE`` decides among all candidates. Only the histogram by
class and p-value is gathered, a table of bounded size.
Tokens of letters alone are judged like all others, and so are those of digits alone unless they are a number of a known
make (``NUMBERS``, or 13 to 19 digits with a right check digit, as bank cards have): those have the p-value 1.

Defined results: null and empty texts have no spans. Repeated rows are scanned alike, each by itself. An empty table
gives an empty table. Only the columns asked for are read. Texts of any length are scanned whole.
"""
from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logcase.llm import prose_model
from logcase.llm.common import text_of
from logcase.plans.sizing import materialize

#: Fixed patterns: kind, pattern, group whose length counts, least length.
BASE = (
    ("assign", "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", "(AKIA[A-Z0-9]+)", 0, 20),
    ("hex", "([0-9a-f]{24,})", 0, 24),
)
CANDIDATE = ("random", "([A-Za-z0-9+/_=-]{16,})", 0, 16)
KINDS = tuple(b[0] for b in BASE) + ("random",)
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Alphabets in the order of their codes: a token has the first that holds all its characters.
ENCODINGS = (
    ("^[0-9]+$", _DIGITS), ("^[0-9a-f]+$", _DIGITS + "abcdef"), ("^[0-9A-F]+$", _DIGITS + "ABCDEF"), ("^[a-z]+$", _LOWER), ("^[A-Z]+$", _UPPER),
    ("^[A-Z2-7]+$", _UPPER + "234567"), ("^[0-9a-z]+$", _DIGITS + _LOWER), ("^[0-9A-Z]+$", _DIGITS + _UPPER), ("^[A-Za-z]+$", _UPPER + _LOWER),
    ("^[0-9A-Za-z]+$", _UPPER + _LOWER + _DIGITS), ("", prose_model.SYMBOLS),
)
#: Digits alone that name a moment (a calendar date with a time of day, micro- or nanoseconds since 1970) or a dialled line.
NUMBERS = "^((19|20)[0-9]{2}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])([01][0-9]|2[0-3])[0-5][0-9]([0-5][0-9][0-9]*)?|1[0-9]{15}|1[0-9]{18}|00[1-9][0-9]{12,15})$"
#: A piece between separators is judged by itself from this many characters.
PIECE = 16
LENGTH_CLASSES = (16, 20, 24, 32, 48)
RATE = 0.01
#: Sums of the three squared scores above this are not random: 0.1 % of a chi-squared variable with three degrees.
REJECTED = 16.27
#: Score of a statistic that is not defined, as all characters are alike or of one half.
UNDEFINED = 200.0
#: -ln p is binned by this width, up to a last bin; p counts as the bin's upper end. Bin -1 holds tokens with p = 1.
BIN, BINS = 0.25, 800


def _matches(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """(kind, k, gap, size, token, ok) of each match, ``gap`` being the characters between it and the match before."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    rows = F.transform(F.arrays_zip(found.alias("m"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("g"), counted.alias("c")),
                       lambda z, k: F.struct(F.lit(kind).alias("kind"), k.alias("k"), F.char_length(z["g"]).alias("gap"),
                                             F.char_length(z["m"]).alias("size"),
                                             (z["m"] if kind == "random" else F.lit(None).cast("string")).alias("token"),
                                             (F.char_length(z["c"]) >= least).alias("ok")))
    return F.when(text.rlike(pattern), rows).otherwise(F.array().cast("array<struct<kind:string,k:int,gap:int,size:int,token:string,ok:boolean>>"))


def _battery(found: DataFrame) -> DataFrame:
    """``found`` with ``bin``: that of -ln p of each token (null without a token)."""
    d = found.withColumn("part", F.regexp_replace("token", "=+$", ""))
    longest = F.expr("array_max(transform(split(part, '[-_]'), w -> struct(char_length(w) as size, w)))")
    d = d.withColumn("part", F.when(longest["size"] >= PIECE, longest["w"]).otherwise(F.col("part")))
    d = d.withColumn("bare", F.translate("part", "-_", ""))
    d = d.withColumn("bare", F.when(F.char_length("bare") >= 2, F.col("bare")))  # the least the statistics are defined for
    d = d.withColumn("letters", reduce(
        lambda rest, e: F.when(F.col("bare").rlike(e[0]), F.lit(e[1])).otherwise(rest), reversed(ENCODINGS[:-1]), F.lit(ENCODINGS[-1][1])))
    d = d.withColumn("m", F.char_length("letters"))
    d = d.withColumn("x", F.expr("transform(filter(split(bare, ''), c -> c != ''), c -> instr(letters, c))"))
    folded = F.when(F.col("part").rlike("[a-z]"), F.col("part")).otherwise(F.lower("part"))
    # a separator is a mark to its neighbours, and itself given: minus the place of a mark
    d = d.withColumn("folded", folded).withColumn("places", F.expr(
        f"transform(filter(split(folded, ''), c -> c != ''), c -> if(c in ('-', '_'), -{len(prose_model.SYMBOLS)}, instr('{prose_model.SYMBOLS}', c)))"))
    d = d.withColumn("n", F.size("x")).withColumn("counts", F.expr(
        "transform(sequence(1, m), s -> n - char_length(replace(bare, substring(letters, s, 1), '')))"))
    total = "aggregate({}, 0D, (t, v) -> t + v)"
    d = d.withColumns({
        "squares": F.expr(total.format("transform(counts, v -> double(v) * v)")),
        "high": F.expr("double(size(filter(x, v -> v * 2 > m)))"),
        "runs": F.expr("1D + size(filter(x, (v, i) -> i > 0 and (v * 2 > m) != (get(x, i - 1) * 2 > m)))"),
        "mean": F.expr(total.format("x") + " / n"),
        "power": F.expr(total.format("transform(x, v -> double(v) * v)") + " / n"),
        "lagged": F.expr(total.format("zip_with(slice(x, 1, n - 1), slice(x, 2, n - 1), (a, b) -> double(a) * b)") + " / (n - 1)"),
    })
    d = d.withColumn("expected", F.expr("1 + 2 * high * (n - high) / n"))
    z_use = F.expr("(m * squares / n - n - (m - 1)) / sqrt(2D * (m - 1) * (n - 1) / n)")
    z_runs = F.expr("(runs - expected) / sqrt(nullif(greatest((expected - 1) * (expected - 2) / (n - 1), 0D), 0D))")
    z_serial = F.expr("((lagged - mean * mean) / nullif(power - mean * mean, 0D) + 1D / (n - 1)) * sqrt(double(n))")
    worst = F.lit(UNDEFINED)
    q = F.pow(F.greatest(z_use, F.lit(0.0)), F.lit(2.0)) + F.coalesce(F.pow(z_runs, F.lit(2.0)), worst) + F.coalesce(F.pow(z_serial, F.lit(2.0)), worst)
    tables = prose_model.costs() + prose_model.costs(separated=True)
    costs = F.split(F.lit(",".join(f"{c:.4f}" for c in tables)), ",").cast("array<double>")  # folded to one literal
    width = len(prose_model.SYMBOLS) + 1
    base = F.when(F.col("part").rlike("[-_]"), width * width).otherwise(0)
    before = lambda i: F.when(i == 0, 0).otherwise(F.abs(F.get(F.col("places"), i - 1)))
    each = F.transform("places", lambda v, i: F.when(v >= 0, F.get(costs, base + before(i) * width + v)).otherwise(0.0))
    gain = F.aggregate(each, F.lit(0.0), lambda t, v: t + v) - F.col("n") * F.log(F.col("m").cast("double")) - math.log(2 * len(ENCODINGS))
    d = d.withColumns({"q": q, "gain": gain})
    doubled = "transform(reverse(filter(split(bare, ''), c -> c != '')), (c, i) -> if(i % 2 = 0, int(c), int(c) * 2 - if(c >= '5', 9, 0)))"
    checked = F.expr(f"if(bare rlike '^[0-9]{{13,19}}$', aggregate({doubled}, 0, (t, v) -> t + v) % 10 = 0, false)")
    number = F.coalesce(F.col("bare").rlike(NUMBERS) | checked, F.lit(False))
    score = F.when(~number & (F.col("q") <= REJECTED) & (F.col("gain") >= 0), F.least(F.floor(F.col("gain") / BIN), F.lit(BINS))).otherwise(-1)
    return d.withColumn("bin", F.when(F.col("token").isNotNull(), score).cast("int")).select(*found.columns, "bin")


def _found(docs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row per match of each row of ``docs`` (one with a null kind if it has none), with its place and score."""
    body = docs.select(F.struct(*[docs[k] for k in keys], F.lit(0).alias("_")).alias("key"), text_of(docs).alias("body"),
                       F.monotonically_increasing_id().alias("rid"))
    every = F.concat(*[_matches(F.col("body"), *pattern) for pattern in (*BASE, CANDIDATE)])
    rows = body.select("rid", "key", F.explode_outer(every).alias("f")).select("rid", "key", "f.*").repartition("rid")
    run = Window.partitionBy("rid", "kind").orderBy("k")
    rows = rows.withColumn("end", F.sum(F.col("gap").cast("bigint") + F.col("size")).over(run)).withColumn("start", F.col("end") - F.col("size"))
    rows = rows.withColumn("kind", F.when(F.col("ok"), F.col("kind")))  # a match that fails keeps its row, as its document's last may be
    # Candidates that touch a fixed pattern's span are covered already.
    fixed = F.col("kind").isNotNull() & (F.col("kind") != "random")
    order = Window.partitionBy("rid").orderBy("start", "end")
    before = F.max(F.when(fixed, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(F.when(fixed, F.col("start"))).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    covered = F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False))
    rows = rows.withColumn("covered", covered & (F.col("kind") == "random"))
    # Padding and marks alone hold nothing to test.
    blank = ~F.col("token").rlike("[A-Za-z0-9]") | ~F.col("token").rlike("^.+[^=]")
    rows = rows.withColumn("kind", F.when((F.col("kind") == "random") & (F.col("covered") | blank), F.lit(None)).otherwise(F.col("kind")))
    rows = rows.withColumn("token", F.when(F.col("kind") == "random", F.col("token")))
    scored = _battery(rows)
    size = F.coalesce(reduce(lambda rest, x: F.when(F.col("size") >= x, x).otherwise(rest), LENGTH_CLASSES, F.lit(LENGTH_CLASSES[0])), F.lit(0))
    return scored.select("rid", "key", "kind", "start", "end", size.alias("class"), "bin")


def thresholds(found: DataFrame) -> DataFrame:
    """(class, limit): the first bin of each length class whose tokens are discoveries."""
    # At most classes x bins rows.
    hist = found.where(F.col("kind") == "random").groupBy("class", "bin").agg(F.count("*").alias("tokens"))
    whole = Window.partitionBy("class")
    ranked = hist.select("class", "bin", F.exp(F.col("bin") * -BIN).alias("p"), F.sum("tokens").over(whole).alias("all"),
                         F.sum("tokens").over(whole.orderBy(F.desc("bin"))).alias("rank"))
    found_at = (F.col("bin") >= 0) & (F.col("p") * F.col("all") <= F.col("rank") * RATE)
    return ranked.where(found_at).groupBy("class").agg(F.min("bin").alias("limit"))


def find_secrets(docs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: its ``keys`` columns and ``spans``, (start, end, kind) in characters by start, then kind."""
    found = materialize(_found(docs, keys), "secret-matches")
    judged = found.join(F.broadcast(thresholds(found)), "class", "left")
    accepted = F.col("kind").isin(*KINDS[:-1]) | ((F.col("kind") == "random") & (F.col("bin") >= F.col("limit")))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    span = F.when(accepted, F.struct("start", rank.alias("rank"), "end", "kind"))
    out = judged.groupBy("rid").agg(F.first("key").alias("key"), F.array_sort(F.collect_list(span)).alias("spans"))
    return out.select(*[F.col("key").getField(k).alias(k) for k in keys], F.transform(
        "spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

