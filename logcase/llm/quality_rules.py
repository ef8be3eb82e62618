"""Line-first cleaning: rules judge each line, failing lines go, then a document that lost too much text is rejected.

All of it is column expressions on the row itself: no shuffle, no Python. Each intermediate array is a column of its
own, because a lambda that names an expression instead of a column would compute it anew for every element.

Defined results: a null text has no words, fails the base rule (too few words) and is not kept; so does a blank
text. Lines without a word are kept by the line rules (they cost nothing). Repeated rows are judged alike, each on
its own. An empty table gives an empty table. Other columns pass unchanged. Work per document is n log n in its words.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logcase.llm.common import text_of, words

MIN_WORDS = 50
MAX_REPEAT_PCT = 50
#: A document whose failing lines hold more than this share of its word characters is rejected.
MAX_LOST_PCT = 50
SYMBOLS = "[#*$%&|<>]"
#: Symbols that a line must have at least to be laden with them; a heading's, bullet's or quote's leading mark and pairs of
#: emphasis marks around a text are markup, not symbols.
MIN_SYMBOLS = 3
LEADING_MARK = r"^[\x20\x09]*(?:#{1,6}|[*>])[\x20\x09]+"
EMPHASIS = r"(\*{1,3})([^\x20\x09*](?:[^*]*[^\x20\x09*])?)\1"
#: Marks of sentences and their parts, in several scripts. A line of so many words without any is a list of keywords.
SENTENCE_MARKS = ".,;:!?…。、，！？；：،؛؟।"
MARKLESS_WORDS = 150
#: Marks in a row that no sentence has: leaders of a contents list, dotted rules.
MARK_RUN = r"[.,;:!?](?:\x20?[.,;:!?]){9}"
#: Fixed phrases that site furniture consists of (matched without regard to case), in lines of up to 20 words.
BOILERPLATE = ("accept all cookies", "all rights reserved", "click here to", "cookie policy", "enable javascript",
               "privacy policy", "sign up for our newsletter", "skip to content", "subscribe to our", "terms of service")
#: Windows are sorted as one integer each: 40 bits of hash above 24 bits of place. Longer texts take the slower way.
PLACE_BITS = 24


def _count(line: Column, char: str) -> Column:
    return F.char_length(line) - F.char_length(F.replace(line, F.lit(char), F.lit("")))


def _own_symbols(line: Column) -> Column:
    """How many characters of ``SYMBOLS`` stand in the line beside a leading mark and pairs of emphasis marks."""
    text = F.regexp_replace(F.regexp_replace(line, LEADING_MARK, ""), EMPHASIS, "$2")
    return F.char_length(F.regexp_replace(text, "[^#*$%&|<>]+", ""))


def line_fails(line: Column, w: Column, symbols: Column) -> Column:
    """True for lines whose punctuation is not that of sentences (laden with symbols, dot leaders and other runs of marks,
    very long without any mark), navigation bars, shouted, boilerplate and stuttering lines. Cheap rules stand first, and
    symbols are counted again without markup only where all of them would be enough.
    ``w``: the line's words; ``symbols``: how many characters of ``SYMBOLS`` it has."""
    n = F.size(w)
    laden = (n >= 2) & (symbols >= MIN_SYMBOLS) & (symbols * 4 >= n) & (_own_symbols(line) >= F.greatest(F.lit(MIN_SYMBOLS), F.ceil(n / 4)))
    punctuation = laden | ((n >= MARKLESS_WORDS) & ~line.rlike(f"[{SENTENCE_MARKS}]")) | line.rlike(MARK_RUN)
    navigation = (n >= 6) & (_count(line, "|") * 3 >= n)
    shouting = (n >= 4) & (_count(line, "!") * 2 >= n)
    low = F.lower(line)
    phrases = (n <= 20) & reduce(lambda a, b: a | b, [low.contains(p) for p in BOILERPLATE])
    stutter = (n >= 12) & (F.size(F.array_distinct(w)) * 3 <= n)
    return (n > 0) & (punctuation | navigation | shouting | phrases | stutter)


def _windows(w: Column) -> Column:
    """The 3-word windows of ``w`` as integers (hash, place), sorted, so that equal windows are neighbours."""
    n = F.size(w)
    last = F.least(n - 3, F.lit((1 << PLACE_BITS) - 1))
    packed = F.transform(F.sequence(F.lit(0), last), lambda i: F.shiftleft(
        F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), PLACE_BITS).bitwiseOR(i.cast("bigint")))
    return F.when(n > 3, F.sort_array(packed)).otherwise(F.array().cast("array<bigint>"))


def _same_hash(windows: Column) -> Column:
    """(place, place of the next window) of all neighbours with equal hashes."""
    pairs = F.transform(F.filter(F.transform(windows, lambda x, k: F.struct(x.alias("a"), F.get(windows, k + 1).alias("b"))),
                                 lambda p: F.shiftright(p["a"], PLACE_BITS) == F.shiftright(p["b"], PLACE_BITS)),
                        lambda p: F.struct(*[p[s].bitwiseAND((1 << PLACE_BITS) - 1).cast("int").alias(s) for s in "ab"]))
    return pairs


def _differ(w: Column, pair: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.get(w, pair["a"] + k) != F.get(w, pair["b"] + k) for k in range(3)])


def _covered(starts: Column) -> Column:
    """Number of words in the windows that start at ``starts``."""
    return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))


def _sorted_by_words(w: Column) -> Column:
    grams = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(
        F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i")))
    return F.array_sort(grams)


def measures(docs: DataFrame) -> DataFrame:
    """``docs`` in a struct ``row`` with its base measures, ``base_failed``, ``cleaned`` text, ``lost_pct`` and ``kept``."""
    body = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.split(text_of(docs), "\n", -1).alias("raw"))
    body = body.select("row", F.transform("raw", lambda x: F.struct(
        x.alias("x"), words(x).alias("w"), F.char_length(F.regexp_replace(x, "[^#*$%&|<>]+", "")).alias("s"))).alias("parts"))
    body = body.select("row", F.transform("parts", lambda p: F.struct(
        p["x"].alias("x"), p["w"].alias("w"), p["s"].alias("s"), F.char_length(F.array_join(p["w"], "")).alias("chars"),
        line_fails(p["x"], p["w"], p["s"]).alias("bad"))).alias("lines"))
    body = body.select("row", "lines", F.flatten("lines.w").alias("w"))
    body = body.select("*", _windows(F.col("w")).alias("windows"))
    body = body.select("*", _same_hash(F.col("windows")).alias("pairs"))
    # Equal hashes of different windows, or a text too long for the places: the windows themselves are sorted then.
    unsure = F.exists("pairs", lambda p: _differ(F.col("w"), p)) | (F.size("w") - 2 > (1 << PLACE_BITS))
    body = body.select("*", F.when(unsure, _sorted_by_words(F.col("w"))).alias("exact"))
    exact = F.filter("exact", lambda x, k: F.coalesce(x["g"] == F.get(F.col("exact"), k - 1)["g"], F.lit(False))
                     | F.coalesce(x["g"] == F.get(F.col("exact"), k + 1)["g"], F.lit(False)))
    total = lambda field, rows: F.aggregate(rows, F.lit(0).cast("bigint"), lambda t, p: t + p[field])
    worded = F.filter("lines", lambda p: F.size(p["w"]) > 0)
    out = body.select(
        "row", F.size("w").cast("bigint").alias("n_words"), total("chars", F.col("lines")).alias("word_chars"),
        total("s", F.col("lines")).alias("n_symbols"),
        (F.size(worded) - F.size(F.array_distinct(F.transform(worded, lambda p: p["x"])))).cast("bigint").alias("n_dup_lines"),
        F.when(F.col("exact").isNotNull(), _covered(F.transform(exact, lambda x: x["i"]))).otherwise(
            _covered(F.flatten(F.transform("pairs", lambda p: F.array(p["a"], p["b"]))))).cast("bigint").alias("n_repeat_words"),
        F.array_join(F.transform(F.filter("lines", lambda p: ~p["bad"]), lambda p: p["x"]), "\n").alias("cleaned"),
        total("chars", F.filter("lines", lambda p: p["bad"])).alias("lost"))
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                         | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PCT))
    out = out.withColumn("lost_pct", F.when(F.col("word_chars") == 0, F.lit(0.0)).otherwise(100.0 * F.col("lost") / F.col("word_chars")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("lost_pct") <= MAX_LOST_PCT))


def clean_documents(docs: DataFrame) -> DataFrame:
    """The documents kept, with their failing lines gone from ``text`` and ``n_chars`` (if there) counted anew."""
    new = {"text": F.col("cleaned")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("cleaned").cast(docs.schema["n_chars"].dataType)
    # Through a one-row generator, below which no filter is pushed: else Spark would put all of the measures' nested
    # expressions in place of "kept", and planning would never end.
    judged = measures(docs).select(F.inline(F.array(F.struct("row", "cleaned", "kept"))))
    return judged.where("kept").select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
