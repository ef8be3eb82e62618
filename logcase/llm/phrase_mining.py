"""Collocations per language by Toivonen's sampling method.

1. A sample of the corpus (blocks of text, ``RATE`` of them) proposes phrases: words, then pairs of proposed words, then
   longer phrases all of whose pairs are proposed, each seen in the sample at a threshold lowered by ``DEVIATIONS``.
2. One full pass counts exactly, by their text, all proposed phrases, and beside them the negative border: phrases that
   are not proposed but whose first and last parts, one word shorter, are (for words: all others).
3. Border phrases that turn out frequent have failed the proposal. If there are any, an expansion pass counts, by their
   text, all phrases that are or hold a failure and whose parts without one are proposed. A frequent phrase has only
   frequent parts, so one that the first pass did not count must hold a failure (its shortest part outside the
   proposed set, words at the latest, was border): one expansion closes the result, whatever the sample held.

The proposed set is known to the tasks as a bit filter of at most ``2 ** MOST_BITS`` bits, built by a Spark aggregate.
Its false positives only add phrases to be counted. Border phrases are counted by 64-bit hash, which can only add
failures; what is returned is counted by text. Tasks count within buffers of ``TOKENS`` words, so hot phrases reach the
shuffle once a buffer, and no group is ever collected.

Defined results: null and empty texts have no words; a null language is ``und``. Repeated rows count each time. A very
long text is worked through in slices that share their border words. An empty table gives an empty result. Only the
text and language columns are read, so others cannot clash.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logcase.llm.common import text_of
from logcase.plans.sizing import materialize

#: Characters between pieces; A-Z is lower-cased; blank and tab stand between words.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
LONGEST = 5
RATE = 4  # one block of text in RATE goes into the sample
BLOCK_BYTES = 512
DEVIATIONS = 4.0
MOST_BITS = 27
BITS_A_KEY = 16
TOKENS = 1 << 18
_SLICE = 4 << 20
_END = b"\xff"  # stands for the end of a piece; no UTF-8 text holds this byte
_PREPARED = bytes.maketrans(bytes(range(65, 91)) + PIECE_ENDS + b"\t", bytes(range(97, 123)) + b"\n" * len(PIECE_ENDS) + b" ")
_FACTORS = np.array([xxhash.xxh64_intdigest(f"phrase:{i}") | 1 for i in range(16)], np.uint64)


class Tokens(dict):
    """64-bit hashes of words, 0 for the end of a piece; emptied when it grows beyond a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = 0 if word == _END else xxhash.xxh3_64_intdigest(word) or 1
        return h


def slices(text: bytes, most: int = _SLICE) -> Iterator[tuple[list[bytes], int]]:
    """Words and piece ends of a text, in slices; with each, how many words at its start the last one had too."""
    text, at, shared = text.translate(_PREPARED), 0, []
    while at < len(text):
        end = len(text)
        if end - at > most:
            cut = text.rfind(b"\n", at, at + most) + 1 or text.rfind(b" ", at, at + most) + 1
            end = cut if cut > at else min((x + 1 for x in (text.find(c, at + most) for c in (b" ", b"\n")) if x >= 0), default=end)
        tokens = shared + text[at:end].replace(b"\n", b" \xff ").split()
        yield tokens, len(shared)
        shared, at = tokens[-(LONGEST - 1):], end


def blocks(text: bytes, take: Callable[[], bool]) -> Iterator[list[bytes]]:
    """The chosen blocks of a text; words that a block cuts are left out."""
    text = text.translate(_PREPARED)
    for at in range(0, len(text), BLOCK_BYTES):
        if take():
            part = text[at:at + BLOCK_BYTES].replace(b"\n", b" \xff ")
            first = part.find(b" ") + 1 if at else 0
            last = part.rfind(b" ") if at + BLOCK_BYTES < len(text) else len(part)
            yield part[first:max(last, first)].split()


class Grams:
    """Keys of all phrases in a buffer of tokens: ``keys[n]`` and ``ok[n]`` for n words, by the place of the first.
    The three lowest bits of a key hold n."""

    def __init__(self, hashes: np.ndarray, langs: np.ndarray, old: np.ndarray, longest: int) -> None:
        ends = hashes == 0
        total = langs * _FACTORS[-1]
        self.keys, self.ok, self.counted = [total], [np.ones(len(hashes), bool)], [np.zeros(0, bool)]
        for n in range(1, longest + 1):
            size = max(len(hashes) - n + 1, 0)
            total = total[:size] + hashes[n - 1:] * _FACTORS[n]
            x = (total ^ (total >> np.uint64(32))) * _FACTORS[0]
            x ^= x >> np.uint64(29)
            self.keys.append((x & ~np.uint64(7)) | np.uint64(n))
            self.ok.append(self.ok[-1][:size] & ~ends[n - 1:])
            self.counted.append(self.ok[-1] & ~old[n - 1:])


class Proposed:
    """A bit filter of keys, each at two places."""

    def __init__(self, bits: int, words: np.ndarray) -> None:
        self.bits, self.words = bits, words

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for place in ((keys >> np.uint64(3)) & np.uint64((1 << self.bits) - 1), keys >> np.uint64(64 - self.bits)):
            out &= (self.words[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def proposed(keys: DataFrame, bits_a_key: int) -> Proposed:
    """The filter of a table of keys: sized by their number up to a bound, its words made by a Spark aggregate."""
    bits = min(max(10, math.ceil(math.log2(max(keys.count(), 1) * bits_a_key))), MOST_BITS)
    places = F.array(F.shiftrightunsigned("key", 3).bitwiseAND((1 << bits) - 1), F.shiftrightunsigned("key", 64 - bits))
    each = keys.select(F.explode(places).alias("p"))
    rows = each.groupBy(F.shiftright("p", 6).alias("at")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("p").bitwiseAND(63).cast("int"))).alias("bits")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return Proposed(bits, words)


def _buffers(docs: DataFrame, lang: str, sample: bool, schema: str, work: Callable) -> DataFrame:
    """Calls ``work(words, Grams, languages, language of each token)`` on buffers of tokens; record batches come out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, state = Tokens(), [TaskContext.get().partitionId() + 1]

        def take() -> bool:
            state[0] = (state[0] * 6364136223846793005 + 1442695040888963407) % (1 << 64)
            return (state[0] >> 33) % RATE == 0

        words: list[bytes] = []
        spans: list[tuple[int, str, int]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            names = sorted({s[1] for s in spans})
            sizes = [s[0] for s in spans]
            which = np.repeat([names.index(s[1]) for s in spans], sizes)
            old = np.zeros(len(words), bool)
            for start, (_, _, k) in zip(np.cumsum([0, *sizes[:-1]]).tolist(), spans):
                old[start:start + k] = True
            hashes = np.fromiter(map(tokens.__getitem__, words), np.uint64, len(words))
            of = np.array([xxhash.xxh64_intdigest(x) for x in names], np.uint64)[which]
            for out in work(words, Grams(hashes, of, old, LONGEST), names, which):
                for low in range(0, out.num_rows, 1 << 16):
                    yield out.slice(low, 1 << 16)
            words.clear()
            spans.clear()

        for batch in batches:
            for text, name in zip(batch.column(0), batch.column(1)):
                body = text.as_py()
                for part, shared in ((b, 0) for b in blocks(body, take)) if sample else slices(body):
                    words += part
                    words.append(_END)
                    spans.append((len(part) + 1, name.as_py(), shared))
                    if len(words) >= TOKENS:
                        yield from flush()
        if words:
            yield from flush()

    rows = docs.select(text_of(docs).cast("binary").alias("body"), F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"))
    return rows.mapInArrow(run, schema)


def _tally(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their counts and the place of one of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.diff(np.append(starts, len(keys))), order[starts]


def sample_proposals(docs: DataFrame, lang: str, min_count: int) -> DataFrame:
    """Keys of the phrases that the sample proposes."""
    wanted = min_count / RATE
    least = max(1, math.floor(wanted - DEVIATIONS * math.sqrt(wanted)))

    def level(lengths: tuple[int, ...], shorter: Proposed | None) -> DataFrame:
        def work(words: list[bytes], g: Grams, names: list[str], which: np.ndarray) -> Iterator[pa.RecordBatch]:
            step = lengths[0] - 1
            known = shorter.holds(g.keys[step]) if shorter else None
            for n in lengths:
                keep = g.counted[n].copy()
                for k in range(n - step + 1) if shorter else ():
                    keep &= known[k:k + len(keep)]
                keys, counts, _ = _tally(g.keys[n][keep])
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts, pa.int64())], ["key", "c"])

        rows = _buffers(docs, lang, True, "key bigint, c bigint", work)
        return materialize(rows.groupBy("key").agg(F.sum("c").alias("c")).where(F.col("c") >= least).select("key"), "phrases-proposed")

    words = level((1,), None)
    pairs = level((2,), proposed(words, BITS_A_KEY))
    return words.union(pairs).union(level(tuple(range(3, LONGEST + 1)), proposed(pairs, BITS_A_KEY)))


def _full_pass(docs: DataFrame, lang: str, known: Proposed, failed: Proposed | None) -> DataFrame:
    """Counts over the whole corpus: (lang, phrase, key, c).

    Without ``failed``: the proposed phrases by text (key null), the border by key (phrase null), and all words of a
    language as the phrase ''. With it, by text: the phrases that are or hold a failure, as far as their other parts are
    proposed."""
    def work(words: list[bytes], g: Grams, names: list[str], which: np.ndarray) -> Iterator[pa.RecordBatch]:
        def rows(langs: list, phrases: list, keys: pa.Array | None, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array(langs, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()),
                keys if keys is not None else pa.nulls(len(counts), pa.int64()), pa.array(counts, pa.int64())],
                ["lang", "phrase", "key", "c"])

        def by_text(n: int, wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
            at = np.flatnonzero(wanted & g.counted[n])
            _, counts, firsts = _tally(g.keys[n][at])
            firsts = at[firsts]
            for low in range(0, len(firsts), 1 << 16):
                some = firsts[low:low + (1 << 16)].tolist()
                yield rows([names[k] for k in which[some]], [b" ".join(words[i:i + n]) for i in some], None, counts[low:low + (1 << 16)])

        if failed is None:
            yield rows(names, [b""] * len(names), None, np.bincount(which[g.counted[1]], minlength=len(names)))
        both = lambda x, size: x[:size] & x[1:size + 1]
        member = possible = holding = None
        for n in range(1, LONGEST + 1):
            size = len(g.keys[n])
            in_border = g.ok[n] & both(member, size) if n > 1 else g.ok[n].copy()
            looked = np.flatnonzero(in_border)
            parts, holds = (both(possible, size), holding[:size] | holding[1:size + 1]) if failed and n > 1 else (g.ok[n], np.zeros(size, bool))
            member = np.zeros(size, bool)
            member[looked] = known.holds(g.keys[n][looked])
            in_border &= ~member
            if failed is None:
                yield from by_text(n, member)
                keys, counts, _ = _tally(g.keys[n][in_border & g.counted[n]])
                yield rows([None] * len(keys), [None] * len(keys), pa.array(keys.view(np.int64)), counts)
            else:
                looked = np.flatnonzero(in_border)
                holds[looked] |= failed.holds(g.keys[n][looked])
                holding, possible = holds & g.ok[n], g.ok[n] & parts & (member | holds)
                yield from by_text(n, possible & holding & ~member)

    return _buffers(docs, lang, False, "lang string, phrase string, key bigint, c bigint", work).groupBy("lang", "phrase", "key").agg(
        F.sum("c").alias("c"))


def frequent_phrases(docs: DataFrame, min_count: int = 100, lang: str = "lang") -> DataFrame:
    """(lang, phrase, c): every phrase of 1 to ``LONGEST`` words with at least ``min_count`` occurrences in its language,
    its words separated by single blanks; and per language the number of all its words, as the phrase ''."""
    known = proposed(sample_proposals(docs, lang, min_count), BITS_A_KEY)
    enough = F.col("c") >= min_count
    counted = materialize(_full_pass(docs, lang, known, None).where(enough | (F.col("phrase") == "")), "phrases")
    found = counted.where(F.col("phrase").isNotNull()).select("lang", "phrase", "c")
    failures = counted.where(F.col("phrase").isNull()).select("key")
    if failures.isEmpty():
        return found
    more = _full_pass(docs, lang, known, proposed(failures, 4 * BITS_A_KEY)).where(enough).select("lang", "phrase", "c")
    return found.union(materialize(more, "phrases-expanded"))


def _cut(words: Column, start: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def collocations(docs: DataFrame, min_count: int = 100, cover_pct: int = 100, lang: str = "lang") -> DataFrame:
    """(lang, phrase, a, l, r, n, score): the phrases of 2 words and more with ``a >= min_count``, scored by their weakest
    cut, without those that stand inside a longer one with at least ``cover_pct`` percent of their occurrences."""
    counts = frequent_phrases(docs, min_count, lang)
    totals = counts.where("phrase = ''").select("lang", F.col("c").alias("n"))
    counts = counts.where("phrase <> ''")
    words = F.split("phrase", " ", -1)
    phrases = counts.select("lang", "phrase", F.col("c").alias("a"), words.alias("words")).where(F.size("words") > 1)
    size = F.size("words")
    cuts = phrases.select("lang", "phrase", "a", size.alias("size"), "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", _cut(F.col("words"), 1, F.col("k")).alias("head"),
        _cut(F.col("words"), F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
    part = lambda of, name: counts.select("lang", F.col("phrase").alias(of), F.col("c").alias(name))
    wide = lambda name: F.col(name).cast("decimal(17,0)")
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * (wide("a") * wide("n")), wide("l") * wide("r"))
    scored = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"]).join(totals, "lang")
    weakest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    longer = phrases.where(size > 2).select("lang", "phrase", "a", size.alias("size"), "words", F.explode(F.sequence(F.lit(2), size - 1)).alias("k"))
    inner = longer.select("lang", "a", "words", "k", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("k") + 1)).alias("start")).select(
        "lang", _cut(F.col("words"), F.col("start"), F.col("k")).alias("phrase"), "a")
    covered = inner.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    out = weakest.join(covered, ["lang", "phrase"], "left").where(
        F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * cover_pct))
    return out.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").cast("bigint").alias("score"))
