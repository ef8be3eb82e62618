"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult stems (a weighted prefix automaton, learned from labelled rows), threats, targets,
negations and verbs of reported speech (short fixed lists). Small transducers, one for each of these notions, are
composed into one table; it runs over the symbols of each clause and adds every insult's weight to the reading in
which it stands: plain, aimed at someone, negated or reported; a threat counts where it has a target. A document's
score is a logistic function of the sums of its clauses, so a word alone, read in no clause, has no say.

Learning: document frequencies of word prefixes, first in toxic texts, then of the prefixes found often there in clean
ones, counted in tasks and summed by a partial and a final aggregate; then a logistic fit of the clause sums. All of it
uses at most about ``FIT_ROWS`` labelled rows, chosen by a hash of the id (repeated label rows count once), and keeps at
most the ``MAX_STEMS`` stems of the greatest weight. Scoring reads every text whole, in pieces of bounded size.

Defined results: null and empty texts have no clauses and get the score of that. Repeated rows are scored alike. If
the labelled rows hold one class only (or none), every score is that class (0 if none). An empty table gives an empty
table. Only id and text are read, so other columns cannot clash. Labels, language, source and id never enter a score.
"""
from __future__ import annotations

import itertools
import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logcase.llm.common import text_of
from logcase.plans.sizing import materialize

#: Bound on the labelled rows that a fit uses (documented sample; all other passes read everything).
FIT_ROWS = 12_000
#: Entries of the insult automaton: prefixes of these lengths (or whole shorter words), in at least so many toxic
#: texts, whose log-odds are surely (lower bound of the 90 % interval, which is their weight) at least so high.
PREFIX_SIZES = range(3, 13)
MIN_TOXIC_TEXTS = 3
MIN_LOG_ODDS = 1.5
MAX_STEMS = 50_000
THRESHOLD = 0.3
_PIECE = 1 << 20

OTHER, TARGET, NEGATION, REPORT, THREAT, END, INSULT = range(7)
_LISTS = {
    TARGET: "you your yours yourself he she they them those these u tu te toi vous votre ton ta ils elles tú vosotros "
            "usted ustedes ellos ellas eres du dich dir ihr euch euer dein deine sie",
    NEGATION: "not no never nor neither without isn't aren't wasn't don't doesn't ne pas jamais aucun sans nunca jamás "
              "ningún sin nicht kein keine keinen nie niemals ohne",
    REPORT: "said says say saying told called calls quoted quote wrote writes claimed claims reported reports allegedly "
            "dit disait écrit selon dijo dice dicen según escribió sagte sagt sagten schrieb laut angeblich",
    THREAT: "kill kills hurt destroy murder shoot stab beat smash hang burn tuer tuerai frapper détruire matar mataré "
            "golpear destruir töten umbringen schlagen vernichten",
}
READINGS = ("plain", "aimed", "negated", "reported", "threat")


@dataclass(frozen=True)
class Transducer:
    """``moves``: (state, symbol) to the next state, staying where none is given; ``marks``: states that it reports."""
    moves: dict[tuple[int, int], int]
    marks: frozenset[int]


def _scope(opener: int, length: int) -> Transducer:
    """Open for ``length`` symbols after the opener, at most to the end of the clause."""
    moves = {(s, x): max(0, s - 1) for s in range(1, length + 1) for x in range(7)}
    moves |= {(s, opener): length for s in range(length + 1)} | {(s, END): 0 for s in range(length + 1)}
    return Transducer(moves, frozenset(range(1, length + 1)))


def _until_end(opener: int) -> Transducer:
    return Transducer({(0, opener): 1, (1, END): 0}, frozenset({1}))


GRAMMAR = {"aimed": _until_end(TARGET), "negated": _scope(NEGATION, 3), "reported": _until_end(REPORT),
           "threatened": _until_end(THREAT)}


def compose(parts: dict[str, Transducer]) -> tuple[list[list[int]], list[str], list[bool]]:
    """The product of transducers: moves[state][symbol], the reading of an insult in each state (reported speech goes
    before negation, negation before aim), and whether a state holds a threat with a target that counts."""
    sizes = [1 + max(s for s, _ in t.moves) for t in parts.values()]
    number = {s: i for i, s in enumerate(itertools.product(*map(range, sizes)))}
    moves, readings, threats = [], [], []
    for state in number:
        moves.append([number[tuple(t.moves.get((s, x), s) for s, t in zip(state, parts.values()))] for x in range(7)])
        marked = {name for (name, t), s in zip(parts.items(), state) if s in t.marks}
        readings.append(next((r for r in ("reported", "negated", "aimed") if r in marked), "plain"))
        threats.append(marked == {"aimed", "threatened"})
    return moves, readings, threats


_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")
_FIXED = {w: symbol for symbol, words in _LISTS.items() for w in words.split()}


class Lexicon(dict):
    """Token (with its punctuation) to a code: twice the symbol, plus 1 if the token ends a clause. Insults have codes
    from 2 * INSULT on, two for each distinct weight. Filled on demand, emptied when large."""

    def __init__(self, stems: dict[str, float]) -> None:
        super().__init__()
        self.stems, self.sizes = stems, sorted({len(s) for s in stems})
        self.weights = sorted(set(stems.values()))
        self.number = {w: INSULT + i for i, w in enumerate(self.weights)}

    def __missing__(self, token: str) -> int:
        if len(self) > 300_000:
            self.clear()
        symbol, weight = OTHER, 0.0
        for w in _WORD.findall(token.lower()):
            best = max((self.stems.get(w[:k], 0.0) for k in self.sizes if k <= len(w)), default=0.0)
            if best > weight:
                symbol, weight = self.number[best], best
            elif symbol == OTHER:
                symbol = _FIXED.get(w, OTHER)
        code = self[token] = 2 * symbol + (token[-1] in ".!?;:,")
        return code

    def weight(self, code: int) -> float:
        return self.weights[code // 2 - INSULT]


def pieces(text: str) -> Iterator[str]:
    """Lines, and parts of very long lines cut at blanks."""
    at = 0
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        if end - at > _PIECE:
            blank = text.find(" ", at + _PIECE, end)
            end = end if blank < 0 else blank
        yield text[at:end]
        at = end + 1


class Reader:
    """Runs the composed grammar over texts."""

    def __init__(self, stems: dict[str, float]) -> None:
        self.lexicon = Lexicon(stems)
        self.moves, self.readings, self.threats = compose(GRAMMAR)

    def sums(self, text: str) -> list[float]:
        """Per reading the sum of weights, then the best clause, the number of clauses with a match, and of words."""
        total = dict.fromkeys(READINGS, 0.0)
        best = clauses = n = 0
        for line in pieces(text):
            found = list(map(self.lexicon.__getitem__, line.split()))
            n += len(found)
            if max(found, default=0) < 2 * THREAT:
                continue
            state, clause = 0, 0.0
            for code in found:
                symbol, old = min(code // 2, INSULT), state
                state = self.moves[state][symbol]
                if symbol == INSULT:
                    weight = self.lexicon.weight(code)
                    total[self.readings[state]] += weight
                    clause += weight
                elif self.threats[state] and (symbol == THREAT or not self.threats[old]):
                    total["threat"] += 1.0
                    clause += 1.0
                if code & 1:
                    best, clauses = max(best, clause), clauses + (clause > 0)
                    state, clause = self.moves[state][END], 0.0
            best, clauses = max(best, clause), clauses + (clause > 0)
        return [*total.values(), float(best), float(clauses), float(n)]


EVIDENCE = (*READINGS, "best", "clauses", "n_words")
_INPUTS = (*READINGS, "best", "clauses")


@dataclass(frozen=True)
class Grammar:
    """The learned part: stem weights, and the logistic function of the clause sums."""
    stems: dict[str, float] = field(default_factory=dict)
    weights: tuple[float, ...] = ()
    shift: float = 0.0
    constant: float | None = None

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Grammar:
        return Grammar(**json.loads(text))

    def score(self) -> Column:
        if self.constant is not None:
            return F.lit(self.constant)
        x = F.lit(self.shift)
        for name, w in zip(_INPUTS, self.weights, strict=True):
            x = x + F.log1p(name) * F.lit(w)
        return 1 / (1 + F.exp(-x))


def evidence(docs: DataFrame, grammar: Grammar, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id (and columns to keep) with the clause sums of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar.stems)
    kept = docs.select("doc_id", *keep)
    source = docs.select("doc_id", *keep, text_of(docs).alias("text of document"))
    names = [*kept.columns, *EVIDENCE]
    schema = kept.schema
    for name in EVIDENCE:
        schema = schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            rows = [reader.sums(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            cols = [pa.array(c, pa.float64()) for c in zip(*rows)] if rows else [pa.array([], pa.float64())] * len(EVIDENCE)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols], names)

    return source.mapInArrow(run, schema)


def _prefix_counts(texts: DataFrame, only: frozenset[str] | None = None) -> DataFrame:
    """(stem, n): in how many texts a word starts with the stem. ``only``: the stems to count (all)."""
    shared = texts.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(counts: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["stem", "n"])

        counts, wanted = Counter(), shared.value
        for batch in batches:
            for text in batch.column(0):
                stems = set()
                for line in pieces(text.as_py()):
                    words = set(_WORD.findall(line.lower()))
                    stems.update(w[:k] for w in words for k in PREFIX_SIZES if k <= len(w))
                counts.update(stems if wanted is None else stems & wanted)
                if len(counts) > 500_000:
                    yield out(counts)
                    counts = Counter()
        yield out(counts)

    return texts.mapInArrow(run, "stem string, n bigint").groupBy("stem").agg(F.sum("n").alias("n"))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> tuple[np.ndarray, float]:
    design = np.column_stack([x, np.ones(len(x))])
    beta, pull = np.zeros(design.shape[1]), np.array([ridge] * x.shape[1] + [1e-3])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hess = (design * (p * (1 - p))[:, None]).T @ design + np.diag(pull + 1e-9)
        step = np.linalg.solve(hess, design.T @ (y - p) - pull * beta)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta[:-1], float(beta[-1])


def fit(docs: DataFrame, labels: DataFrame) -> Grammar:
    """``labels``: doc_id and a 0/1 label (other values are left out)."""
    labels = labels.where(F.col("label").isin(0, 1)).select("doc_id", F.col("label").cast("int").alias("label")).distinct()
    n = labels.count()
    if n > FIT_ROWS:
        labels = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < FIT_ROWS)
    labels = materialize(labels, "toxic-labels")
    per_class = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    if len(per_class) < 2:
        return Grammar(constant=float(next(iter(per_class), 0)))
    # The sample is broadcast, so that of the documents only its texts move; its size has just been counted.
    if sum(per_class.values()) > 2 * FIT_ROWS:
        raise ValueError("the hash of the ids does not spread the labelled rows")
    rows = docs.select("doc_id", text_of(docs).alias("text")).join(F.broadcast(labels), "doc_id")
    # Of an id that repeats, one text: else one id could make the sample as large as the corpus.
    rows = materialize(rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label"), "toxic-sample")
    often = _prefix_counts(rows.where("label = 1").select("text")).where(F.col("n") >= MIN_TOXIC_TEXTS).collect()
    toxic = {r["stem"]: r["n"] for r in often}
    clean = {r["stem"]: r["n"] for r in _prefix_counts(rows.where("label = 0").select("text"), frozenset(toxic)).collect()}
    stems = {s: round(w, 2) for s, n in toxic.items() if (w := _weight(n, clean.get(s, 0), per_class[1], per_class[0])) >= MIN_LOG_ODDS}
    first = Grammar(dict(sorted(stems.items(), key=lambda x: (-x[1], x[0]))[:MAX_STEMS]))
    seen = evidence(rows, first, ("label",)).collect()
    x = np.log1p(np.array([[r[c] for c in _INPUTS] for r in seen], float).reshape(-1, len(_INPUTS)))
    weights, shift = _logistic(x, np.array([r["label"] for r in seen], float))
    return Grammar(first.stems, tuple(weights.tolist()), shift)


def _weight(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    """Lower bound of the log-odds of a stem that so many texts of each class have."""
    odds = math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))
    return odds - 1.645 * math.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    out = evidence(docs, grammar).withColumn("score", grammar.score())
    return out.select("doc_id", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *EVIDENCE)
