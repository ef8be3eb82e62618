"""Ranked lexical search with pair-bound MaxScore.

Index: documents are cut into shards of at most ``SHARD_TERMS`` words (one longer document is a shard of its own). A shard
holds one row per term with its postings (places of documents, frequencies) and one with the documents' ids and lengths.
Every document is indexed, and every word of it.

Search: the items' terms fetch their postings from all shards; an equi-join gives each posting list the items that hold
its term, and the lists come together again by shard. In a shard

1. each term has its greatest impact in the shard, and for each pair of terms that stand side by side in some item, in
   order of these impacts, the intersection list is made once: the greatest joint impact, and the tenth greatest;
2. an item starts from the best threshold that its lists and pairs promise (ten documents reach the tenth impact of a
   list). The longest prefix of its terms, in order of impact, whose combined bound stays below the threshold is left
   out at first: a pair counts with the greatest of its joint and its two single impacts, not with their sum;
3. documents of the other terms' lists are candidates. The terms left out are added from the greatest to the smallest,
   and before each step candidates drop out that cannot reach the threshold with the bound of what is left.

All bounds are exact integers and only what is strictly below the threshold drops out, so the result is that of scoring
everything. A window of ten rows per item, limited within each task first, merges the shards.

Defined results: null texts and texts without terms are not counted and never found, and items without terms find
nothing. Rows that repeat an item id are one item with all their terms; documents that repeat an id are ranked each for
itself. Equal scores go by ascending id, a null id last. An empty table gives an empty result. Only id and text columns
are read, so others cannot clash. A very long text is cut into words in slices.
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logcase.llm.common import text_of
from logcase.plans.sizing import broadcast_if_small, materialize

TOP = 10
SHARD_TERMS, SHARD_DOCS = 1 << 21, 1 << 16
#: Distinct terms of the items are broadcast up to this many rows, and joined by shuffling beyond.
QUERY_TERMS = 1_000_000
#: Terms of items that one task handles at a time, on average; more items make more blocks of them.
BLOCK_TERMS = 2_000_000
_SLICE = 4 << 20
#: Terms are the runs of letters and digits of ASCII and of all other characters; A-Z is lower-cased.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class _Numbers(dict):
    """Numbers terms in the order in which they come."""

    def __missing__(self, term: bytes) -> int:
        n = self[term] = len(self)
        return n


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in slices."""
    text, at = text.translate(_TERM_BYTES), 0
    while at < len(text):
        end = len(text)
        if end - at > _SLICE:
            space = text.find(b" ", at + _SLICE)
            end = space if space >= 0 else end
        yield text[at:end].split()
        at = end


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(shard, term, places, counts, ids): postings of each term; the row without a term has the ids of the shard's
    documents and, in ``counts``, their lengths. Documents without terms are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard = TaskContext.get().partitionId() << 32, 0
        numbers, ids, lengths, held = _Numbers(), [], [], []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal shard
            pairs = np.concatenate(held)
            pairs.sort()
            starts = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
            counts = np.diff(np.append(starts, len(pairs))).astype(np.int32)
            of, places = pairs[starts] >> 32, (pairs[starts] & 0xFFFFFFFF).astype(np.int32)
            cuts = np.searchsorted(of, np.arange(len(numbers) + 1)).astype(np.int32)
            spelt = list(numbers)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part + shard]), pa.nulls(1, pa.string()), pa.nulls(1, pa.list_(pa.int32())),
                 pa.array([lengths], pa.list_(pa.int32())), pa.array([ids], pa.list_(pa.int64()))], ["shard", "term", "places", "counts", "ids"])
            for low in range(0, len(spelt), 1 << 14):
                some = spelt[low:low + (1 << 14)]
                at = cuts[low:low + len(some) + 1]
                lists = [pa.ListArray.from_arrays(pa.array(at - at[0]), pa.array(x[at[0]:at[-1]])) for x in (places, counts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), part + shard)), pa.array(some, pa.binary()).cast(pa.string()), *lists,
                     pa.nulls(len(some), pa.list_(pa.int64()))], ["shard", "term", "places", "counts", "ids"])
            shard += 1
            for x in (numbers, ids, lengths, held):
                x.clear()

        size = 0
        for batch in batches:
            for who, body in zip(batch.column(0), batch.column(1)):
                n = 0
                for words in terms(body.as_py()):
                    if words:
                        held.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)) << 32 | len(lengths))
                        n += len(words)
                if n:
                    ids.append(who.as_py())
                    lengths.append(n)
                    size += n
                if size >= SHARD_TERMS or len(lengths) >= SHARD_DOCS:
                    yield from flush()
                    size = 0
        if lengths:
            yield from flush()

    rows = docs.select(docs[doc_id].cast("bigint").alias("id"), text_of(docs, text).cast("binary").alias("body"))
    return materialize(rows.mapInArrow(run, "shard bigint, term string, places array<int>, counts array<int>, ids array<bigint>"), "search-index")


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, term): the distinct terms of each item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, body in enumerate(batch.column(1)):
                for words in terms(body.as_py()):
                    some = sorted(set(words))
                    who = pa.array(np.full(len(some), k)) if some else pa.array([], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(who), pa.array(some, pa.binary()).cast(pa.string())], ["item_id", "term"])

    kind = items.schema[item_id].dataType.simpleString()
    rows = items.select(items[item_id].alias("item_id"), text_of(items, text).cast("binary").alias("body"))
    return rows.mapInArrow(run, f"item_id {kind}, term string").distinct()


class Shard:
    """The lists of one shard: places and impacts by number of a term, and the pair lists made from them."""

    def __init__(self, lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, top: int = TOP) -> None:
        self.lists, self.n_docs, self.top = lists, n_docs, top
        self.most = [int(x.max()) for _, x in lists]
        self.promise = [self.tenth(x) for _, x in lists]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        self.scored = Counter()

    def tenth(self, scores: np.ndarray) -> int:
        """A score that ``top`` of these reach (0 with fewer)."""
        return int(np.partition(scores, len(scores) - self.top)[len(scores) - self.top]) if len(scores) >= self.top else 0

    def pair(self, a: int, b: int) -> tuple[int, int]:
        """Greatest joint impact (0 without common documents), and the joint impact that ``top`` documents reach."""
        key = (min(a, b), max(a, b))
        if key not in self.pairs:
            (p, x), (q, y) = sorted((self.lists[a], self.lists[b]), key=lambda v: len(v[0]))
            at = np.minimum(np.searchsorted(q, p), len(q) - 1)
            both = q[at] == p
            joint = x[both] + y[at[both]]
            self.pairs[key] = (int(joint.max()) if len(joint) else 0, self.tenth(joint))
        return self.pairs[key]

    def search(self, query: list[int], use_pairs: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of all documents that can be among the ``top`` best for the terms of an item, with ties."""
        order = sorted(query, key=lambda t: (self.most[t], t))
        least = max((self.promise[t] for t in order), default=0)
        bound = [0]  # bound[k]: what documents can get from the first k terms
        for k, t in enumerate(order):
            if k % 2 and use_pairs:
                joint, tenth = self.pair(order[k - 1], t)
                bound.append(bound[k - 1] + max(joint, self.most[order[k - 1]], self.most[t]))
                least = max(least, tenth)
            else:
                bound.append(bound[k] + self.most[t])
        rest = max(k for k in range(len(order) + 1) if bound[k] < max(least, 1))
        score = np.zeros(self.n_docs, np.int64)
        for t in order[rest:]:
            score[self.lists[t][0]] += self.lists[t][1]
        found = np.flatnonzero(score)
        self.scored["candidates"] += len(found)
        for k in range(rest, -1, -1):
            least = max(least, self.tenth(score[found]))
            found = found[score[found] + bound[k] >= least]
            if k and len(found):
                p, x = self.lists[order[k - 1]]
                at = np.minimum(np.searchsorted(p, found), len(p) - 1)
                score[found] += np.where(p[at] == found, x[at], 0)
                self.scored["lookups"] += len(found)
        return found, score[found]


def _shard_results(n_docs: int, n_terms: int, top: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def work() -> Iterator[pa.RecordBatch]:
            whole = next((r for r in held if r["term"] is None), None)
            lists = [r for r in held if r["term"] is not None]
            if whole is None or not lists:
                return
            lengths = whole["counts"].astype(np.int64)
            fits = 90 * n_docs * int(lengths.max()) < 1 << 63
            m = 10 + (90 * lengths * n_docs // n_terms if fits else np.array([90 * n * n_docs // n_terms for n in lengths.tolist()], np.int64))
            weighted, items = [], {}
            for k, r in enumerate(lists):
                places, tf = r["places"], r["counts"].astype(np.int64)
                weighted.append((places, r["w"] * (1_000_000_000 * tf // (1000 * tf + 8 * m[places]))))
                for item in r["items"]:
                    items.setdefault(item, []).append(k)
            shard = Shard(weighted, len(lengths), top)
            ids = whole["ids"].as_py()
            order = np.array([math.inf if x is None else x for x in ids]) if None in ids else np.array(ids, np.int64)
            for item, query in items.items():
                places, scores = shard.search(query)
                best = np.lexsort((order[places], -scores))[:top]
                yield pa.RecordBatch.from_pydict({"item": [item] * len(best), "doc_id": [ids[p] for p in places[best]], "score": scores[best].tolist()},
                                                 pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())]))

        for batch in batches:
            col = {c: batch.column(c) for c in batch.schema.names}
            plain = {c: col[c].to_pylist() for c in ("shard", "block", "term", "w", "items")}
            for k in range(batch.num_rows):
                row = {c: v[k] for c, v in plain.items()} | {"ids": col["ids"][k], "counts": col["counts"][k].values.to_numpy(),
                                                             "places": (col["places"][k].values or pa.array([], pa.int32())).to_numpy()}
                if held and (row["shard"], row["block"]) != (held[0]["shard"], held[0]["block"]):
                    yield from work()
                    held = []
                held.append(row)
        if held:
            yield from work()

    return run


def search(index: DataFrame, items: DataFrame, top: int = TOP, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of the index for each item."""
    wholes = index.where(F.col("term").isNull())
    n_docs, n_terms = wholes.agg(F.coalesce(F.sum(F.size("ids").cast("bigint")), F.lit(0)),
                                 F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda s, x: s + x))).first()
    wanted = materialize(item_terms(items, item_id, text), "search-items")
    numbered = materialize(wanted.select("item_id").distinct().select("item_id", F.monotonically_increasing_id().alias("item")), "search-numbers")
    n_blocks = 1 + wanted.count() // BLOCK_TERMS
    block = F.pmod(F.xxhash64("item"), F.lit(n_blocks)).cast("int").alias("block")
    by_term = wanted.join(numbered, wanted["item_id"].eqNullSafe(numbered["item_id"])).groupBy("term", block).agg(F.collect_list("item").alias("items"))
    asked = broadcast_if_small(wanted.select("term").distinct(), QUERY_TERMS)
    lists = materialize(index.where(F.col("term").isNotNull()).join(asked, "term").select("shard", "term", "places", "counts"), "search-lists")
    df = lists.groupBy("term").agg(F.sum(F.size("places").cast("bigint")).alias("df"))
    ratio = F.lit(2 * n_docs + 2).cast("double") / (2 * F.col("df") + 1).cast("double")
    weights = df.select("term", F.floor(1000 * F.ln(ratio)).cast("bigint").alias("w")).where("w > 0")
    fetched = lists.join(weights.join(by_term, "term"), "term").select("shard", "block", "term", "places", "counts", F.lit(None).cast("array<bigint>").alias("ids"), "w", "items")
    every = wholes.select("shard", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), "term", "places", "counts", "ids",
                          F.lit(None).cast("bigint").alias("w"), F.lit(None).cast("array<bigint>").alias("items"))
    rows = fetched.unionByName(every).repartition("shard", "block").sortWithinPartitions("shard", "block")
    found = rows.mapInArrow(_shard_results(n_docs, n_terms, top), "item bigint, doc_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = found.withColumn("rank", rank).where(F.col("rank") <= top)
    return best.join(numbered, "item").select("item_id", "rank", "doc_id", "score")
