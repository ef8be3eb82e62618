"""Benchmark decontamination: an FM-index per shard of documents, searched backwards for every benchmark window.

Documents stay where they are: a task gathers the word symbols of some megabytes of text into an index, searches all
windows at once, locates the occurrences by sampled suffix places and merges them into removal spans. Words that no
benchmark item holds cannot be part of an occurrence: they end a run, and only runs as long as the shortest window
enter the index; equal runs enter once. The benchmark is cut into blocks of ``BLOCK_BYTES`` by hash after its total
size has been summed; each block is collected and broadcast by itself, and the hits of earlier blocks ride along.

A word is a run of 0-9, a-z and non-ASCII characters after A-Z is lower-cased. A window is ``width`` consecutive words
of an item; a shorter item is one window; an item without words has none.

Defined results: null and empty texts have no words and no hits. Repeated documents are judged alike, each by itself;
rows that repeat an item id are one item with the windows of all its texts; a null item id counts as the empty string.
Empty documents give an empty table; an empty benchmark gives no hits. Other columns pass unchanged, whatever their
names. Texts of any length are read whole: a long run is cut into pieces that overlap by a window.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from logcase.llm.common import text_of
from logcase.llm.fm_index import FMIndex
from logcase.plans.sizing import materialize

WIDTH = 10
BLOCK_BYTES = 64 << 20
SHARD_WORDS = 1 << 20
SHARD_BYTES = 48 << 20
PIECE_BYTES = 4 << 20

#: To words and blanks: A-Z lower-cased, digits, letters and non-ASCII bytes as they are, all else blank.
_WORDS = bytes(b if b > 127 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class Windows:
    """The distinct windows of a block of items, as symbols: 2 and up, 1 is the break between runs."""

    def __init__(self, items: list[tuple[str, str]], width: int = WIDTH) -> None:
        self.symbol: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            w = [self.symbol.setdefault(x, len(self.symbol) + 2) for x in words(text.encode())]
            for k in range(max(1, len(w) - width + 1) if w else 0):
                owners.setdefault(tuple(w[k: k + width]), set()).add(item)
        self.sigma = len(self.symbol) + 2
        self.by_size: dict[int, tuple[np.ndarray, list[list[str]]]] = {}
        for size in sorted({len(k) for k in owners}):
            own = [(k, sorted(v)) for k, v in owners.items() if len(k) == size]
            self.by_size[size] = np.array([k for k, _ in own], np.int64), [v for _, v in own]

    def symbols(self, text: bytes) -> np.ndarray:
        """One symbol a word; 1 for a word that no item holds."""
        parts, at = [], 0
        get = self.symbol.get
        plain = text.translate(_WORDS)
        while at < len(plain) or not parts:
            end = len(plain) if len(plain) - at <= PIECE_BYTES else plain.find(b" ", at + PIECE_BYTES)
            end = len(plain) if end < 0 else end
            w = plain[at:end].split()
            parts.append(np.fromiter((get(x, 1) for x in w), np.int32, len(w)))
            at = end + 1
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


class Shard:
    """Runs of known words from many documents, searched together. ``hits``: document number to (first word, end, items)."""

    def __init__(self, windows: Windows) -> None:
        self.windows = windows
        self.shortest, self.longest = min(windows.by_size, default=0), max(windows.by_size, default=0)
        self.runs: dict[bytes, list[tuple[int, int]]] = {}
        self.held = 0
        self.hits: dict[int, list[tuple[int, int, list[str]]]] = {}

    def add(self, docs: list[int], symbols: list[np.ndarray]) -> None:
        if not self.longest or not docs:
            return
        sizes = np.array([len(s) + 1 for s in symbols])
        starts = np.cumsum(sizes) - sizes
        known = np.ones(int(sizes.sum()) + 1, np.int32)
        for at, s in zip(starts.tolist(), symbols):
            known[at: at + len(s)] = s
        edges = np.diff((known > 1).astype(np.int8), prepend=np.int8(0))
        first, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        long = end - first >= self.shortest
        first, end = first[long], end[long]
        owner = np.searchsorted(starts, first, "right") - 1
        for a, b, d in zip(first.tolist(), end.tolist(), owner.tolist()):
            while True:  # a run longer than a shard goes in by overlapping pieces
                c = min(b, a + SHARD_WORDS)
                run = known[a:c].tobytes()
                places = self.runs.setdefault(run, [])
                if not places:
                    self.held += c - a + 1
                places.append((docs[d], a - int(starts[d])))
                if self.held >= SHARD_WORDS:
                    self.search()
                if c == b:
                    break
                a = c - self.longest + 1

    def search(self) -> None:
        """Builds the index of the runs held, finds every window, and lets go of the runs."""
        if self.runs:
            runs = [np.frombuffer(r, np.int32) for r in self.runs]
            ends = np.cumsum([len(r) + 1 for r in runs])
            begins = ends - [len(r) + 1 for r in runs]
            text = np.ones(int(ends[-1]), np.int64)
            for at, r in zip(begins.tolist(), runs):
                text[at: at + len(r)] = r
            index = FMIndex(text, self.windows.sigma)
            owners = list(self.runs.values())
            for size, (patterns, items) in self.windows.by_size.items():
                which, place = index.occurrences(patterns)
                run = np.searchsorted(ends, place, "right")
                for w, r, k in zip(which.tolist(), run.tolist(), (place - begins[run]).tolist()):
                    for doc, at in owners[r]:
                        self.hits.setdefault(doc, []).append((at + k, at + k + size, items[w]))
        self.runs, self.held = {}, 0


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans joined, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the characters from the first to the last word of each span of word numbers."""
    data = text.encode()
    inside = np.frombuffer(data.translate(_WORDS), np.uint8) != 32
    edges = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    first, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    out, at = [], 0
    for a, b in spans:
        out.append(data[at: first[a]])
        at = end[b - 1]
    return b"".join([*out, data[at:]]).decode()


_SPAN = StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])
_FOUND = StructType([StructField("n_words", LongType()), StructField("spans", ArrayType(_SPAN)), StructField("items", ArrayType(StringType()))])


def _search_block(body: DataFrame, items: list[tuple[str, str]], width: int) -> DataFrame:
    """``body`` (row, body, found) with the hits of one block added to ``found``."""
    shared = body.sparkSession.sparkContext.broadcast(items)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(shared.value, width)
        shard, waiting, held, n = Shard(windows), [], 0, 0

        def results() -> Iterator[pa.RecordBatch]:
            shard.search()
            at = 0
            for batch, counts in waiting:
                found = []
                for old, count in zip(batch.column(2).to_pylist(), counts):
                    hits = shard.hits.get(at, ())
                    at += 1
                    spans = [(h[0], h[1]) for h in hits] + [(s["start"], s["end"]) for s in old["spans"]]
                    ids = {i for h in hits for i in h[2]} | set(old["items"])
                    found.append({"n_words": count, "spans": [{"start": a, "end": b} for a, b in merged(spans)], "items": sorted(ids)})
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, batch.schema.field(2).type)], schema=batch.schema)
            shard.hits = {}

        for batch in batches:
            docs, symbols, size, counts = [], [], 0, []
            for k, x in enumerate(batch.column(1)):
                text = x.as_py().encode()
                s = windows.symbols(text)
                counts.append(len(s))
                docs.append(n + k)
                symbols.append(s)
                size += len(text)
                held += len(text)
                if size >= PIECE_BYTES:
                    shard.add(docs, symbols)
                    docs, symbols, size = [], [], 0
            shard.add(docs, symbols)
            waiting.append((batch, counts))
            n += batch.num_rows
            if held >= SHARD_BYTES:
                yield from results()
                waiting, held, n = [], 0, 0
        yield from results()

    return body.mapInArrow(search, body.schema)


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` in a struct ``row``, the text read as ``body``, and ``found``: n_words, merged spans of word numbers
    (end exclusive) and the ids of the items found, sorted."""
    rest = [docs[c] for c in docs.columns if c != "text"] or [F.lit(0).alias("_")]
    empty = F.struct(F.lit(0).cast("bigint").alias("n_words"), F.array().cast(ArrayType(_SPAN)).alias("spans"),
                     F.array().cast("array<string>").alias("items"))
    body = docs.select(F.struct(*rest).alias("row"), text_of(docs).alias("body"), empty.cast(_FOUND).alias("found"))
    items = benchmark.select(F.coalesce(benchmark["item_id"].cast("string"), F.lit("")).alias("id"), text_of(benchmark).alias("t"))
    total = items.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("id", "t"), F.lit(blocks)) == k)
        body = _search_block(body, [(r["id"], r["t"]) for r in part.collect()], width)
        if k + 1 < blocks:
            body = materialize(body, f"leaks-{k}")
    return body


def remove_leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` without the benchmark's words in ``text``; ``n_chars`` (if there) is counted anew where words went."""
    found = find_leaks(docs, benchmark, width)
    schema = StructType([*found.schema.fields[:1], StructField("body", StringType()), StructField("hit", IntegerType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, hit = [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).field("spans").to_pylist()):
                hit.append(len(spans))
                texts.append(without(text, [(s["start"], s["end"]) for s in spans]) if spans else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(hit, pa.int32())], ["row", "body", "hit"])

    out = found.mapInArrow(cut, schema)
    cols = []
    for c in docs.columns:
        old = F.col("row").getField(c) if c != "text" else F.col("body")
        cols.append((F.when(F.col("hit") > 0, F.char_length("body").cast(docs.schema[c].dataType)).otherwise(old) if c == "n_chars" else old).alias(c))
    return out.select(*cols)


def leak_report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, digest of the item ids, contaminated."""
    found = find_leaks(docs.select("doc_id", "text"), benchmark, width)
    hit = F.aggregate("found.spans", F.lit(0).cast("bigint"), lambda t, s: t + s["end"] - s["start"])
    return found.select("row.doc_id", "found.n_words", hit.alias("n_hit"), F.size("found.items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("found.items", ",").cast("binary"), 256).alias("items_sha256")) \
        .withColumn("contaminated", F.col("n_hit") > 0)
