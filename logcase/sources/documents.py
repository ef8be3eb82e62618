"""Whole-file JSON documents that wrap a list of events.

A file is a document when its entire text is one JSON value. Its events are then:

1. a list -> its items;
2. an object whose ``data`` is a list -> ``data``;
3. an object whose ``results`` is a non-empty list: when ``results[0]`` is an
   object with a list ``events`` -> only ``results[0].events``; else when
   ``results[0]`` is an object -> ``results``;
4. an object whose ``events`` is a list -> ``events``;
5. otherwise the file is read line by line after all.

String items are passed on as they are, other items as their JSON text. Of a
repeated key the last value counts (inside ``results[0]``: the last list).

No file is held whole, compressed or not. Spark reads it in pieces between
commas, which any JSON text has at least one of per item, sorted by place within
the task that decodes the file; the decoder passes on each item as it closes and
keeps one item at a time. Which list holds the events, and whether the text is
JSON to its end, is known at the end only: items are written with the number of
their list, and a last row per file names the list that counts. An item or
skipped value of more than ``MOST_ITEM_CHARS`` characters raises an error that
names file and place; a file is never read as lines because it was too large.
"""
from __future__ import annotations

import itertools
import json
import re
from collections.abc import Generator, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logcase.plans.sizing import broadcast_if_small, materialize
from logcase.sources.discover import as_literal, normalise_path

#: Characters of one item (Spark's VARIANT, which items are parsed into, ends at 128 MiB).
MOST_ITEM_CHARS = 128 << 20
#: Items, and characters, that one output batch holds at most (one item may be larger).
_BATCH_ITEMS, _BATCH_CHARS = 4096, 4 << 20
_GROW = 1 << 16
#: Files that are documents are broadcast up to this many, and joined by shuffling beyond.
_FILES = 1_000_000
_BLANK = re.compile(r"[ \t\n\r]*")
_WRAPPERS = ("data", "results", "events")

Items = Generator[tuple[int, str], None, int | None]


class DocumentItemTooLarge(ValueError):
    """One item of a document is larger than can be parsed."""


class _NotJson(ValueError):
    pass


class _Text:
    """The text still to be read, drawn from pieces as needed."""

    def __init__(self, pieces: Iterator[str]) -> None:
        self.pieces, self.text, self.at, self.passed = pieces, "", 0, 0
        self.kept: list[str] | None = None
        self.decode = json.JSONDecoder().raw_decode

    def grow(self) -> bool:
        """Drops what was read and draws as much again as is left; False at the end."""
        self.passed += self.at
        parts, wanted = [self.text[self.at:]], max(_GROW, len(self.text) - self.at)
        for piece in self.pieces:
            parts.append(piece)
            wanted -= len(piece)
            if wanted <= 0:
                break
        self.text, self.at = "".join(parts), 0
        return len(self.text) > len(parts[0])

    def take(self, end: int) -> str:
        out = self.text[self.at:end]
        if self.kept is not None:
            self.kept.append(out)
        self.at = end
        return out

    def peek(self) -> str:
        """The next character that is not blank; '' at the end."""
        while True:
            self.take(_BLANK.match(self.text, self.at).end())
            if self.at < len(self.text):
                return self.text[self.at]
            if not self.grow():
                return ""

    def mark(self, allowed: str) -> str:
        """Takes the next character, which must be one of these."""
        found = self.peek()
        if not found or found not in allowed:
            raise _NotJson
        return self.take(self.at + 1)

    def value(self) -> str:
        """Takes the text of the next value."""
        self.peek()
        while True:
            try:
                _, end = self.decode(self.text, self.at)
                # a number may go on in the next piece, also behind its point or exponent mark
                whole = end < len(self.text) and (self.text[end] in ",]} \t\n\r" or len(self.text) - end > 3)
            except json.JSONDecodeError as e:
                # what is wrong well before the end of the text is wrong for good
                if not e.msg.startswith("Unterminated string") and len(self.text) - e.pos > 16 and self.text[e.pos:].strip():
                    raise _NotJson from e
                end, whole = None, False
            except RecursionError as e:
                raise _NotJson from e
            if whole:
                return self.take(end)
            if len(self.text) - self.at > MOST_ITEM_CHARS:
                raise DocumentItemTooLarge(f"a value at character {self.passed + self.at} is larger than {MOST_ITEM_CHARS} characters")
            length = None if end is None else end - self.at
            if not self.grow():
                if length is None:
                    raise _NotJson
                return self.take(self.at + length)


def _list(text: _Text, slot: int) -> Items:
    """The items of the list that comes next; returns their number."""
    text.mark("[")
    n = 0
    if text.peek() == "]":
        text.mark("]")
        return 0
    while True:
        yield slot, text.value()
        n += 1
        if text.mark(",]") == "]":
            return n


def _keys(text: _Text) -> Iterator[str]:
    """The keys of the object that comes next; the caller takes the value after each."""
    text.mark("{")
    if text.peek() == "}":
        text.mark("}")
        return
    while True:
        if text.peek() != '"':
            raise _NotJson
        key = json.loads(text.value())
        text.mark(":")
        yield key
        if text.mark(",}") == "}":
            return


def _results(text: _Text, slots: Iterator[int]) -> Items:
    """The items of ``results``, or the events in its first item; returns the number of the list that counts, if any."""
    slot, inner = next(slots), None
    text.mark("[")
    if text.peek() == "]":
        text.mark("]")
        return None
    wrapped = text.peek() == "{"
    if wrapped:
        text.kept = []
        for key in _keys(text):
            if key == "events" and text.peek() == "[":
                inner, text.kept = next(slots), None
                yield from _list(text, inner)
            else:
                text.value()
        if inner is None:
            first, text.kept = "".join(text.kept), None
            yield slot, first
    else:
        text.value()
    while text.mark(",]") == ",":
        item = text.value()
        if wrapped and inner is None:
            yield slot, item
    return (inner or slot) if wrapped else None


def _document(text: _Text) -> Items:
    """(number of a list, text of an item) for every list that may hold the events; returns the number of the one that
    does, or None for what is no document."""
    slots = itertools.count(1)
    first = text.peek()
    if first == "[":
        chosen = next(slots)
        yield from _list(text, chosen)
    elif first == "{":
        found: dict[str, int | None] = {}
        for key in _keys(text):
            listed = text.peek() == "["
            if key == "results" and listed:
                found[key] = yield from _results(text, slots)
            elif key in _WRAPPERS and listed:
                found[key] = next(slots)
                yield from _list(text, found[key])
            else:
                text.value()
                found.pop(key, None)
        chosen = next((found[k] for k in _WRAPPERS if found.get(k)), None)
    else:
        return None
    return chosen if text.peek() == "" else None


def item_rows(pieces: Iterator[str]) -> Iterator[tuple[int, int, str | None]]:
    """(list, place in it from 1, item) for the pieces of a text, and at the end (list, 0, None) for the list that
    counts, if the text is a document."""
    walk, n = _document(_Text(pieces)), {}
    while True:
        try:
            slot, item = next(walk)
        except StopIteration as end:
            if end.value is not None:
                yield end.value, 0, None
            return
        except _NotJson:
            return
        n[slot] = n.get(slot, 0) + 1
        yield slot, n[slot], json.loads(item) if item[0] == '"' else item


def document_items(text: str | Iterator[str]) -> list[str] | None:
    """The event texts of a document, or None if the text is none."""
    rows = list(item_rows(iter([text]) if isinstance(text, str) else text))
    if not rows or rows[-1][1] != 0:
        return None
    return [item for slot, place, item in rows if slot == rows[-1][0] and place]


def _pieces_by_file(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[str]]]:
    """Each file's name and the pieces of its text, for rows (file, piece) in order."""
    def pieces() -> Iterator[tuple[str, str]]:
        last = None
        for batch in batches:
            names, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            start = 0
            for k in range(1, len(names) + 1):
                if k == len(names) or names[k] != names[start]:
                    text = str(b",".join(values[start:k]), "utf-8", "replace")
                    yield names[start], ("," if names[start] == last else "") + text
                    last, start = names[start], k

    for name, group in itertools.groupby(pieces(), lambda p: p[0]):
        yield name, (text for _, text in group)


def read_documents(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, line, value) of the events of those files that are documents, numbered from 1; each such file also has
    a row with line 0 and no value, so that empty documents are known too."""
    commas = spark.read.option("lineSep", ",").text([as_literal(f) for f in files]).select(
        normalise_path(F.col("_metadata.file_path"), encoded=True).alias("file"), F.col("value").cast("binary").alias("piece"),
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    dealt = commas.repartition(max(1, len(files)), "file").sortWithinPartitions("file", "start", "at").select("file", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, pieces in _pieces_by_file(batches):
            rows, size = [], 0

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(rows)), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
                     pa.array([None if r[2] is None else r[2].encode("utf-8", "replace") for r in rows], pa.binary()).cast(pa.string())],
                    ["file", "slot", "line", "value"])

            try:
                for row in item_rows(pieces):
                    rows.append(row)
                    size += len(row[2] or "")
                    if len(rows) >= _BATCH_ITEMS or size >= _BATCH_CHARS:
                        yield out()
                        rows, size = [], 0
            except DocumentItemTooLarge as e:
                raise DocumentItemTooLarge(f"{name}: {e}") from e
            if rows:
                yield out()

    found = materialize(dealt.mapInArrow(run, "file string, slot int, line bigint, value string"), "docs")
    counts = broadcast_if_small(found.where("line = 0").select("file", "slot"), _FILES)
    return found.join(counts, ["file", "slot"]).select("file", "line", "value")
