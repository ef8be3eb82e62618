"""Byte-pair encoding and decoding with content-defined chunk reuse.

A rolling hash cuts every text into chunks; a chunk's place does not depend on what stands far before it, so copies
and near copies share most chunks. Rows are range-partitioned by their smallest line hash (then id), which brings
copies into the same task, and splits any group too large for one; in a task each distinct chunk is encoded once and
its ids are kept in a cache of bounded size. A chunk boundary can fall inside a word, so each join is repaired: the
text between two safe places around it (a blank between visible characters always starts a piece of the encoder's
pattern) is encoded again, and the places move outwards until both are token boundaries of the chunks they cut.

Encoding equals the byte-level BPE of the vocabulary file with ``add_special_tokens=False``; a special token's string
in a text becomes that token. Decoding joins the bytes of the ids; bytes that are no UTF-8 become U+FFFD.

Defined results: null and empty texts have no ids and decode to the empty text. Repeated rows are encoded alike.
An empty table gives an empty table. Other columns pass unchanged, whatever their names. A very long text is encoded
whole, chunk by chunk; a text without safe places is encoded in one piece.
"""
from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from logcase.llm.common import text_of

#: A cut where these 11 bits of the rolling hash are 0: chunks of about 2 KB, within the limits below.
CUT_MASK = np.uint16(0xFFE0)
MIN_CHUNK = 512
MAX_CHUNK = 16_384
CACHE_BYTES = 32 << 20
#: Rows that a task encodes at once.
_ROWS = 128
#: The public pre-split pattern of the byte-level encoder.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_GEAR = ((np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.uint16)


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 characters stand for
    themselves, the other bytes, in order, have characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Mergeable ranks and special tokens of a byte-level BPE file whose ids follow the order of its merges."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    to_byte = byte_of_char()
    ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    merged = [spec["model"]["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    if merged != sorted(merged) or spec["normalizer"] or not spec["pre_tokenizer"].get("use_regex") \
            or spec["pre_tokenizer"].get("add_prefix_space"):
        raise ValueError(f"{path}: not a plain byte-level BPE with ids in the order of its merges")
    return ranks, special


class Vocabulary:
    """An encoder with the bytes of every id."""

    def __init__(self, ranks: dict[bytes, int], special: dict[str, int]) -> None:
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.bytes = [b""] * (max([*ranks.values(), *special.values()], default=-1) + 1)
        for token, i in [*ranks.items(), *((s.encode(), i) for s, i in special.items())]:
            self.bytes[i] = token
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)

    def ids(self, text: bytes) -> np.ndarray:
        return self.encoding.encode_to_numpy(text.decode(), allowed_special="all")

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode(errors="replace")


def rolling_cuts(data: np.ndarray) -> np.ndarray:
    """Places where the hash of the last 16 bytes asks for a cut."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8):
        h[k:] += h[:-k] << np.uint16(k)
    return np.flatnonzero((h & CUT_MASK) == 0) + 1


def safe_places(data: np.ndarray) -> np.ndarray:
    """Blanks between two visible ASCII characters."""
    seen = (data > 32) & (data < 127)
    return np.flatnonzero((data[1:-1] == 32) & seen[:-2] & seen[2:]) + 1


def chunk_bounds(data: np.ndarray, cuts: np.ndarray) -> list[int]:
    """Start of each chunk and the end of the last; ``cuts`` ascend. No chunk starts inside a character."""
    n, bounds = len(data), [0]

    def cut(at: int) -> None:
        while at < n and data[at] & 0xC0 == 0x80:
            at += 1
        if at < n:
            bounds.append(at)

    for c in cuts.tolist():
        while c - bounds[-1] > MAX_CHUNK:
            cut(bounds[-1] + MAX_CHUNK)
        if c - bounds[-1] >= MIN_CHUNK:
            cut(c)
    while n - bounds[-1] > MAX_CHUNK:
        cut(bounds[-1] + MAX_CHUNK)
    return [*bounds, n]


class ChunkEncoder:
    """Encodes texts chunk by chunk; equal chunks are encoded once as long as the cache holds them."""

    def __init__(self, vocabulary: Vocabulary, cache_bytes: int = CACHE_BYTES) -> None:
        self.vocabulary, self.cache_bytes = vocabulary, cache_bytes
        self.cache: dict[bytes, np.ndarray] = {}
        self.held = self.encoded = self.reused = 0

    def chunk(self, text: bytes) -> np.ndarray:
        ids = self.cache.get(text)
        if ids is not None:
            self.reused += 1
            return ids
        self.encoded += 1
        ids = self.vocabulary.ids(text)
        if self.held > self.cache_bytes:  # the older half goes
            for key in list(self.cache)[: len(self.cache) // 2 + 1]:
                self.held -= len(key) + self.cache.pop(key).nbytes
        self.cache[text] = ids
        self.held += len(text) + ids.nbytes
        return ids

    def encode(self, text: bytes, cuts: np.ndarray, safe: np.ndarray) -> np.ndarray:
        data = np.frombuffer(text, np.uint8)
        bounds = chunk_bounds(data, cuts)
        if len(bounds) == 2:
            return self.chunk(text)
        parts = [self.chunk(text[a:b]) for a, b in zip(bounds, bounds[1:])]
        # Token boundaries as places in the text: ends[i] is where token i ends, if the chunks are right.
        ids = np.concatenate(parts)
        ends = np.cumsum(self.vocabulary.sizes[ids])

        def boundary(place: int) -> bool:
            k = np.searchsorted(ends, place)
            return bool(k < len(ends) and ends[k] == place)

        out, done = [], 0  # the text up to ``done`` is in ``out``
        for c in bounds[1:-1]:
            if c < done:
                continue
            k = int(np.searchsorted(safe, c, "right"))
            left = k - 1
            while left >= 0 and not (safe[left] <= done or boundary(int(safe[left]))):
                left -= 1
            start = max(int(safe[left]) if left >= 0 else 0, done)
            right = int(np.searchsorted(safe, c, "left"))
            while right < len(safe) and not boundary(int(safe[right])):
                right += 1
            end = int(safe[right]) if right < len(safe) else len(text)
            if end <= done:
                continue
            a, b = (int(np.searchsorted(ends, x, "right")) for x in (done, start))
            out.append(ids[a:b])
            if end > start:
                out.append(self.vocabulary.ids(text[start:end]))
            done = end
        out.append(ids[int(np.searchsorted(ends, done, "right")):])
        return np.concatenate(out)


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text", gather: bool = True) -> DataFrame:
    """``docs`` with its columns in a struct ``row`` and ``ids``: little-endian unsigned 32-bit integers.
    ``gather``: bring likely copies together first, at the price of one shuffle of the rows."""
    body = docs.select(F.struct(*[docs[c] for c in docs.columns if c != text]).alias("row"), text_of(docs, text).alias("body")) \
        if len(docs.columns) > 1 else docs.select(F.struct(F.lit(0).alias("_")).alias("row"), text_of(docs, text).alias("body"))
    if gather:
        body = body.repartitionByRange(F.array_min(F.transform(F.split("body", "\n", -1), lambda x: F.xxhash64(x))), F.xxhash64("row"))
    schema = StructType([body.schema["row"], StructField("ids", BinaryType())])
    shared = body.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(Vocabulary(*shared.value))
        for batch in batches:
            for low in range(0, batch.num_rows, _ROWS):
                part = batch.slice(low, _ROWS)
                texts = [x.as_py().encode() for x in part.column(1)]
                whole = np.frombuffer(b"".join(texts), np.uint8)
                cuts, safe = rolling_cuts(whole), safe_places(whole)
                found, at = [], 0
                for t in texts:
                    inner = [x[np.searchsorted(x, at, "right"): np.searchsorted(x, at + len(t) - 1)] - at for x in (cuts, safe)]
                    found.append(encoder.encode(t, *inner).astype("<u4").tobytes())
                    at += len(t)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], ["row", "ids"])

    return body.mapInArrow(encode, schema)


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``encoded`` with a column ``decoded``: the text of its ``ids``."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    at = encoded.columns.index("ids")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(*shared.value)
        for batch in batches:
            for low in range(0, batch.num_rows, _ROWS):
                part = batch.slice(low, _ROWS)
                texts = [vocabulary.decode(np.frombuffer(x.as_py(), "<u4")) for x in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(decode, StructType([*encoded.schema.fields, StructField("decoded", StringType())]))


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per document its id, number of tokens, and digests of its ids and of their decoded text."""
    both = decode_documents(encode_documents(docs.select("doc_id", "text"), vocabulary), vocabulary)
    return both.select("row.doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
