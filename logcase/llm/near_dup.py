"""MinHash near-duplicates with sequential Bayesian verification.

1. Every text becomes the set of its 5-word shingles (64-bit hashes), and from it: a digest of the set, 128 min-hashes
   in 32 bands of 4, and 512 bins that each hold 8 bits of the smallest hash that falls into them.
2. Equal sets form a class with its smallest id; only one row per class goes on, so copies cost nothing further.
3. Classes that share a band are candidates. Band buckets are dealt in blocks of bounded size; in a block, batches of
   64 bins are compared pair by pair, and a pair is given up as soon as the posterior probability of a similarity at
   the threshold falls below ``MISS``. First each block proposes only a spanning forest of its likeliest pairs, which
   is verified on the full sets; then only members of different components are compared, again in blocks, and all
   survivors are verified. No bucket is ever expanded into all its pairs, and none is capped.
4. Connected components over the verified links give each document the smallest id it can reach.

Chance of losing a link at exactly the threshold: (1 - 0.75**4)**32 = 5e-6 in the bands and ``MISS`` a batch.

Ids must be integers. Defined results: null and empty texts have no shingles, link with nothing and stay; fewer words
than five make one shingle of all of them. Rows that repeat an id are one node that has all their links; a null id
links with nothing, has a null component and stays. An empty table gives an empty table. Only id and text are read by
the search, so other columns cannot clash. A very long text is one row with its whole set.
"""
from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logcase.llm.common import text_of
from logcase.llm.components import components
from logcase.plans.sizing import broadcast_if_small, materialize

WIDTH = 5
#: Links: 100 * intersection >= SIMILARITY_PCT * union.
SIMILARITY_PCT = 75
ROWS, BANDS = 4, 32
BINS, BATCH = 512, 64
#: A pair is given up when it reaches the similarity with less than this posterior probability.
MISS = 1e-5
#: Unions of more elements are taken for endless beside the ``BINS`` elements that are seen of them.
MOST_UNION = 1 << 15
BLOCK = 256
#: Ids wanted from the documents are broadcast up to this many rows, and joined by shuffling beyond.
WANTED_ROWS = 2_000_000
_PIECE = 4 << 20
_STEP = 1 << 16


def _odd(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit multipliers."""
    return np.array([xxhash.xxh64_intdigest(f"{seed}:{i}") | 1 for i in range(n)], np.uint64)


class WordHashes(dict):
    """64-bit hashes of words; emptied when it grows beyond a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    def __init__(self, width: int = WIDTH) -> None:
        self.width, self.words, self.factors = width, WordHashes(), _odd(1, width + 1)

    def shingles(self, text: bytes) -> np.ndarray:
        """The sorted distinct shingle hashes of a text."""
        text, parts, at = text.lower(), [], 0  # of bytes, lower() changes A-Z alone
        while at < len(text):
            end = len(text) if len(text) - at <= _PIECE else min(
                (x for x in (text.find(c, at + _PIECE) for c in (b" ", b"\n")) if x >= 0), default=len(text))
            w = text[at:end].split()
            parts.append(np.fromiter(map(self.words.__getitem__, w), np.uint64, len(w)))
            at = end
        h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        if not len(h):
            return h
        if len(h) < self.width:
            return np.array([xxhash.xxh64_intdigest(h.tobytes())], np.uint64)
        n = len(h) - self.width + 1
        s = h[:n] * self.factors[0]
        for k in range(1, self.width):
            s += h[k: n + k] * self.factors[k]
        s ^= s >> np.uint64(32)
        s *= self.factors[-1]
        s ^= s >> np.uint64(29)
        s.sort()
        return s[np.concatenate([[True], s[1:] != s[:-1]])]


class Sketcher:
    """Bands and bins of many sets at once."""

    def __init__(self) -> None:
        self.a, self.b = _odd(2, ROWS * BANDS), _odd(3, ROWS * BANDS)
        self.keep = _odd(4, 1)[0]

    def sketch(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """A row of band keys and a row of bins for each (non-empty) set."""
        sizes = np.array([len(s) for s in sets])
        starts = np.cumsum(sizes) - sizes
        u = np.concatenate(sets)
        least = np.full((len(self.a), len(sets)), np.iinfo(np.uint64).max, np.uint64)
        for low in range(0, len(u), _STEP):  # pieces that stay in the cache
            piece = u[low: low + _STEP]
            first = int(np.searchsorted(starts, low, "right")) - 1
            last = int(np.searchsorted(starts, low + len(piece), "left"))
            cuts = np.maximum(starts[first:last] - low, 0)
            buffer = np.empty_like(piece)
            for k in range(len(self.a)):
                np.multiply(piece, self.a[k], out=buffer)
                np.add(buffer, self.b[k], out=buffer)
                row = least[k, first:last]
                np.minimum(row, np.minimum.reduceat(buffer, cuts), out=row)
        short = ((least * self.keep) >> np.uint64(48)).astype("<u2")
        bands = np.ascontiguousarray(short.T).view("<i8").reshape(len(sets), BANDS)
        bins = np.zeros((len(sets), BINS), np.uint8)
        owner = np.repeat(np.arange(len(sets)), sizes)
        slot = (u >> np.uint64(64 - 9)).astype(np.int64)  # sets are sorted, so a slot's first hash is its smallest
        place = owner * BINS + slot
        firsts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        bins.reshape(-1)[place[firsts]] = ((u[firsts] * self.keep) >> np.uint64(32)) % np.uint64(255) + np.uint64(1)
        return bands, bins


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_of(docs).alias("body"))


def sketches(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, digest of the set, band keys, bins (the last three null without words)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sketcher = Shingler(), Sketcher()
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                sets = [shingler.shingles(x.as_py().encode()) for x in part.column(1)]
                full = [k for k, s in enumerate(sets) if len(s)]
                digest: list = [None] * len(sets)
                keys: list = [None] * len(sets)
                held: list = [None] * len(sets)
                if full:
                    bands, bins = sketcher.sketch([sets[k] for k in full])
                    for k, x, y in zip(full, bands.tolist(), bins):
                        digest[k], keys[k], held[k] = hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest(), x, y.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()),
                     pa.array(keys, pa.list_(pa.int64())), pa.array(held, pa.binary())], ["doc_id", "n_shingles", "digest", "bands", "bins"])

    return _texts(docs).mapInArrow(run, "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>, bins binary")


@functools.lru_cache(maxsize=4096)
def _needed_of_union(union: int, miss: float) -> np.ndarray:
    """``needed_matches`` for every number of bins seen, of a union of so many elements (0: far more than the bins).

    Candidates share a band already, so the prior leans to similar pairs: density 1 / (1 - similarity), Beta(1, 0). After
    m matches among n elements of the union drawn without replacement, the posterior probability of the similarity t
    is then P(H <= m), H counting the marked elements among n drawn from a union of which the share t is marked (of an
    endless union, H is binomial). So ``miss`` also bounds the chance to give up any one pair that just links. The least
    m whose probability is not below ``miss`` is looked up for each n."""
    n, m = np.arange(BINS + 1)[:, None], np.arange(BINS + 1)[None, :]
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, max(union, BINS) + 1)))])

    def choose(x: int | np.ndarray, y: np.ndarray) -> np.ndarray:
        inside = (y >= 0) & (y <= x)
        y = np.where(inside, y, 0)
        return np.where(inside, logs[x] - logs[y] - logs[np.maximum(x - y, 0)], -np.inf)

    if union:
        marked, drawn = SIMILARITY_PCT * union // 100, np.minimum(n, union)
        p = np.exp(choose(marked, m) + choose(union - marked, drawn - m) - choose(union, drawn))
    else:
        t = SIMILARITY_PCT / 100
        p = np.exp(choose(n, m) + m * math.log(t) + (n - m) * math.log1p(-t))
    return (np.cumsum(p, axis=1) < miss).sum(1)


def _union_bound(total: np.ndarray) -> np.ndarray:
    """The size of the union of two sets with ``total`` elements together that just reach the similarity, rounded up to
    one of few sizes (a larger union leaves more doubt, so nothing more is given up); 0 for very large ones."""
    union = total * 100 // (100 + SIMILARITY_PCT)
    step = 1 << np.maximum(np.frexp(np.maximum(union, 1))[1] - 5, 0).astype(np.int64)  # 16 to 32 sizes to each doubling
    return np.where(union > MOST_UNION, 0, np.maximum(-(-union // step) * step, 1))


def needed_matches(seen: np.ndarray, total: np.ndarray, miss: float = MISS) -> np.ndarray:
    """The fewest matches with which a pair goes on, after ``seen`` bins that either set fills, for sets of ``total``
    elements together: with fewer, the posterior probability that the pair reaches the similarity is below ``miss``.

    The filled bins show a random sample of the union, drawn without replacement; see ``_needed_of_union``."""
    union = _union_bound(total)
    out = np.zeros(len(seen), np.int64)
    for u in np.unique(union).tolist():
        here = union == u
        out[here] = _needed_of_union(u, miss)[seen[here]]
    return out


def survivors(i: np.ndarray, j: np.ndarray, bins: np.ndarray, sizes: np.ndarray, miss: float = MISS) -> tuple[np.ndarray, ...]:
    """The pairs (i, j) that pass every batch, with their share of matching bins."""
    ok = np.minimum(sizes[i], sizes[j]) * 100 >= np.maximum(sizes[i], sizes[j]) * SIMILARITY_PCT
    i, j = i[ok], j[ok]
    same, seen, total = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64), sizes[i] + sizes[j]
    for low in range(0, BINS, BATCH):
        x, y = bins[i, low: low + BATCH], bins[j, low: low + BATCH]
        same += ((x == y) & (x > 0)).sum(1)
        seen += ((x | y) > 0).sum(1)
        ok = same >= needed_matches(seen, total, miss)
        if not ok.all():
            i, j, same, seen, total = i[ok], j[ok], same[ok], seen[ok], total[ok]
    return i, j, same / np.maximum(seen, 1)


def spanning(i: np.ndarray, j: np.ndarray, weight: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A spanning forest of the heaviest pairs."""
    top = list(range(n))

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    out = []
    for k in np.argsort(-weight, kind="stable").tolist():
        a, b = root(int(i[k])), root(int(j[k]))
        if a != b:
            top[a] = b
            out.append((int(i[k]), int(j[k])))
            if len(out) == n - 1:
                break
    return out


def _by_group(n_keys: int, work: Callable[[dict[str, np.ndarray]], list[tuple[int, int]]]) -> Callable:
    """For rows sorted by their first ``n_keys`` columns: calls ``work`` with the columns of each group; pairs come out.
    The last column holds the bins; a column ``bands`` becomes a matrix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def groups(table: pa.Table, final: bool) -> tuple[list[tuple[int, int]], pa.Table]:
            names = table.column_names
            cols = {c: table.column(c).to_numpy() for c in names[:-1] if c != "bands"}
            if "bands" in names:
                cols["bands"] = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
            bins = np.frombuffer(b"".join(table.column(names[-1]).to_pylist()), np.uint8).reshape(-1, BINS)
            change = np.zeros(table.num_rows, bool)
            change[0] = True
            for c in names[:n_keys]:
                change[1:] |= cols[c][1:] != cols[c][:-1]
            starts = np.flatnonzero(change)
            ends = [*starts[1:].tolist(), table.num_rows] if final else starts[1:].tolist()
            found: list[tuple[int, int]] = []
            for a, b in zip(starts.tolist(), ends):
                if b - a > 1:
                    found += work({c: v[a:b] for c, v in cols.items()} | {"bins": bins[a:b]})
            return found, table.slice(0 if final else int(starts[-1]))

        def pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
            once = sorted(set(found))
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in once], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None and rest.num_rows else table
            if table.num_rows:
                found, rest = groups(table, False)
                yield pairs(found)
        if rest is not None and rest.num_rows:
            yield pairs(groups(rest, True)[0])

    return run


def _forest(g: dict[str, np.ndarray], miss: float) -> list[tuple[int, int]]:
    """The likeliest pairs of a block, as many as connect what can be connected."""
    i, j = np.triu_indices(len(g["rep"]), 1)
    i, j, w = survivors(i, j, g["bins"], g["n"], miss)
    rep = g["rep"]
    return [(int(min(rep[a], rep[b])), int(max(rep[a], rep[b]))) for a, b in spanning(i, j, w, len(rep))]


def _across(g: dict[str, np.ndarray], miss: float) -> list[tuple[int, int]]:
    """The pairs of two blocks (or of one with itself) whose members are not yet connected. A pair that shares several
    bands is compared in the first of them alone."""
    i, j = np.triu_indices(len(g["rep"]), 1)
    ok = g["comp"][i] != g["comp"][j]
    if g["gi"][0] != g["gj"][0]:
        ok &= g["me"][i] != g["me"][j]
    i, j = i[ok], j[ok]
    here = int(g["band"][0])
    earlier = np.zeros(len(i), bool)
    for band in range(here):
        earlier |= g["bands"][i, band] == g["bands"][j, band]
    i, j, _ = survivors(i[~earlier], j[~earlier], g["bins"], g["n"], miss)
    rep = g["rep"]
    return list({(int(min(rep[a], rep[b])), int(max(rep[a], rep[b]))) for a, b in zip(i, j)})


def _grouped(rows: DataFrame, keys: list[str], work: Callable) -> DataFrame:
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(_by_group(len(keys), work), "a bigint, b bigint").where("a < b").distinct()


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose full shingle sets reach the similarity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                sets = [shingler.shingles(x.as_py().encode()).view(np.int64) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "set"])

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = _texts(docs).join(broadcast_if_small(wanted, WANTED_ROWS), "doc_id", "left_semi")
    sets = materialize(texts.mapInArrow(run, "id bigint, set array<bigint>"), "shingle-sets")
    one = sets.select(F.col("id").alias("a"), F.col("set").alias("x"))
    two = sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    return pairs.join(one, "a").join(two, "b").where(
        common * 100 >= (F.size("x") + F.size("y") - common) * SIMILARITY_PCT).select("a", "b").distinct()


def _same_id(sketched: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of rows that repeat an id with different texts."""
    own = sketched.select("doc_id", "digest").join(classes.select("digest", "rep"), "digest").select("doc_id", "rep")
    several = own.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("doc_id", "a")
    return own.join(several, "doc_id").where("a < rep").select("a", F.col("rep").alias("b"))


def near_duplicates(docs: DataFrame, miss: float = MISS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept. ``miss``: the posterior probability of a link below
    which a candidate pair is given up, at each of at most ``BINS / BATCH`` looks."""
    sketched = materialize(sketches(docs), "sketches")
    classes = materialize(sketched.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull()).groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("bins").alias("bins")), "classes")
    banded = classes.select("rep", F.posexplode("bands").alias("band", "key"))
    sizes = banded.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1")
    members = materialize(banded.join(sizes, ["band", "key"]), "bucket-members")
    bins = classes.select("rep", "n", "bins")
    block = F.pmod(F.xxhash64("rep", "band"), F.ceil(F.col("size") / BLOCK)).alias("block")
    rows = members.select("band", "key", block, "rep").join(bins, "rep").select("band", "key", "block", "rep", "n", "bins")
    first = materialize(_grouped(rows, ["band", "key", "block"], functools.partial(_forest, miss=miss)), "likely-pairs")
    label = components(verified(first, docs).union(_same_id(sketched, classes)))

    member = members.join(label.withColumnRenamed("node", "rep"), "rep", "left").select(
        "band", "key", "rep", F.coalesce("component", "rep").alias("comp"))
    share = member.groupBy("band", "key", "comp").agg(F.count("*").alias("k"))
    mixed = share.groupBy("band", "key").agg(F.count("*").alias("comps"), F.max(F.struct("k", "comp")).alias("top"), F.sum("k").alias("size")) \
        .where("comps > 1").select("band", "key", F.col("top.comp").alias("main"), F.ceil(F.col("top.k") / BLOCK).cast("int").alias("n_main"),
                                   F.ceil((F.col("size") - F.col("top.k")) / BLOCK).cast("int").alias("n_rest"))
    # Blocks 0 .. n_rest-1 hold the members outside the bucket's largest component, the next n_main those inside.
    inside, spread = F.col("comp") == F.col("main"), F.xxhash64("rep", "band")
    me = F.when(inside, F.col("n_rest") + F.pmod(spread, "n_main")).otherwise(F.pmod(spread, "n_rest")).cast("int")
    others = F.when(inside, F.sequence(F.lit(0), F.col("n_rest") - 1)).otherwise(F.sequence(F.lit(0), F.col("n_rest") + F.col("n_main") - 1))
    dealt = member.join(mixed, ["band", "key"]).withColumn("me", me).withColumn("other", F.explode(others)).select(
        "band", "key", F.least("me", "other").alias("gi"), F.greatest("me", "other").alias("gj"), "me", "rep", "comp")
    rows = dealt.join(classes.select("rep", "n", "bands", "bins"), "rep").select("band", "key", "gi", "gj", "me", "comp", "rep", "n", "bands", "bins")
    second = _grouped(rows, ["band", "key", "gi", "gj"], functools.partial(_across, miss=miss)).join(first, ["a", "b"], "left_anti")
    more = verified(materialize(second, "other-pairs"), docs)
    label = components(label.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))

    of_class = classes.join(label, classes["rep"] == label["node"], "left").select("digest", F.coalesce("component", "rep").alias("of"))
    out = sketched.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("of", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: the one with its smallest id (all rows of that id)."""
    gone = near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("bigint") == gone["gone"], "left_anti")
