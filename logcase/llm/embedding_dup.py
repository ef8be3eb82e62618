"""Near-duplicate embeddings by iterative quantisation, multi-index Hamming tables and exact reranking.

1. Equal vectors of one label collapse into a class with a count, so copies cost nothing further.
2. Iterative quantisation (principal axes, then a rotation learned in turns with the codes) is fitted on at most
   ``FIT_ROWS`` classes. Every class gets a code of at most ``CODE_BITS`` signs and the rotated coordinates. The
   rotation is orthogonal, so it never lengthens a distance: two unit vectors of cosine c differ by at most 2 - 2c,
   squared, in all coordinates together.
3. Labels of many classes are cut into blocks by node, and every pair of blocks (and each block with itself) goes to one
   task, which holds it in memory. A round deals the pairs of one distance between blocks, so a vector is on disk twice
   at most besides its class; the files of a round go before the next one begins. Entries of tables never leave a task.
4. In a task the code is cut into tables of about log2(number of members) bits. Linked vectors have, in some table, at
   most the table's share of that squared distance. Where their signs differ in a coordinate, its two magnitudes add up
   to the difference, so the squared magnitudes of one side add up to at most half of the share: each vector looks up every
   bucket that it reaches by flipping signs of at most that sum. One side then finds the other, for certain: no link is
   lost, whatever the rotation; a good one only makes magnitudes large and buckets few.
5. A pair that was found is dropped where a coordinate too large for any link differs in sign; the others are reranked by
   the cosine of the original vectors. A pair that meets in several tables counts in the first, from the side that pays
   less. Members that would look up or meet more than there is are compared with all others instead. Tasks give counts
   of links and the edges of a spanning forest, never pairs, and no bucket is capped.
6. Connected components over the edges give the smallest id.

``n_links`` of a group of near copies without equals needs each of its pairs to be compared once; copies do not.

Rows find their class by two 64-bit hashes of label and vector, so vectors are not shuffled again for the result.

Defined results: every row is a vector of its own, also where rows repeat an id; a vector that is null, empty, zero or
holds null or non-finite components, or whose label or id is null, links with nothing (``n_links`` 0, its own id as
component, kept). Vectors of different lengths do not link. Vectors of any scale count by their
direction. An empty table gives an empty table. Only the three named columns are read, so others cannot clash.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from logcase.llm.components import components
from logcase.plans.sizing import materialize

COSINE = 0.98
CODE_BITS = 64
#: Classes that the rotation is learned from, and turns of learning.
FIT_ROWS = 20_000
TURNS = 40
#: Width of a table: flips that a vector can pay multiply with it, so it stops growing where they would outweigh the
#: smaller buckets.
LEAST_TABLE_BITS, MOST_TABLE_BITS = 12, 21
#: Members of a block, and bytes of its vectors; a task holds two blocks. Small tables have smaller blocks, one per core.
BLOCK = 1 << 18
BLOCK_BYTES = 40 << 20
LEAST_BLOCK = 4096
#: Looking up one of 2 ** n flips costs about as much as comparing with this many members directly.
LOOKUP = 16
#: Comparing what one entry of an own bucket brings, over all flips, costs about as much as this many members directly.
CROWD = 400
#: Pairs and flips, exact cosines, rows that ask and rows that are compared at once.
_PAIRS, _EXACT, _ROWS, _TILE = 1 << 20, 1 << 13, 2048, 1 << 11
#: Bits of a table of buckets in memory.
_SLOT_BITS = 22
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Squared magnitudes are whole multiples of this, so that sums are exact.
_GRAIN = 2.0 ** 40


def padded(batch: pa.ListArray, width: int) -> np.ndarray:
    """The vectors as rows, zero-padded to ``width``."""
    sizes = np.diff(batch.offsets.to_numpy())
    flat = batch.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(batch), width), flat.dtype)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def units(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, by their largest component first."""
    out = rows.astype(np.float64)
    out /= np.abs(out).max(1, keepdims=True)
    return out / np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]


def _packed(vectors: pa.ListArray) -> pa.Array:
    """One binary value per row, which moves between tasks as a whole; null for a vector that cannot link."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False) + 0.0  # -0.0 becomes 0.0, null is not a number
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(vectors), 0).to_numpy())])
    some, bad = (np.diff(np.concatenate([[0], np.cumsum(x)])[ends]) > 0 for x in (flat != 0, ~np.isfinite(flat)))
    packed = pa.Array.from_buffers(pa.binary(), len(vectors), [None, pa.py_buffer((ends * flat.itemsize).astype(np.int32)), pa.py_buffer(flat)])
    return pc.if_else(pa.array(some & ~bad), packed, pa.scalar(None, pa.binary()))


def _unpacked(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """The vectors of ``_packed`` as rows, zero-padded to ``width``."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32, len(column) + 1, 4 * column.offset) // np.dtype(kind).itemsize
    flat = np.frombuffer(data, kind)[ends[0]:ends[-1]]
    return padded(pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), pa.array(flat)), width)


class Rotation:
    """A centre and an orthogonal map to at most ``CODE_BITS`` coordinates."""

    def __init__(self, centre: np.ndarray, axes: np.ndarray) -> None:
        self.centre, self.axes = centre, axes

    @classmethod
    def fit(cls, x: np.ndarray, turns: int = TURNS) -> Rotation:
        """Iterative quantisation: the codes that are nearest to the rotated points, then the rotation that brings the
        points nearest to the codes."""
        centre = x.mean(0)
        values, vectors = np.linalg.eigh((x - centre).T @ (x - centre))
        axes = vectors[:, np.argsort(-values)[:CODE_BITS]]
        flat = (x - centre) @ axes
        turn = np.linalg.qr(np.random.default_rng(0).standard_normal((axes.shape[1],) * 2))[0]
        for _ in range(turns):
            left, _, right = np.linalg.svd(np.where(flat @ turn >= 0, 1.0, -1.0).T @ flat)
            turn = (left @ right).T
        return cls(centre, axes @ turn)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre) @ self.axes).astype(np.float32)


def codes(z: np.ndarray) -> np.ndarray:
    """The signs of each row as bits, lowest coordinate first."""
    bits = np.zeros((len(z), 64), bool)
    bits[:, :z.shape[1]] = z >= 0
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1)


def costs(z: np.ndarray) -> np.ndarray:
    return np.floor(z.astype(np.float64) ** 2 * _GRAIN).astype(np.int64)


class Tables:
    """The cut of a code into substrings, and what each may spend on flips."""

    def __init__(self, n_bits: int, n_classes: int, cosine: float = COSINE) -> None:
        wanted = min(max(LEAST_TABLE_BITS, math.ceil(math.log2(max(n_classes, 2)))), MOST_TABLE_BITS)
        n = max(1, n_bits // wanted)
        self.cuts = [n_bits * k // n for k in range(n + 1)]
        # a little above the exact bounds, for the coordinates' rounding to single precision
        self.budget = int(((2 - 2 * cosine) / n / 2 + 1e-6) * _GRAIN)
        #: A sign whose squared magnitude is above this is the same in all linked vectors.
        self.most = int((2 - 2 * cosine + 1e-6) * _GRAIN)
        self.masks = np.array([(1 << high) - (1 << low) for low, high in zip(self.cuts, self.cuts[1:])], np.uint64)

    def sorted_costs(self, cost: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """(costs of a table's signs in ascending order, their bits) of each row."""
        part = cost[:, self.cuts[table]:self.cuts[table + 1]]
        order = np.argsort(part, axis=1)
        return np.take_along_axis(part, order, 1), np.uint64(1) << (order + self.cuts[table]).astype(np.uint64)

    def flips(self, cost: np.ndarray, table: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray] | None:
        """(row, flipped bits) for every set of bits of the table whose costs a row can pay, the empty one included; None
        if several rows together have more than ``most`` of them."""
        costs_up, bits = self.sorted_costs(cost, table)
        rows, masks, spent = np.arange(len(cost)), np.zeros(len(cost), np.uint64), np.zeros(len(cost), np.int64)
        found, n = [(rows, masks)], len(rows)
        for k in range(costs_up.shape[1]):
            more = spent + costs_up[rows, k]
            ok = np.flatnonzero(more <= self.budget)  # what cannot pay this sign cannot pay a dearer one
            if not len(ok):
                break
            rows, masks, spent, more = rows[ok], masks[ok], spent[ok], more[ok]
            with_it = masks | bits[rows, k]
            found.append((rows, with_it))
            n += len(rows)
            if most is not None and n > most and len(cost) > 1:
                return None
            rows, masks, spent = np.concatenate([rows, rows]), np.concatenate([masks, with_it]), np.concatenate([spent, more])
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def least_flips(self, cost: np.ndarray) -> np.ndarray:
        """A lower bound of the number of flips of each row over all tables."""
        tables = range(len(self.cuts) - 1)
        return sum(2.0 ** (np.cumsum(self.sorted_costs(cost, t)[0], 1) <= self.budget).sum(1) for t in tables)


def _bit_matrix(x: np.ndarray, n_bits: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :n_bits].astype(bool)


def linked(i: np.ndarray, j: np.ndarray, table: np.ndarray, here: np.ndarray, code: np.ndarray, cost: np.ndarray,
           unit: np.ndarray, tables: Tables, cosine: float) -> np.ndarray:
    """Which pairs (i, j) of a bucket are links that count in it. ``here`` holds the bits that each member flipped."""
    ok = np.flatnonzero(((here[i] == 0) | (here[j] == 0)) & (table[i] == table[j]) & ((code[i] ^ here[i] ^ code[j] ^ here[j]) & tables.masks[table[i]] == 0))
    ok = ok[np.einsum("ij,ij->i", unit[i[ok]], unit[j[ok]]) >= cosine]
    i, j = i[ok], j[ok]
    differ = _bit_matrix(code[i] ^ code[j], cost.shape[1])
    pay_i, pay_j = np.where(differ, cost[i], 0), np.where(differ, cost[j], 0)
    good = np.ones(len(ok), bool)
    for t in range(len(tables.cuts) - 1):
        low, high = tables.cuts[t], tables.cuts[t + 1]
        sum_i, sum_j = pay_i[:, low:high].sum(1), pay_j[:, low:high].sum(1)
        good &= (table[i] <= t) | (np.minimum(sum_i, sum_j) > tables.budget)
        # members are in one order in every bucket, so ties fall alike
        good &= (table[i] != t) | np.where(sum_i <= sum_j, here[j] == 0, here[i] == 0)
    return ok[good]


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n members the smallest member that the links connect it with."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = new[new]
        if (new == low).all():
            return low
        low = new


class Links:
    """Counts of links of n members, and which of them are connected."""

    def __init__(self, times: np.ndarray) -> None:
        self.times, self.links, self.top = times, np.zeros(len(times), np.int64), np.arange(len(times))
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        if not len(i):
            return
        np.add.at(self.links, i, self.times[j])
        np.add.at(self.links, j, self.times[i])
        i, j = self.top[i], self.top[j]
        apart = i != j
        self.waiting.append((i[apart], j[apart]))
        if sum(len(w[0]) for w in self.waiting) > _PAIRS:
            self.connect()

    def connect(self) -> None:
        if self.waiting:
            i, j = (np.concatenate(side) for side in zip(*self.waiting))
            self.waiting = []
            self.top = forest(self.top[i], self.top[j], len(self.top))[self.top]


class Members:
    """Members of pairs of blocks, in order of pair and side. Those of side 0 meet those of side 1; in a block that meets
    itself (``alone``) all meet one another."""

    def __init__(self, pair: np.ndarray, side: np.ndarray, alone: np.ndarray, vectors: np.ndarray, z: np.ndarray, cosine: float) -> None:
        self.vectors, self.z, self.code, self.cosine = vectors, z, codes(z), cosine
        n = len(pair)
        change = (pair[1:] != pair[:-1]) | (side[1:] != side[:-1])
        self.first = np.flatnonzero(np.concatenate([[True], change]))
        self.last = np.append(self.first[1:], n)
        self.n_runs = len(self.first)
        self.own = np.repeat(np.arange(self.n_runs), self.last - self.first)
        #: The run that each run meets, -1 for none.
        self.other = np.where(alone[self.first] & (self.last - self.first > 1), np.arange(self.n_runs), -1)
        two = np.flatnonzero(pair[self.first][1:] == pair[self.first][:-1])
        self.other[two], self.other[two + 1] = two + 1, two
        facing = self.other[self.own]
        self.low, self.high = np.where(facing < 0, 0, self.first[facing]), np.where(facing < 0, 0, self.last[facing])
        self.size = self.high - self.low
        if not self.size.any():
            return
        self.tables = Tables(z.shape[1], max(1, int(self.size.max()) // 4), cosine)
        bits = max(high - low for low, high in zip(self.tables.cuts, self.tables.cuts[1:]))
        self.slot_bits = min(_SLOT_BITS, bits + max(1, self.n_runs - 1).bit_length())
        self.own_slot, self.facing_slot = self.own.astype(np.uint64) << np.uint64(bits), np.maximum(facing, 0).astype(np.uint64) << np.uint64(bits)

    def slots(self, code: np.ndarray, run: np.ndarray, t: int) -> np.ndarray:
        at = (code & self.tables.masks[t]) >> np.uint64(self.tables.cuts[t])
        return ((at + run) & np.uint64((1 << self.slot_bits) - 1)).astype(np.int64)

    def find(self, links: Links) -> None:
        if not self.size.any():
            return
        each, n, n_slots = range(len(self.tables.cuts) - 1), len(self.code), 1 << self.slot_bits
        self.dense, self.large, crowd = np.zeros(n, bool), np.zeros(n, np.uint64), np.zeros(n)
        for at in range(0, n, 1 << 14):
            part = slice(at, at + (1 << 14))
            cost = costs(self.z[part])
            self.dense[part] = self.tables.least_flips(cost) * LOOKUP > self.size[part]
            high = np.zeros((len(cost), 64), bool)
            high[:, :cost.shape[1]] = cost > self.tables.most
            self.large[part] = np.packbits(high, axis=1, bitorder="little").view("<u8").reshape(-1)
        if not self.dense.all():
            for t in each:
                crowd += np.bincount(self.slots(self.code, self.own_slot, t), minlength=n_slots)[self.slots(self.code, self.facing_slot, t)]
            self.dense |= crowd * CROWD > np.maximum(self.size, CROWD * CROWD)
        self._compare(links)
        asking = np.flatnonzero(~self.dense & (self.size > 0))
        if not len(asking):
            return
        stored, self.index = np.flatnonzero(~self.dense), []
        for t in each:
            slot = self.slots(self.code[stored], self.own_slot[stored], t)
            members, counts = stored[np.argsort(slot, kind="stable")], np.bincount(slot, minlength=n_slots)
            self.index.append((members, self.code[members], self.large[members], counts, np.cumsum(counts) - counts))
        for at in range(0, len(asking), _ROWS):
            rows = asking[at:at + _ROWS]
            cost = costs(self.z[rows])
            for t in each:
                self._ask(rows, cost, t, links)

    def _compare(self, links: Links) -> None:
        """Links of the dense members, by comparing each with all that it meets."""
        margin = (self.vectors.shape[1] + 8) * 2.0 ** -23  # of single precision
        rows = np.flatnonzero(self.dense & (self.size > 0))
        cuts = np.flatnonzero(np.diff(self.own[rows])) + 1
        for some in np.split(rows, cuts):
            for at in range(0, len(some), _TILE):
                mine = some[at:at + _TILE]
                left = units(self.vectors[mine]).astype(np.float32)
                for low in range(int(self.low[mine[0]]), int(self.high[mine[0]]), _TILE):
                    high = min(low + _TILE, int(self.high[mine[0]]))
                    cos = left @ units(self.vectors[low:high]).astype(np.float32).T
                    i, j = np.nonzero(cos >= self.cosine - margin)
                    close = cos[i, j] < self.cosine + margin
                    i, j = mine[i], j + low
                    ok = ~self.dense[j] | (i < j)
                    for k in np.array_split(np.flatnonzero(ok & close), max(1, int((ok & close).sum()) // _EXACT)):
                        ok[k] = np.einsum("ij,ij->i", units(self.vectors[i[k]]), units(self.vectors[j[k]])) >= self.cosine
                    links.add(i[ok], j[ok])

    def _ask(self, rows: np.ndarray, cost: np.ndarray, t: int, links: Links) -> None:
        """Links of the other members that are found by flipping signs of one table."""
        flips = self.tables.flips(cost, t, _PAIRS)
        if flips is None:
            half = len(rows) // 2
            self._ask(rows[:half], cost[:half], t, links)
            self._ask(rows[half:], cost[half:], t, links)
            return
        who, here = flips
        members, code, large, counts, starts = self.index[t]
        own_code, own_large = self.code[rows], self.large[rows]
        slot = self.slots(own_code[who] ^ here, self.facing_slot[rows][who], t)
        n = counts[slot]
        hit = np.flatnonzero(n)
        who, here, n, start = who[hit], here[hit], n[hit], starts[slot[hit]]
        up_to, done, at = np.cumsum(n), 0, 0
        while at < len(hit):
            until = max(at + 1, int(np.searchsorted(up_to, done + _PAIRS, "right")))
            part, times = slice(at, until), n[at:until]
            place = np.arange(done, up_to[until - 1])
            place += np.repeat(start[part] + times - up_to[part], times)
            differ = np.repeat(own_code[who[part]], times)
            differ ^= code[place]
            kept = np.repeat(own_large[who[part]], times)
            kept |= large[place]
            kept &= differ
            ok = np.flatnonzero(kept == 0)
            asks = at + np.searchsorted(up_to[part], done + ok, "right")
            i, j, flipped = rows[who[asks]], members[place[ok]], here[asks]
            ok = np.flatnonzero((j >= self.low[i]) & (j < self.high[i]) & ((flipped != 0) | (i < j)))
            for k in np.array_split(ok, max(1, len(ok) // _EXACT)):
                self._rerank(i[k], j[k], flipped[k], t, links)
            at, done = until, up_to[until - 1]

    def _rerank(self, i: np.ndarray, j: np.ndarray, flipped: np.ndarray, t: int, links: Links) -> None:
        n, both = len(i), np.concatenate([np.minimum(i, j), np.maximum(i, j)])
        here = np.concatenate([np.where(i < j, flipped, 0), np.where(i < j, 0, flipped)]).astype(np.uint64)
        good = linked(np.arange(n), n + np.arange(n), np.full(2 * n, t), here, self.code[both], costs(self.z[both]), units(self.vectors[both]),
                      self.tables, self.cosine)
        links.add(both[good], both[n + good])


def _block_links(rows: DataFrame, rotation: Rotation, width: int, kind: str, cosine: float, least: int) -> DataFrame:
    """For rows (team, low, high, side, node, times, packed) in this order: (node, links, top) of every member that links,
    ``top`` being a member of its team that it is connected with. Pairs of blocks are worked on together up to ``least`` rows."""
    def work(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        col = {c: np.concatenate([b.column(c).to_numpy() for b in batches]) for c in ("team", "low", "high", "side", "node", "times")}
        n, at = len(col["node"]), 0
        vectors = np.empty((n, width), kind)
        for k, b in enumerate(batches):
            vectors[at:at + b.num_rows] = _unpacked(b.column("packed"), kind, width)
            at, batches[k] = at + b.num_rows, None
        z = np.concatenate([rotation(units(vectors[at:at + _EXACT])) for at in range(0, n, _EXACT)])
        pair = np.cumsum(np.concatenate([[False], _changes(col)]))
        links = Links(col["times"])
        Members(pair, col["side"], col["low"] == col["high"], vectors, z, cosine).find(links)
        links.connect()
        some = np.flatnonzero(links.links)
        return pa.RecordBatch.from_arrays([pa.array(col["node"][some]), pa.array(links.links[some]), pa.array(col["node"][links.top[some]])],
                                          ["node", "links", "top"])

    def _changes(col: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_or.reduce([col[c][1:] != col[c][:-1] for c in ("team", "low", "high")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            if not b.num_rows:
                continue
            if n + b.num_rows > least:
                # the end of the last whole pair of blocks, seen from the last row held
                seen = pa.Table.from_batches([x.select(["team", "low", "high"]) for x in ([held[-1].slice(held[-1].num_rows - 1)] if held else []) + [b]])
                change = np.flatnonzero(_changes({c: seen.column(c).to_numpy() for c in seen.column_names}))
                if len(change):
                    cut = int(change[-1]) + (0 if held else 1)
                    if cut:
                        held.append(b.slice(0, cut))
                    yield work(held)
                    held, n, b = [], 0, b.slice(cut)
            held.append(b)
            n += b.num_rows
        if held:
            yield work(held)

    return rows.mapInArrow(run, "node bigint, links bigint, top bigint")


def _round(classes: DataFrame, large: DataFrame, distance: int) -> DataFrame:
    """Members of the pairs of blocks of a team that are ``distance`` apart, in a ring of its blocks."""
    rows = classes.join(F.broadcast(large), "team", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    after, before = (F.pmod(F.col("own") + d, F.col("blocks")).cast("int") for d in (distance, -distance))
    if not distance:
        rows = rows.withColumn("met", F.col("own"))
    else:
        met = F.when(2 * distance < F.col("blocks"), F.array(after, before)).when(2 * distance == F.col("blocks"), F.array(after))
        rows = rows.withColumn("met", F.explode(met))
    rows = rows.select("team", F.least("own", "met").alias("low"), F.greatest("own", "met").alias("high"), (F.col("own") > F.col("met")).cast("int").alias("side"),
                       "node", "times", "packed")
    return rows.repartition("team", "low", "high").sortWithinPartitions("team", "low", "high", "side", "node")


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, shuffle files go as soon as the job that wrote them ends, not when the driver collects its garbage."""
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, before)


def _keyed(vectors: DataFrame, kind: str) -> DataFrame:
    """(vec_id, label, packed, key1, key2) with null in the last three for rows that cannot link."""
    given = vectors.select(vectors["vec_id"].cast("bigint").alias("vec_id"), vectors["label"].alias("label"),
                           vectors["embedding"].cast(f"array<{kind}>").alias("vector"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = pc.and_(b.column("vec_id").is_valid(), b.column("label").is_valid())
            packed = pc.if_else(known, _packed(b.column("vector")), pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), packed], ["vec_id", "label", "packed"])

    fields = [StructField("vec_id", LongType()), StructField("label", given.schema["label"].dataType), StructField("packed", BinaryType())]
    given = given.mapInArrow(pack, StructType(fields))
    return given.select("*", *(F.when(F.col("packed").isNotNull(), F.xxhash64(F.lit(k), F.octet_length("packed"), "label", "packed")).alias(f"key{k}")
                               for k in (1, 2)))


def _classes(given: DataFrame, kind: str) -> DataFrame:
    """(node, team, key1, key2, rep, times, width, packed): equal vectors of one label that can link. A team is a label and
    a length."""
    width = (F.octet_length("packed") / np.dtype(kind).itemsize).cast("int")
    return given.where("packed is not null").groupBy("label", "packed", "key1", "key2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("times")).select(
        F.monotonically_increasing_id().alias("node"), F.xxhash64("label", width).alias("team"), "key1", "key2", "rep", "times", width.alias("width"), "packed")


def _links_of_classes(classes: DataFrame, kind: str, cosine: float) -> DataFrame | None:
    """(key1, key2, links, least) of the classes that link or stand for several rows; None if there is no class."""
    n_classes, width = classes.agg(F.count("*"), F.max("width")).first()
    if not n_classes:
        return None
    spark = classes.sparkSession
    part = min(1.0, 1.1 * FIT_ROWS / n_classes)
    sample = classes.where(F.pmod(F.xxhash64("node"), 1 << 30) < int(part * (1 << 30))).select("packed").limit(FIT_ROWS).toArrow()
    if not sample.num_rows:
        sample = classes.select("packed").limit(FIT_ROWS).toArrow()
    rotation = Rotation.fit(units(_unpacked(sample.column("packed").combine_chunks(), kind, width)))
    most = max(1, min(BLOCK, BLOCK_BYTES // (width * np.dtype(kind).itemsize), max(LEAST_BLOCK, n_classes // spark.sparkContext.defaultParallelism)))
    large = classes.groupBy("team").agg(F.ceil(F.count("*") / most).cast("int").alias("blocks")).where("blocks > 1")
    large = materialize(large, "large-teams")  # at most n_classes / most
    rounds = 1 + (large.agg(F.max("blocks")).first()[0] or 1) // 2
    links = reduce(DataFrame.union, [
        materialize(_block_links(_round(classes, large, k), rotation, width, kind, cosine, most), "block-links") for k in range(rounds)])
    label = components(links.select(F.col("node").alias("a"), F.col("top").alias("b")))
    ids = label.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"))
    found = links.groupBy("node").agg(F.sum("links").alias("links")).join(label.join(ids, "component"), "node")
    return classes.select("node", "key1", "key2", "rep", "times").join(found, "node", "left").where("links is not null or times > 1").select(
        "key1", "key2", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("links"), F.coalesce("least", "rep").alias("least"))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    given = _keyed(vectors, kind)
    with _shuffles_dropped(vectors.sparkSession):
        kind = "<f4" if kind == "float" else "<f8"
        of_class = _links_of_classes(materialize(_classes(given, kind), "vector-classes"), kind, cosine)
        if of_class is not None:
            of_class = materialize(of_class, "class-links")
    if of_class is None:
        none = F.lit(0).cast("bigint")
        return given.select("vec_id", none.alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    out = given.select("vec_id", "key1", "key2").join(of_class, ["key1", "key2"], "left")
    component = F.coalesce("least", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
                      F.col("vec_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vectors`` with one of each component: all rows of its smallest id."""
    gone = near_duplicates(vectors, cosine).where(~F.col("kept")).select(F.col("vec_id").alias("gone")).distinct()
    return vectors.join(gone, vectors["vec_id"].cast("bigint") == gone["gone"], "left_anti")
