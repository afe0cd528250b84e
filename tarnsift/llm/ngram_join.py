"""N-gram Jaccard join over count vectors in R-trees.

Every distinct shingle set is a point: its shingles are hashed into groups and the counts of the
groups are the coordinates.  The overlap of two sets is at most the sum of the coordinate minima, for
two points as for a point and a box, so a tree of boxes yields all pairs that can still link; those
are verified on the sets.

Points that can link meet as follows.  Sets that link differ in at most D shingles, D known from
their sizes.  The shingles of a set are dealt by hash into more than D parts, so two such sets have a
part in common, whole; a part's hash is a key.  Parts that hold few shingles besides those of passages
that very many documents share are left out where the number of parts proves that a more telling
common one remains.  So no link is lost, whichever shingles are taken for common.  Sets joined by keys
form cells; each cell is indexed by R-trees, large cells in blocks, and of what they yield only sets whose
rarest shingles meet are verified.  Equal sets are one point throughout.

Defined cases: null, empty and blank texts have the empty set and are linked with nothing; repeated
rows and equal sets are one class; a null id counts as larger than any other; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bins_for, discard, materialize, small_batches, table, without_ids
from .components import components
from .packing import SENT, pack, sent, unpack
from .textkernel import give_back, grouped_sums, mix, pieces, shingle_sets, tidy

_U = np.uint64
#: Shingles that are not common a part should hold, where leaving out the others loses nothing.
RARE = (6, 5, 4, 3, 2, 1)
#: Bytes of text of which the shingles are made at once, about.
PIECE = 2_000_000
#: Bins of keys, as a multiple of the usual number, as keys are unpacked a bin at a time.
SMALLER = 4
#: Entries that a task gathers before it hands them on.
FLUSH = 300_000
#: Groups of the count vectors.
GROUPS = 64
#: A block of a cell holds at most about so many points and shingles.
BLOCK_POINTS, BLOCK_SHINGLES = 2048, 6_000_000
#: Sets of small cells that are handed to Python together, about.
TOGETHER = 128
#: Shingles sorted at once to find those that several sets of a cell hold.
SLICE = 1_000_000
#: Shingles taken for common: at most so many, in at least LOCAL sets among COUNTED shingles and TOTAL in all such.
COUNTED = 3_000_000
COMMON, LOCAL, TOTAL = 200_000, 2, 6
#: Cell members up to so many are broadcast to read their texts again; more are joined by a shuffle.
BROADCAST_MEMBERS = 300_000


@dataclass(frozen=True)
class Threshold:
    """Link when num * intersection... : den * |A and B| >= num * |A or B|."""

    num: int = 85
    den: int = 100

    def needed(self, total):
        """Least overlap of two sets whose sizes add up to total."""
        return -(-self.num * total // (self.num + self.den))

    def differing(self, total: int) -> int:
        """In most shingles so many differ two sets that link, of sizes that add up to total at most."""
        return total * (self.den - self.num) // (self.den + self.num)


@dataclass(frozen=True)
class Band:
    """Sets of low to high shingles are compared here by parts; some two of them differ in at most
    parts - 1 - spare shingles."""

    low: int
    high: int
    most: int
    parts: int


def _band(low: int, high: int, most: int) -> Band:
    """As few parts as leave the smallest sets of the band, but for one in a hundred or so, enough
    heavy ones."""
    for quarters in (5, 6, 7, 8, 10, 12):
        parts = most * quarters // 4 + 2
        each = low / parts
        light = np.exp(-each) * (1 + each)
        if light + 2.5 * np.sqrt(light * (1 - light) / parts) < 1 - most / parts:
            break
    return Band(low, high, most, parts)


def bands(t: Threshold, longest: int) -> list[Band]:
    """Any two sizes that can link lie together in a band: bands of sizes, and one across each border."""
    out, low = [], 1
    while low <= longest:
        high = max(low + 1, low * 7 // 5)
        most = t.differing(2 * high - 2)
        if most:
            out.append(_band(low, high - 1, most))
        under, over = -(-t.num * high // t.den), (high - 1) * t.den // t.num
        if under < high <= over:
            most = t.differing(high - 1 + over)
            if most:
                out.append(_band(under, over, most))
        low = high
    return out


def part_keys(sets: list[np.ndarray], t: Threshold, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(key, index of the set) of all parts that may have to meet.

    A set gives the parts with RARE shingles that are not common, if the rest are so few that one of
    these is whole in every set it links to; else those with fewer, down to all parts, empty ones too.
    What a set gives contains all that it would give at a stricter choice, so of two sets that link
    the stricter one's part is given by both."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    keys, owners = [], []
    for number, b in enumerate(bands(t, int(sizes.max(initial=0)))):
        own = np.flatnonzero((sizes >= b.low) & (sizes <= b.high))
        if not len(own):
            continue
        values, of = np.concatenate([sets[i] for i in own]), np.repeat(np.arange(len(own)), sizes[own])
        part = of * b.parts + (mix(values) % _U(b.parts)).astype(np.int64)
        n = len(own) * b.parts
        count, sums = np.bincount(part, minlength=n), grouped_sums(part, values, n)
        rare = count
        if common is not None and len(common):
            at = np.minimum(np.searchsorted(common, values), len(common) - 1)
            rare = np.bincount(part[common[at] != values], minlength=n)
        given, left = np.ones((len(own), b.parts), bool), np.ones(len(own), bool)
        for telling in [*(rare >= r for r in RARE), count >= 1]:
            telling = telling.reshape(len(own), b.parts)
            enough = left & ((~telling).sum(1) < b.parts - b.most)
            given[enough] = telling[enough]
            left &= ~enough
        at = np.flatnonzero(given.ravel())
        salt = (at % b.parts).astype(_U) + _U((number + 1) << 32)
        keys.append(mix(sums[at] ^ mix(salt + (count[at].astype(_U) << _U(48)))))
        owners.append(own[at // b.parts])
    if not keys:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners)


def set_ids(sets: list[np.ndarray]) -> np.ndarray:
    """64-bit class of each set."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    values = np.concatenate(sets) if len(sets) else np.zeros(0, _U)
    return mix(grouped_sums(np.repeat(np.arange(len(sets)), sizes), mix(values + _U(1)), len(sets)) + sizes.astype(_U)).view(np.int64)


# --- points ----------------------------------------------------------------------------------


class CountTree:
    """R-tree over count vectors, packed by sorting.  Boxes keep upper corners and least sizes."""

    LEAF, FAN = 32, 16

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        spread = np.argsort(-vectors.astype(np.float64).var(0), kind="stable")[:2] if len(vectors) else [0, 0]
        self.order = np.lexsort((vectors[:, spread[1]], vectors[:, spread[0]], sizes))
        self.vectors, self.sizes = vectors[self.order], sizes[self.order]
        self.levels = []  # from the leaves up: (upper corners, least sizes, largest sizes, children a box)
        corners, least, most, step = self.vectors, self.sizes, self.sizes, self.LEAF
        while True:
            cuts = np.arange(0, len(corners), step)
            corners, least, most = np.maximum.reduceat(corners, cuts), np.minimum.reduceat(least, cuts), np.maximum.reduceat(most, cuts)
            self.levels.append((corners, least, most, step))
            if len(corners) <= self.FAN:
                break
            step = self.FAN

    def candidates(self, vector: np.ndarray, size: int, t: Threshold) -> np.ndarray:
        """Indices of all points whose bound reaches the overlap that their sizes need."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -2, -1):
            corners, least, most = self.levels[depth][:3] if depth >= 0 else (self.vectors, self.sizes, self.sizes)
            fit = (t.den * most[at] >= t.num * size) & (t.num * least[at] <= t.den * size)
            at = at[fit]
            bound = np.minimum(corners[at], vector).sum(1)
            at = at[bound >= t.needed(size + np.maximum(least[at], -(-t.num * size // t.den)))]
            if depth < 0 or not len(at):
                break
            step, below = self.levels[depth][3], len(self.levels[depth - 1][0]) if depth else len(self.vectors)
            at = (at[:, None] * step + np.arange(step)).ravel()
            at = at[at < below]
        return self.order[at]


def count_vector(values: np.ndarray) -> np.ndarray:
    return np.bincount((mix(values) >> _U(40)).astype(np.int64) % GROUPS, minlength=GROUPS).astype(np.int32)


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def held_twice(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted values that two of the sets hold at least, and how many sets do; found by slices of their range."""
    bits = (sum(map(len, sets)) // SLICE).bit_length()
    edges = np.arange(1, 1 << bits, dtype=_U) << _U(64 - bits) if bits else np.zeros(0, _U)
    cuts = [[0, *np.searchsorted(s, edges).tolist(), len(s)] for s in sets]
    values, counts = [], []
    for k in range(1 << bits):
        v = np.sort(np.concatenate([s[c[k]:c[k + 1]] for s, c in zip(sets, cuts)]))
        starts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]][:len(v)])
        n = np.diff(np.r_[starts, len(v)])
        values.append(v[starts[n > 1]])
        counts.append(n[n > 1])
    return np.concatenate(values), np.concatenate(counts)


class Heads:
    """The first values of each set, rarest first, of which two sets that link have one in common.

    A set of n that links has at least n * num / den values in common with the other; the first of these in any
    order that both keep has so many behind it in either set.  Values that no other set holds come first in this
    order and meet nobody, so sets that only share some frequent passages have no head, or meet few."""

    def __init__(self, sets: list[np.ndarray], t: Threshold):
        values, counts = held_twice(sets)
        rank = np.empty(len(values), np.int32)
        rank[np.argsort(counts, kind="stable")] = np.arange(len(values), dtype=np.int32)
        self.n = len(values)
        self.codes, heads = [], []  # of the values that other sets hold too
        for s in sets:
            at = np.searchsorted(values, s)
            at = at[values[np.minimum(at, len(values) - 1)] == s] if len(values) else at[:0]
            code = np.sort(rank[at])
            self.codes.append(code)
            heads.append(code[:max(0, len(code) + t.num * len(s) // -t.den + 1)])
        self.ends = np.cumsum([0, *map(len, heads)])
        every, owners = np.concatenate(heads), np.repeat(np.arange(len(sets)), np.diff(self.ends))
        order = np.argsort(every, kind="stable")
        self.owners, ordered = owners[order], every[order]
        self.first, self.last = np.searchsorted(ordered, every, "left"), np.searchsorted(ordered, every, "right")

    def groups(self) -> list[np.ndarray]:
        """Points that meet, or meet the same ones; those that meet none are in no group."""
        lead, own = self.owners[self.first], np.repeat(np.arange(len(self.codes)), np.diff(self.ends))
        forest = Forest(len(self.codes))
        for i, j in np.unique(np.stack([lead, own])[:, lead != own], axis=1).T.tolist():
            forest.join(i, j)
        roots = np.array([forest.root(i) for i in range(len(self.codes))])
        order = np.argsort(roots, kind="stable")
        return [g for g in np.split(order, np.flatnonzero(np.diff(roots[order])) + 1) if len(g) > 1]

    def meeting(self, i: int, near: np.ndarray) -> np.ndarray:
        """Those of near that have a value of i's head in theirs; all, where looking costs more than verifying."""
        first, last = (x[self.ends[i]:self.ends[i + 1]] for x in (self.first, self.last))
        n = last - first
        if n.sum() > min(1_000_000, len(near) * max(64, len(self.codes[i]))):
            return near
        at = np.repeat(last - np.cumsum(n), n) + np.arange(n.sum())
        return near[np.isin(near, self.owners[at])]


def links_within(sets: list[np.ndarray], side: np.ndarray, t: Threshold) -> list[tuple[int, int]]:
    """A spanning forest of the links between points of side 0 and side 1, or among all if every side
    is 2.  Points whose heads meet are in one tree; pairs that are connected already are not verified again."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    heads, forest, out = Heads(sets, t), Forest(len(sets)), []
    mark = np.zeros(heads.n, bool)
    for group in heads.groups():
        left, right = group[side[group] != 1], group[side[group] != 0]
        if not len(left) or not len(right):
            continue
        vectors = {int(i): count_vector(sets[i]) for i in group}
        tree = CountTree(np.stack([vectors[int(i)] for i in right]), sizes[right])
        for i in left:
            i = int(i)
            near = right[tree.candidates(vectors[i], int(sizes[i]), t)]
            near = near[near > i if side[i] == 2 else near != i]
            if not len(near):
                continue
            mark[heads.codes[i]] = True
            for j in heads.meeting(i, near).tolist():
                if forest.root(i) == forest.root(j):
                    continue
                common = np.count_nonzero(mark[heads.codes[j]])
                if t.den * common >= t.num * (sizes[i] + sizes[j] - common):
                    forest.join(i, j)
                    out.append((i, j))
            mark[heads.codes[i]] = False
    return out


# --- operator --------------------------------------------------------------------------------

_SIZES = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.int64())])


def set_table(docs: DataFrame, size: int) -> DataFrame:
    """(id, n_shingles, set_id) of every row."""

    @tidy
    def run(batches):
        for b in batches:
            ids = b.column(0)
            for first, data, offsets in pieces(b.column(1), PIECE):
                sets = shingle_sets(data, offsets, size)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(first, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(set_ids(sets), pa.int64()),
                ], schema=_SIZES)

    return docs.mapInArrow(run, "id long, n_shingles long, set_id long")


def common_shingles(docs: DataFrame, size: int) -> np.ndarray:
    """Sorted hashes of at most COMMON shingles of many sets.  They only make the keys more telling."""

    def often(held):
        values, n = np.unique(np.concatenate(held), return_counts=True)
        own = n >= LOCAL
        return pa.RecordBatch.from_arrays([pa.array(values[own].view(np.int64)), pa.array(n[own])], names=["shingle", "n"])

    @tidy
    def run(batches):
        held, n = [], 0
        for b in batches:
            for _, data, offsets in pieces(b.column(1), PIECE):
                sets = shingle_sets(data, offsets, size)
                held += [sets[i] for i in np.unique(set_ids(sets), return_index=True)[1]]
                n += sum(len(s) for s in sets)
                if n >= COUNTED:
                    yield often(held)
                    held, n = [], 0
        if held:
            yield often(held)

    counted = docs.mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") >= TOTAL)
    rows = counted.orderBy(F.col("n").desc(), "shingle").limit(COMMON).select("shingle").collect()
    return np.sort(np.array([r.shingle for r in rows], np.int64).view(_U))


def packed_keys(docs: DataFrame, size: int, t: Threshold, bins: int, common: np.ndarray) -> DataFrame:
    """Keys of all sets, dealt to bins by key, each bin's share of a task as one row."""

    def share(keys, owners):
        bin_of = (keys % _U(bins)).astype(np.int64)
        order = np.lexsort((owners, keys, bin_of))
        keys, owners, bin_of = keys[order], owners[order], bin_of[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
        keys, owners, bin_of = keys[new], owners[new], bin_of[new]
        edge, rows = np.searchsorted(bin_of, np.arange(bins + 1)), []
        for i in range(bins):
            if edge[i] < edge[i + 1]:
                names, which = np.unique(owners[edge[i]:edge[i + 1]], return_inverse=True)
                rows.append((i, 0, 0, pack(keys[edge[i]:edge[i + 1]], which.astype(np.uint32), names)))
        return sent(rows)

    @tidy
    def run(batches):
        held, n = [], 0
        for b in batches:
            for _, data, offsets in pieces(b.column(1), PIECE):
                sets = shingle_sets(data, offsets, size)
                keys, owner = part_keys(sets, t, common)
                held.append((keys, set_ids(sets)[owner]))
                n += len(keys)
                if n >= FLUSH:
                    yield share(*map(np.concatenate, zip(*held)))
                    held, n = [], 0
        if n:
            yield share(*map(np.concatenate, zip(*held)))

    return docs.mapInArrow(run, SENT)


def meetings(packed: DataFrame, bins: int) -> DataFrame:
    """(a, b): each set with the smallest set of a key that they share.  As many rows as entries at
    most, however many sets share a key."""

    @tidy
    def run(batches):
        # a task has whole bins, packed but for one; a bin holds about entries / bins keys
        held: dict[int, list] = {}
        for b in batches:
            for i, body in zip(b.column(0).to_pylist(), b.column(3).to_pylist()):
                held.setdefault(i, []).append(body)
        for i in sorted(held):
            parts = [unpack(body, "u8", "u4", "i8") for body in held.pop(i)]
            keys, owners = np.concatenate([p[0] for p in parts]), np.concatenate([p[2][p[1]] for p in parts])
            del parts
            order = np.lexsort((owners, keys))
            keys, owners = keys[order], owners[order]
            first = np.r_[True, keys[1:] != keys[:-1]]
            lead = owners[first][np.cumsum(first) - 1]
            pairs = np.unique(np.stack([lead, owners])[:, lead != owners], axis=1)
            for at in range(0, pairs.shape[1], 100_000):
                x = pairs[:, at:at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1])], names=["a", "b"])

    return packed.repartition(bins, "bin").mapInArrow(run, "a long, b long").distinct()


def in_cells(met: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, set_id, cell, own, chunks): the sets that met others, each in a chunk of its cell."""
    found = components(met)
    cells = materialize(found.select(F.col("node").alias("set_id"), F.col("root").alias("cell")).join(classes, "set_id"), "cells")
    chunks = cells.groupBy("cell").agg(F.greatest(
        F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_POINTS)), F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("set_id"), F.col("chunks")).cast("int")
    return materialize(cells.join(chunks, "cell").select(F.col("first").alias("id"), "set_id", "cell", own.alias("own"), "chunks"), "cells")


def cell_links(docs: DataFrame, cells: DataFrame, size: int, t: Threshold) -> DataFrame:
    """(a, b): links that connect what links connect, cell by cell, large cells by pairs of chunks.

    The sets are made again from one document of each class, and travel once, to their chunk; the chunks of
    large cells are written, and each two of a cell are read together by a task."""
    n_sets = cells.count()
    side = cells.withColumnRenamed("id", "_id")
    joined = docs.join(F.broadcast(side) if n_sets <= BROADCAST_MEMBERS else side, F.col("id").eqNullSafe(F.col("_id")))

    @tidy
    def sets_of(batches):
        for b in batches:
            wanted = b.column(1).to_numpy(zero_copy_only=False)
            for first, data, offsets in pieces(b.column(0), PIECE):
                sets = shingle_sets(data, offsets, size)
                got = set_ids(sets)
                keep = np.flatnonzero(got == wanted[first:first + len(got)])  # ids may repeat
                yield pa.RecordBatch.from_arrays(
                    [b.column(c).take(pa.array(keep + first)) for c in (1, 2, 3, 4)] + [pa.array([sets[i].tobytes() for i in keep], pa.binary())],
                    names=["set_id", "cell", "own", "chunks", "shingles"])

    rows = joined.select("text", "set_id", "cell", "own", "chunks").mapInArrow(
        sets_of, "set_id long, cell long, own int, chunks int, shingles binary")

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        out, n = [], 0
        for (cell, own), rows in pdf.drop_duplicates("set_id").sort_values("set_id").groupby(["cell", "own"]):
            ids, sets = rows.set_id.to_numpy(), [np.frombuffer(x, _U) for x in rows.shingles]
            out += [(ids[i], ids[j], cell, -1, None, None, None) for i, j in links_within(sets, np.full(len(ids), 2), t)]
            ends = np.cumsum([len(x) for x in sets], dtype=np.int64)
            n += ends[-1]
            if rows.chunks.iloc[0] > 1:
                out.append((0, 0, cell, own, ids.tobytes(), ends.tobytes(), b"".join(rows.shingles)))
        if n > FLUSH:
            give_back()
        return pd.DataFrame(out, columns=["a", "b", "cell", "chunk", "ids", "ends", "shingles"])

    # a chunk is handed to Python alone, whole cells some together
    deal = F.when(F.col("chunks") > 1, F.xxhash64("cell", "own")).otherwise(F.pmod(F.xxhash64("cell"), F.lit(n_sets // TOGETHER + 1)))
    found = materialize(rows.groupBy(deal.alias("deal")).applyInPandas(
        within, "a long, b long, cell long, chunk int, ids binary, ends binary, shingles binary"), "chunks")
    links, chunks = found.filter("chunk < 0").select("a", "b"), found.filter("chunk >= 0").drop("a", "b")
    links = materialize(links if chunks.isEmpty() else links.unionByName(links_across(chunks, t)), "links")
    discard(found)
    return links


def links_across(chunks: DataFrame, t: Threshold) -> DataFrame:
    """(a, b): for each two chunks of a cell, links that connect what links between them connect.  chunks is a
    written table; each task reads two of its parts, as an exchange would copy a chunk for each other one."""

    @tidy
    def run(batches):
        for batch in batches:
            for pair in zip(*(batch.column(c) for c in range(6))):
                body = [np.frombuffer(x.as_buffer(), kind) for x, kind in zip(pair, ("i8", "i8", "u8") * 2)]
                ids, sets, side = np.concatenate([body[0], body[3]]), [], np.repeat([0, 1], [len(body[0]), len(body[3])])
                for ends, values in (body[1:3], body[4:6]):
                    sets += np.split(values, ends[:-1])
                got = np.array(links_within(sets, side, t), np.int64).reshape(-1, 2)
                give_back()
                yield pa.RecordBatch.from_arrays([pa.array(ids[got[:, 0]]), pa.array(ids[got[:, 1]])], names=["a", "b"])

    x, y = (chunks.select([F.col(c).alias(f"{c}{k}") for c in chunks.columns]) for k in (1, 2))
    # not by equality, which Spark would join by an exchange
    both = x.join(y, (F.col("cell1").bitwiseXOR(F.col("cell2")) == 0) & (F.col("chunk1") < F.col("chunk2")))
    return both.select("ids1", "ends1", "shingles1", "ids2", "ends2", "shingles2").mapInArrow(run, "a long, b long")


def jaccard_components(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 4, threshold: Threshold = Threshold(),
) -> DataFrame:
    """(id, set_id, n_shingles, component) of every row; component is the smallest id reachable by links."""
    with small_batches(docs.sparkSession):
        return _components(docs, id_col, text_col, size, threshold)


def _components(docs: DataFrame, id_col: str, text_col: str, size: int, threshold: Threshold) -> DataFrame:
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    bins = SMALLER * bins_for(docs)
    rows = materialize(set_table(narrow, size), "sets")
    classes = rows.filter("n_shingles > 0").groupBy("set_id").agg(F.min("id").alias("first"), F.first("n_shingles").alias("n"))
    common = common_shingles(narrow, size)
    met = materialize(meetings(packed_keys(narrow, size, threshold, bins, common), bins), "meetings")
    cells = in_cells(met, classes)
    discard(met)
    roots = components(cell_links(narrow, cells, size, threshold))
    classes = classes.select("set_id", "first")
    named = roots.withColumnRenamed("node", "set_id").join(classes, "set_id")
    named = named.join(named.groupBy("root").agg(F.min("first").alias("component")), "root").select("set_id", "component")
    final = materialize(classes.join(named, "set_id", "left").select("set_id", F.coalesce("component", "first").alias("component")), "classes")
    full = rows.filter("n_shingles > 0").join(final, "set_id").select("id", "set_id", "n_shingles", "component")
    return full.unionByName(rows.filter("n_shingles = 0").select("id", "set_id", "n_shingles", F.col("id").alias("component")))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with the smallest id of each component.  Rows of one id and set are one document; rows of
    one id and different sets are judged each; documents without words all stay."""
    found = materialize(jaccard_components(docs, id_col=id_col, text_col=text_col, **options), "components")
    if not found.groupBy("id").count().filter("count > 1").limit(1).count():
        bad = materialize(found.filter(~F.col("id").eqNullSafe(F.col("component"))).select("id"), "bad")
        return without_ids(docs, bad, id_col)
    size = options.get("size", 4)

    @F.arrow_udf("long")
    def set_of(text: pa.Array) -> pa.Array:
        parts = [set_ids(shingle_sets(data, offsets, size)) for _, data, offsets in pieces(text, PIECE)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))

    kept = found.filter(F.col("id").eqNullSafe(F.col("component"))).groupBy("id", "set_id").agg(F.max("n_shingles").alias("_n"))
    kept = kept.withColumnRenamed("id", "_kept").withColumnRenamed("set_id", "_kept_set")
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), set_of(F.col(text_col)).alias("_set")).join(
        kept, F.col("_id").eqNullSafe(F.col("_kept")) & (F.col("_set") == F.col("_kept_set")))
    first = rows.filter("_n > 0").groupBy("_id", "_set").agg(F.first("_row").alias("_row")).select("_row.*")
    return first.unionByName(rows.filter("_n = 0").select("_row.*"))


def op2_ngram_join(spark, sf_dir) -> DataFrame:
    out = jaccard_components(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
