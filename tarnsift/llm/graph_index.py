"""Approximate nearest neighbours by robust-pruned directed graphs, one a shard.

Vectors are dealt to shards of bounded size.  In each shard greedy beam searches from fixed entries
propose neighbours; pruning keeps an edge unless a kept neighbour is closer to its end by the factor
ALPHA, so the edges stay diverse; reverse edges are pruned alike.  Queries go in blocks to every
shard, which is read by a beam search, and the shards' answers are merged by the exact measure.

Equal vectors are one point with the smallest ids of its rows, as many as an answer can need, so ties
are exact and a frequent vector is no hub.

Defined cases: a vector that is null, zero, empty or holds a null or non-finite component is neither
query nor candidate; vectors of different lengths are not compared; a query's own rows (equal id) are
no candidates, and rows of one query id have one answer together; fewer candidates than asked for are all returned; ties go to the smaller id; a null id
takes no part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Points of a shard, at most about.
SHARD_POINTS = 8192
DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA, ENTRIES = 32, 64, 64, 1.2, 8
#: Queries that are searched at once, and points that are inserted at once.
QUERY_BLOCK, INSERT = 512, 256


# --- graph -----------------------------------------------------------------------------------


def _first(ids: np.ndarray) -> np.ndarray:
    """Marks the first of equal ids in each row."""
    order = np.argsort(ids, axis=1, kind="stable")
    s = np.take_along_axis(ids, order, 1)
    new = np.ones(ids.shape, bool)
    new[:, 1:] = s[:, 1:] != s[:, :-1]
    out = np.empty(ids.shape, bool)
    np.put_along_axis(out, order, new, 1)
    return out


def beam_search(unit: np.ndarray, edges: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the beam nearest points that greedy search meets: (ids, distances); -1 pads.

    edges: (points, degree), -1 pads.  All queries step together; a step opens each one's nearest
    unopened point."""
    n, q = len(unit), len(queries)
    ids = np.full((q, beam), -1, np.int64)
    far = np.full((q, beam), np.inf, np.float32)
    opened = np.ones((q, beam), bool)
    seen = np.zeros((q, n), bool)
    start = np.broadcast_to(entries, (q, len(entries)))
    seen[:, entries] = True
    k = min(beam, len(entries))
    d = 1 - queries @ unit[entries].T
    o = np.argsort(d, axis=1, kind="stable")[:, :k]
    ids[:, :k], far[:, :k], opened[:, :k] = np.take_along_axis(start, o, 1), np.take_along_axis(d, o, 1), False
    live = np.arange(q)
    while len(live):
        closed = opened[live]
        at = np.where(closed, np.inf, far[live]).argmin(1)
        go = ~closed[np.arange(len(live)), at]
        live, at = live[go], at[go]
        if not len(live):
            break
        opened[live, at] = True
        near = edges[ids[live, at]]
        fresh = (near >= 0) & ~seen[live[:, None], near]
        seen[live[:, None], np.where(near >= 0, near, 0)] |= near >= 0
        d = 1 - np.einsum("qd,qkd->qk", queries[live], unit[near], optimize=True)
        d = np.where(fresh, d, np.inf).astype(np.float32)
        every, dist = np.concatenate([ids[live], near], 1), np.concatenate([far[live], d], 1)
        done = np.concatenate([opened[live], ~fresh], 1)
        o = np.argsort(dist, axis=1, kind="stable")[:, :beam]
        ids[live], far[live], opened[live] = np.take_along_axis(every, o, 1), np.take_along_axis(dist, o, 1), np.take_along_axis(done, o, 1)
    return np.where(np.isfinite(far), ids, -1), far


def robust_prune(unit: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each point up to degree candidates; a kept one drops those that it is closer to than the
    point is, by the factor alpha.  Distances are between unit vectors, squared."""
    ok = (candidates >= 0) & (candidates != points[:, None]) & _first(candidates)
    vectors = unit[np.where(ok, candidates, 0)]
    own = np.where(ok, 2 - 2 * np.einsum("pd,pkd->pk", unit[points], vectors, optimize=True), np.inf)
    between = 2 - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))
    out = np.full((len(points), degree), -1, np.int64)
    rows = np.arange(len(points))
    for k in range(degree):
        best = own.argmin(1)
        live = np.isfinite(own[rows, best])
        if not live.any():
            break
        out[live, k] = candidates[rows, best][live]
        drop = alpha * alpha * between[rows, best] <= own
        own = np.where(drop, np.inf, own)
        own[rows, best] = np.inf
    return out


def build(unit: np.ndarray, *, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(edges, entries) of a directed graph over unit vectors."""
    n, g = len(unit), np.random.default_rng(seed)
    middle = unit.mean(0)
    entries = np.unique(np.r_[np.argmax(unit @ middle), g.permutation(n)[:ENTRIES - 1]])
    edges = np.full((n, degree), -1, np.int64)
    few = min(degree // 2, n - 1)
    if few > 0:
        edges[:, :few] = g.integers(0, n, (n, few))
        edges[edges == np.arange(n)[:, None]] = -1
    for slack in (1.0, alpha):
        order = g.permutation(n)
        for at in range(0, n, INSERT):
            own = order[at:at + INSERT]
            found, _ = beam_search(unit, edges, entries, unit[own], beam)
            edges[own] = robust_prune(unit, own, np.concatenate([found, edges[own]], 1), degree, slack)
            # reverse edges, pruned where a point has too many
            source = np.repeat(own, degree)
            target = edges[own].ravel()
            source, target = source[target >= 0], target[target >= 0]
            o = np.argsort(target, kind="stable")
            source, target = source[o], target[o]
            ends, begin, count = np.unique(target, return_index=True, return_counts=True)
            for part in range(0, int(count.max(initial=0)), degree):  # of any number of new edges
                more = np.full((len(ends), degree), -1, np.int64)
                for k in range(degree):
                    has = count > part + k
                    more[has, k] = source[begin[has] + part + k]
                both = np.concatenate([edges[ends], more], 1)
                both[~_first(both)] = -1
                room = (both >= 0).sum(1) <= degree
                packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)[:, :degree]
                edges[ends[room]] = packed[room]
                if (~room).any():
                    edges[ends[~room]] = robust_prune(unit, ends[~room], both[~room], degree, slack)
    return edges, entries


# --- operator --------------------------------------------------------------------------------


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col("vector")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.filter(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).filter(~bad).filter(F.exists(v, lambda x: x != 0))


def _points(rows: DataFrame, keep: int) -> DataFrame:
    """(vector, ids): each distinct vector with its keep smallest ids."""

    # a frequent vector leaves a few ids a batch, and only those are gathered
    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: dict[tuple, list[int]] = {}
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.setdefault(tuple(x), []).append(i)
            yield pa.RecordBatch.from_arrays([
                pa.array(map(list, held), pa.list_(pa.float64())), pa.array([sorted(i)[:keep] for i in held.values()], pa.list_(pa.int64())),
            ], names=["vector", "ids"])

    some = rows.mapInArrow(least, "vector array<double>, ids array<long>")
    return some.groupBy("vector").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids"))


def nearest(
    vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, beam: int = SEARCH_BEAM,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of vectors by cosine for each row of queries."""
    spark = vectors.sparkSession
    points = materialize(_points(_usable(vectors, id_col, vector_col), k + 1), "points")
    asked = _usable(queries, id_col, vector_col)
    n = points.count()
    shards = max(1, -(-n // SHARD_POINTS))
    shard = F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task may hold several shards; each is of bounded size
        held: dict[tuple, tuple[list, list]] = {}
        for b in batches:
            for s, x, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                xs, ids = held.setdefault((s, len(x)), ([], []))
                xs.append(x)
                ids.append(i + [-1] * (k + 1 - len(i)))
        for (s, width), (xs, ids) in held.items():
            original = np.array(xs)
            order = np.lexsort(original.T[::-1])  # the same graph whatever the order of arrival
            original, ids = original[order], np.array(ids, np.int64)[order]
            unit = (original / np.linalg.norm(original / np.abs(original).max(1, keepdims=True), axis=1, keepdims=True) / np.abs(original).max(1, keepdims=True)).astype(np.float32)
            edges, entries = build(unit)
            yield pa.RecordBatch.from_arrays([
                pa.array([s], pa.int32()), pa.array([width], pa.int32()), pa.array([0], pa.int32()),
                pa.array([original.tobytes()], pa.binary()), pa.array([ids.tobytes()], pa.binary()),
                pa.array([edges.astype(np.int32).tobytes()], pa.binary()), pa.array([entries.astype(np.int32).tobytes()], pa.binary()),
            ], names=_ROW_NAMES)

    graphs = points.select(shard.alias("shard"), "vector", "ids").repartition(shards, "shard").mapInArrow(index, _ROW)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by_width: dict[int, list] = {}
            for x, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by_width.setdefault(len(x), []).append((x, i))
            for width, rows in by_width.items():
                for at in range(0, len(rows), QUERY_BLOCK):
                    own = rows[at:at + QUERY_BLOCK]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([-1], pa.int32()), pa.array([width], pa.int32()), pa.array([1], pa.int32()),
                        pa.array([np.array([x for x, _ in own]).tobytes()], pa.binary()),
                        pa.array([np.array([i for _, i in own], np.int64).tobytes()], pa.binary()),
                        pa.array([b""], pa.binary()), pa.array([b""], pa.binary()),
                    ], names=_ROW_NAMES)

    blocks = asked.select("vector", "id").mapInArrow(block, _ROW)
    blocks = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    # a task streams: a shard's graph first, then the blocks that ask it, one at a time
    streams = graphs.unionByName(blocks.select(*_ROW_NAMES)).repartition(shards, "shard").sortWithinPartitions("shard", "width", "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, graph = None, None
        for b in batches:
            for row in range(b.num_rows):
                s, width, kind, x, i, e, t = (c[row].as_py() for c in b.columns)
                if kind == 0:
                    original = np.frombuffer(x).reshape(-1, width)
                    edges = np.frombuffer(e, np.int32).reshape(len(original), -1).astype(np.int64)
                    now, graph = (s, width), (original, np.frombuffer(i, np.int64).reshape(len(original), -1), edges, np.frombuffer(t, np.int32).astype(np.int64))
                elif now == (s, width):
                    yield _answers(*graph, np.frombuffer(x).reshape(-1, width), np.frombuffer(i, np.int64), k, beam)

    found = streams.mapInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(best))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


_ROW = "shard int, width int, kind int, x binary, ids binary, edges binary, entries binary"
_ROW_NAMES = ["shard", "width", "kind", "x", "ids", "edges", "entries"]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows of a and b in double precision, each sum in the order of the components."""
    dot, aa, bb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for j in range(a.shape[1]):
        dot += a[:, j] * b[:, j]
        aa += a[:, j] * a[:, j]
        bb += b[:, j] * b[:, j]
    return dot / (np.sqrt(aa) * np.sqrt(bb))


def _answers(original, ids, edges, entries, asked, asked_ids, k, beam) -> pa.RecordBatch:
    scaled = original / np.abs(original).max(1, keepdims=True)
    unit = (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)).astype(np.float32)
    scaled = asked / np.abs(asked).max(1, keepdims=True)
    near, _ = beam_search(unit, edges, entries, (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)).astype(np.float32), beam)
    q, j = np.nonzero(near >= 0)
    point = near[q, j]
    score = cosine(asked[q], original[point])
    every = ids[point]
    row, col = np.nonzero((every >= 0) & (every != asked_ids[q][:, None]))
    query, score, vec = q[row], score[row], every[row, col]
    order = np.lexsort((vec, -score, query))
    query, score, vec = query[order], score[order], vec[order]
    first = np.searchsorted(query, query)
    keep = np.arange(len(query)) - first < k
    return pa.RecordBatch.from_arrays(
        [pa.array(asked_ids[query[keep]]), pa.array(vec[keep]), pa.array(score[keep])], names=["query_id", "vec_id", "score"])


def op5_nearest(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    out = nearest(rows, rows.filter(F.col("vec_id") % 50 == 0))
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
