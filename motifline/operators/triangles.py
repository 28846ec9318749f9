"""Triangles of one label: blocks of edges meet by threes, no partial match is written.

Joining two edges first writes every pair of edges at a vertex, which is edges times degree. Here vertices are hashed
to ``p`` buckets and ordered by (bucket, id), so that an edge has one direction and a triangle one set of buckets
i <= j <= k. The task of these three gets the blocks (i, j), (j, k) and (i, k) and counts the triangles with one edge
in each. An edge is sent ``p`` times, packed to a few bytes, and ``p`` grows with the root of the number of edges.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifline.operators.graph import LabeledGraph
from motifline.plans.pattern import QueryGraph

#: Edges of a block, about.
BLOCK = 3_000_000
#: Edges packed at once, and neighbours looked up at once.
PACKED, LOOKED = 2_000_000, 500_000


def is_triangle(query: QueryGraph) -> bool:
    """Three vertices of one label, each joined to the others."""
    return len(query.labels) == 3 and len(set(query.labels.values())) == 1 and all(len(n) == 2 for n in query.neighbours.values())


def buckets(edges: int, block: int) -> int:
    """So many that two different ones have ``block`` of the undirected edges between them."""
    return max(1, int(np.ceil((2 * edges / block) ** 0.5)))


def _pack(u: np.ndarray, v: np.ndarray) -> bytes:
    """Edges sorted by (u, v): the number, then the bytes of the differences of u and of v by place, compressed."""
    parts = [np.diff(x, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for x in (u, v)]
    return len(u).to_bytes(8, "little") + pa.compress(b"".join(parts), codec="zstd", asbytes=True)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    raw = np.frombuffer(pa.decompress(data[8:], 16 * n, codec="zstd", asbytes=True), np.uint8).reshape(2, 8, n)
    u, v = (np.cumsum(np.ascontiguousarray(x.T).view("<i8").ravel()) for x in raw)
    return u, v


def _dealt(p: int):
    """Rows (src, dst, i, j) with i <= j -> (task, block, edges): a block's edges for each task that needs it."""
    tasks = {t: n for n, t in enumerate(combinations_with_replacement(range(p), 3))}
    needed: dict[int, list[int]] = {}
    for (i, j, k), n in tasks.items():
        for a, b in {(i, j), (j, k), (i, k)}:
            needed.setdefault(a * p + b, []).append(n)

    def run(batches):
        held, n = [], 0

        def rows():
            u, v, i, j = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in range(4))
            block = i.astype(np.int64) * p + j
            order = np.lexsort((v, u, block))
            u, v, block = u[order], v[order], block[order]
            found, first = np.unique(block, return_index=True)
            for b, lo, hi in zip(found.tolist(), first, [*first[1:], len(block)]):
                data, to = _pack(u[lo:hi], v[lo:hi]), needed[b]
                for t in to:
                    yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([b], pa.int64()), pa.array([data], pa.binary())], ["task", "block", "edges"])

        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= PACKED:
                yield from rows()
                held, n = [], 0
        if n:
            yield from rows()

    return run


class _Block:
    """Edges sorted by (u, v): each u, the first place and the number of its neighbours, and all v."""

    def __init__(self, parts: list[bytes]):
        both = [_unpack(x) for x in parts]
        u, v = (np.concatenate([b[k] for b in both]) for k in range(2))
        del both
        order = np.lexsort((v, u))
        u, self.v = u[order], v[order]
        self.first = np.flatnonzero(np.diff(u, prepend=u[0] - 1))
        self.own, self.count = u[self.first], np.diff(self.first, append=len(u))

    def place(self, ids: np.ndarray) -> np.ndarray:
        """Which u each of ``ids`` is; -1 for none."""
        at = np.minimum(np.searchsorted(self.own, ids), len(self.own) - 1)
        return np.where(self.own[at] == ids, at, -1).astype(np.int32)


def _members(near: _Block, own: np.ndarray, ranks: np.ndarray, other: np.ndarray, codes: np.ndarray, width: int) -> int:
    """How many (other, w), w the neighbours in ``near`` of the u at ``own``, are among the sorted ``codes``."""
    ends = np.cumsum(near.count[own])
    total = lo = base = 0
    while lo < len(own):
        hi = max(lo + 1, int(np.searchsorted(ends, base + LOOKED, "right")))
        c = near.count[own[lo:hi]]
        skip = near.first[own[lo:hi]] - (ends[lo:hi] - c - base)
        wanted = np.repeat(other[lo:hi].astype(np.int64) * width, c)
        wanted += ranks[np.arange(len(wanted)) + np.repeat(skip, c)]
        at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
        total += int(np.count_nonzero(codes[at] == wanted))
        lo, base = hi, int(ends[hi - 1])
    return total


def _closed(ab: _Block, bc: _Block, ac: _Block) -> int:
    """Triangles with one edge in each block: for every edge of ``ab`` its end of fewer neighbours is gone through."""
    ids = np.union1d(np.unique(bc.v), np.unique(ac.v))
    ranks = {x: np.searchsorted(ids, x.v).astype(np.int32) for x in (bc, ac)}
    u, v = np.repeat(ac.place(ab.own), ab.count), bc.place(ab.v)
    both = (u >= 0) & (v >= 0)
    u, v = u[both], v[both]
    few = ac.count[u] <= bc.count[v]
    total = 0
    for near, own, far, other, pick in ((ac, u, bc, v, few), (bc, v, ac, u, ~few)):
        chosen = np.flatnonzero(pick)
        chosen = chosen[np.argsort(other[chosen], kind="stable")]  # lookups near one another
        codes = np.repeat(np.arange(len(far.own)) * len(ids), far.count)
        codes += ranks[far]
        total += _members(near, own[chosen], ranks[near], other[chosen], codes, len(ids))
    return total


def _counted(p: int):
    """Rows (task, block, edges), all of a task -> (n)."""
    tasks = list(combinations_with_replacement(range(p), 3))

    def run(batches):
        held: dict[int, dict[int, list[bytes]]] = {}
        for b in batches:
            for t, block, data in zip(*(c.to_pylist() for c in b.columns)):
                held.setdefault(t, {}).setdefault(block, []).append(data)
        while held:
            t, parts = held.popitem()
            i, j, k = tasks[t]
            names = (i * p + j, j * p + k, i * p + k)
            if all(x in parts for x in names):
                made = {x: _Block(parts.pop(x)) for x in set(names)}
                yield pa.RecordBatch.from_arrays([pa.array([_closed(*(made[x] for x in names))], pa.int64())], ["n"])

    return run


def count_triangles(graph: LabeledGraph, label: int, block: int = BLOCK) -> DataFrame:
    """(n_matches) of a triangle of vertices of ``label``, each found in its six orders."""
    p = buckets(graph.pair_counts([label])[label, label] // 2, block)
    tasks = p * (p + 1) * (p + 2) // 6
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(p)).cast("int")
    edges = graph.slice(label, label).select("src", "dst", bucket("src").alias("i"), bucket("dst").alias("j"))
    edges = edges.where("i < j or (i = j and src < dst)")
    dealt = edges.mapInArrow(_dealt(p), "task int, block bigint, edges binary").repartitionById(tasks, F.col("task"))
    return dealt.mapInArrow(_counted(p), "n bigint").agg((F.coalesce(F.sum("n"), F.lit(0)) * 6).cast("bigint").alias("n_matches"))
