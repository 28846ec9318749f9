"""Connected components by alternating large and small stars, on DataFrames only.

Each round is two aggregations; the number of rounds grows with the logarithm of the nodes. Before each
round every task replaces its own edges by a spanning star of each part they connect (union-find over
one partition), which shortens long chains at once. Rounds are written tables, so no lineage piles up.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifline.session import discard, materialize

#: Rows of a key from which on it is heavy, and heavy keys treated apart at most.
HEAVY, MAX_HEAVY = 1_000, 1_000


def _contract(batches):
    """Edges of one task -> (member, least member) of each part they connect."""
    parent: dict = {}

    def find(x):
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for b in batches:
        for a, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            parent.setdefault(a, a)
            parent.setdefault(c, c)
            a, c = find(a), find(c)
            if a != c:
                parent[max(a, c)] = min(a, c)
    nodes = [x for x in parent if find(x) != x]
    for i in range(0, len(nodes), 10_000):
        part = nodes[i : i + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([find(x) for x in part], pa.binary())], ["a", "b"])


def join_unique(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined ("inner" or "left") with ``table``, which has one row a key.

    Rows of the ``MAX_HEAVY`` most frequent keys, if over ``HEAVY`` each, stay where they are: their rows of
    ``table``, at most so many, are broadcast. No key can then fill a task.
    """
    top = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > HEAVY)
    heavy = [r[key] for r in top.orderBy(F.desc("n")).limit(MAX_HEAVY).collect()]
    if not heavy:
        return rows.join(table, key, how)
    few = F.coalesce(F.col(key).isin(heavy), F.lit(False))
    return rows.where(~few).join(table.where(~few), key, how).unionByName(rows.where(few).join(F.broadcast(table.where(few)), key, how))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links neighbours to the least of them: those above the node (large), or those below and the node itself."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(edges.select("b", "a"))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = join_unique(both, least, "u")
    if large:
        out = out.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = out.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u"), F.col("m")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: binary); component: the least node connected."""
    now, seen = materialize(edges.select("a", "b").where("a <> b").mapInArrow(_contract, "a binary, b binary"), "edges"), None
    for _ in range(rounds):
        state = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if state == seen or not state[0]:
            break
        seen, last = state, now
        now = materialize(_star(_star(now, True), False), "edges", state[0])
        discard(last)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    out = now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
    out._motifline_path = now._motifline_path
    return out
