"""Level-synchronous growth of candidates: filter, pull neighbours, prune by edges inside a level, eliminate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifline.operators.filters import candidates, reduce_edge
from motifline.operators.graph import LabeledGraph
from motifline.plans.pattern import QueryGraph
from motifline.plans.planner import Plan, roles
from motifline.session import discard, materialize


def neighbours_of(graph: LabeledGraph, frontier: DataFrame, a: int, b: int) -> DataFrame:
    """(id): vertices of label ``b`` next to one of ``frontier`` (id), which have label ``a``."""
    near = graph.slice(a, b).join(frontier.select(F.col("id").alias("src")), "src", "left_semi")
    return near.select(F.col("dst").alias("id")).distinct()


def khop(graph: LabeledGraph, seeds: DataFrame, labels: list[int]) -> list[DataFrame]:
    """Frontiers (id) from ``seeds``, which have the first label, one level for each further label."""
    out = [seeds.select("id")]
    for a, b in zip(labels, labels[1:]):
        out.append(neighbours_of(graph, out[-1], a, b))
    return out


def grow(graph: LabeledGraph, plan: Plan, level: str = "neighbours", prune: bool = True) -> dict[int, DataFrame]:
    """Candidates (id) of every query vertex, level by level from the plan's root; each set is a written table.

    A candidate passes the filter ``level`` and has a neighbour among the candidates of every parent; with
    ``prune``, edges between vertices of one level reduce both ends, in the query's order of edges. After a
    level with a vertex without candidates nothing is pulled any more, and all later sets are empty.
    """
    query: QueryGraph = plan.query
    found = {plan.root: materialize(candidates(graph, query, plan.root, level), "candidates")}
    part, over = roles(query, plan.root), eliminated(found)
    for vertices in plan.levels[1:]:
        if over:
            found.update({u: found[plan.root].limit(0) for u in vertices})
            continue
        own = {}
        for u in vertices:
            own[u] = candidates(graph, query, u, level)
            for p in part[u]["parents"]:
                own[u] = own[u].join(neighbours_of(graph, found[p], query.labels[p], query.labels[u]), "id", "left_semi")
            own[u] = materialize(own[u], "candidates")
        inside = sorted((a, b) for a, b in query.edges if a in own and b in own)
        for a, b in inside if prune else ():
            last = own[a], own[b]
            own[a], own[b] = (materialize(x, "candidates") for x in reduce_edge(graph, *last))
            discard(last[0]), discard(last[1])
        over = eliminated(own)
        found.update(own)
    return found


def sizes(found: dict[int, DataFrame]) -> DataFrame:
    """(u, n): how many candidates each query vertex has."""
    return reduce(DataFrame.union, [df.agg(F.count("*").alias("n")).select(F.lit(u).alias("u"), "n") for u, df in found.items()])


def eliminated(found: dict[int, DataFrame]) -> bool:
    """Whether some query vertex has no candidate, so that the query has no match."""
    some = [df.limit(1).select(F.lit(u).alias("u")) for u, df in found.items()]
    return reduce(DataFrame.union, some).distinct().count() < len(found)
