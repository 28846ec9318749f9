"""Candidate filters: label, degree, neighbour labels, edge reduction, frontier classification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifline.operators.graph import LabeledGraph
from motifline.plans.pattern import QueryGraph


def label_is(query: QueryGraph, u: int) -> Column:
    return F.col("label") == query.labels[u]


def degree_fits(query: QueryGraph, u: int) -> Column:
    """Label and at least the query vertex's degree."""
    return label_is(query, u) & (F.col("degree") >= query.degree(u))


def neighbours_fit(query: QueryGraph, u: int) -> Column:
    """At least as many neighbours of every label."""
    need = query.neighbour_labels(u).items()
    return reduce(lambda a, b: a & b, [F.coalesce(F.col("near")[label], F.lit(0)) >= n for label, n in need], F.lit(True))


def candidates(graph: LabeledGraph, query: QueryGraph, u: int, level: str = "neighbours") -> DataFrame:
    """Ids that may match ``u``: by "label", "degree" (and label) or "neighbours" (and both).

    Only edges from the label of ``u`` are read, counted before they are shuffled.
    """
    if level == "label" or not query.neighbours[u]:
        return graph.vertices.where(label_is(query, u)).select("id")
    need = query.neighbour_labels(u) if level == "neighbours" else {}
    counts = [F.count(F.when(F.col("dst_label") == x, 1)).alias(f"n{i}") for i, x in enumerate(need)]
    near = graph.edges.where(F.col("src_label") == query.labels[u]).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), *counts)
    fits = [F.col("n") >= query.degree(u), *(F.col(f"n{i}") >= n for i, n in enumerate(need.values()))]
    return near.where(reduce(lambda a, b: a & b, fits)).select("id")


def classify(graph: LabeledGraph, workload: list[QueryGraph], frontier: DataFrame | None = None) -> DataFrame:
    """(query_vertex, id): every data vertex (of ``frontier``) with all query vertices it may match, in one pass."""
    rows = graph.profiles if frontier is None else graph.profiles.join(frontier.select("id").distinct(), "id", "left_semi")
    found = [F.when(degree_fits(q, u) & neighbours_fit(q, u), F.lit(u)) for q in workload for u in q.labels]
    return rows.select(F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("query_vertex"), "id")


def reduce_edge(graph: LabeledGraph, left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates of the ends of a query edge: left ones with a neighbour among the right, then the converse."""
    pairs = graph.edges.select("src", "dst")
    near = pairs.join(right.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"))
    left = left.join(near, "id", "left_semi")
    near = pairs.join(left.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"))
    return left, right.join(near, "id", "left_semi")


def needs_no_row(query: QueryGraph, levels: tuple[tuple[int, ...], ...], u: int) -> bool:
    """Whether all neighbours of ``u`` are on the level before: its label in the edge is then enough."""
    depth = {v: i for i, level in enumerate(levels) for v in level}
    return all(depth[n] < depth[u] for n in query.neighbours[u])


def with_common(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (a, b) for which an element c is in both ``left`` (a, c) and ``right`` (b, c); no list is gathered."""
    return pairs.join(left, "a").join(right, ["b", "c"], "left_semi").select("a", "b").distinct()
