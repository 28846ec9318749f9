"""Matching: left-deep joins in plan order, early closing, counted leaves."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifline.operators.filters import candidates
from motifline.operators.graph import LabeledGraph
from motifline.operators.growth import eliminated, grow
from motifline.operators.triangles import count_triangles, is_triangle
from motifline.plans.pattern import QueryGraph
from motifline.plans.planner import Plan, Step, make_plan


@dataclass(frozen=True)
class MatchConfig:
    """Switches; none changes a result. semantics other than "iso" are extensions."""

    semantics: str = "iso"  # "iso", "homo", "induced"
    collapse: bool = True  # count fresh leaves by degree instead of listing them
    root_filter: str = "neighbours"  # candidates of the root
    grow: str = ""  # "label", "degree" or "neighbours": candidates of all vertices first, level by level
    prune: bool = True  # with grow: reduce candidates by edges inside a level
    intersect: bool = False  # close several edges by counted intersection instead of semi-joins
    share: bool = True  # common stars of a workload once
    share_limit: int = 50_000_000  # rows of a star, estimated, beyond which it is not kept
    exact_groups: bool = True


def name(u: int) -> str:
    return f"u{u}"


def intersect_lists(found: DataFrame, lists: list[DataFrame], u: str) -> DataFrame:
    """``found`` with every ``u`` that all of ``lists`` hold; each list has ``u`` and one column of ``found``.

    An element is in the intersection if it comes up once for each list; no list is gathered.
    """
    named = [found.join(x, [c for c in x.columns if c != u]).select(*found.columns, u) for x in lists]
    rows = named[0]
    for x in named[1:]:
        rows = rows.unionByName(x)
    return rows.groupBy(*found.columns, u).agg(F.count("*").alias("_n")).where(F.col("_n") == len(lists)).drop("_n")


def extend(
    graph: LabeledGraph, found: DataFrame, query: QueryGraph, step: Step, config: MatchConfig = MatchConfig(), grown: dict[int, DataFrame] | None = None
) -> DataFrame:
    """Partial matches with one more vertex: an edge from ``via``, semi-joins for the other edges.

    ``grown``: candidates of the query's vertices, to which the new one is restricted.
    """
    u = name(step.vertex)

    def edge(p: int) -> DataFrame:
        out = graph.slice(query.labels[p], step.label).select(F.col("src").alias(name(p)), F.col("dst").alias(u))
        return out.join(grown[step.vertex].withColumnRenamed("id", u), u, "left_semi") if grown and step.vertex in grown else out

    counted = config.intersect and step.closing
    if counted:
        out = intersect_lists(found, [edge(p) for p in (step.via, *step.closing)], u)
    else:
        out = found.join(edge(step.via), name(step.via))
    if config.semantics != "homo":
        for w in step.differs:
            out = out.where(F.col(u) != F.col(name(w)))
    for p in () if counted else step.closing:
        near = graph.slice(query.labels[p], step.label).select(F.col("src").alias(name(p)), F.col("dst").alias(u))
        out = out.join(near, [name(p), u], "left_semi")
    if config.semantics == "induced":
        placed = [int(c[1:]) for c in found.columns if c.startswith("u")]
        for p in placed:
            if p != step.via and p not in step.closing:
                near = graph.slice(query.labels[p], step.label).select(F.col("src").alias(name(p)), F.col("dst").alias(u))
                out = out.join(near, [name(p), u], "left_anti")
    return out


def root_matches(graph: LabeledGraph, plan: Plan, config: MatchConfig = MatchConfig()) -> DataFrame:
    level = "label" if config.semantics == "homo" else config.root_filter
    return candidates(graph, plan.query, plan.root, level).select(F.col("id").alias(name(plan.root)))


def run_steps(graph: LabeledGraph, plan: Plan, config: MatchConfig) -> DataFrame:
    """Matches of all vertices but the counted leaves."""
    steps, grown = plan.steps, None
    if config.grow and config.semantics != "homo":
        grown = grow(graph, plan, config.grow, config.prune)
        if eliminated(grown):  # nothing can match: no join is planned
            none = grown[plan.root].limit(0)
            return none.select(*[F.col("id").alias(name(s.vertex)) for s in steps])
        found, rest = grown[plan.root].select(F.col("id").alias(name(plan.root))), steps[1:]
    elif len(steps) > 1 and config.root_filter == "label":  # the first edge already holds every root that matters
        s = steps[1]
        edge = graph.slice(plan.query.labels[plan.root], s.label)
        found, rest = edge.select(F.col("src").alias(name(plan.root)), F.col("dst").alias(name(s.vertex))), steps[2:]
    else:
        found, rest = root_matches(graph, plan, config), steps[1:]
    for s in rest:
        found = extend(graph, found, plan.query, s, config, grown)
    return found


def leaf_counts(graph: LabeledGraph, found: DataFrame, plan: Plan) -> DataFrame:
    """Adds ``weight``: the product of the counted leaves' numbers of choices."""
    weight = F.lit(1).cast("bigint")
    for leaf, near in plan.leaves:
        label = plan.query.labels[leaf]
        counts = graph.edges.where((F.col("src_label") == plan.query.labels[near]) & (F.col("dst_label") == label))
        counts = counts.groupBy(F.col("src").alias(name(near))).agg(F.count("*").alias(f"n{leaf}"))
        found = found.join(counts, name(near))
        weight = weight * F.col(f"n{leaf}")
    return found.select(weight.alias("weight"))


def count_plan(graph: LabeledGraph, plan: Plan, config: MatchConfig = MatchConfig(), found: DataFrame | None = None) -> DataFrame:
    """(n_matches): one row."""
    found = run_steps(graph, plan, config) if found is None else found
    if plan.leaves:
        return leaf_counts(graph, found, plan).agg(F.coalesce(F.sum("weight"), F.lit(0)).cast("bigint").alias("n_matches"))
    return found.agg(F.count("*").alias("n_matches"))


class Matcher:
    """Counts and lists matches of query graphs in one data graph."""

    def __init__(self, graph: LabeledGraph, config: MatchConfig = MatchConfig()):
        self.graph, self.config = graph, config

    def plan(self, query: QueryGraph, collapse: bool | None = None) -> Plan:
        labels = set(query.labels.values())
        wanted = self.config.collapse and self.config.semantics != "induced" if collapse is None else collapse
        return make_plan(query, self.graph.frequencies(labels), wanted, pairs=self.graph.pair_counts(labels))

    def embeddings(self, query: QueryGraph) -> DataFrame:
        """One row a match, column u<id> for each query vertex."""
        plan = self.plan(query, collapse=False)
        return run_steps(self.graph, plan, self.config).select(*[name(u) for u in query.labels])

    def count(self, query: QueryGraph) -> DataFrame:
        """(n_matches); triangles of one label by blocks of edges, unless candidates or intersections are asked for."""
        if is_triangle(query) and not self.config.grow and not self.config.intersect:
            return count_triangles(self.graph, next(iter(query.labels.values())))
        return count_plan(self.graph, self.plan(query), self.config)

    def count_workload(self, workload: list[QueryGraph]) -> DataFrame:
        """(query_id, n_matches): query_id is the root of the query's plan; queries without a match have 0."""
        from motifline.operators.multi import count_workload

        return count_workload(self.graph, workload, self.config)

    def explain(self, workload: list[QueryGraph]) -> str:
        lines = []
        for q in workload:
            p = self.plan(q)
            lines.append(f"query{p.root}: levels {[list(x) for x in p.levels]}; leaves counted {[v for v, _ in p.leaves]}")
            for s in p.steps:
                lines.append(f"  u{s.vertex} label {s.label} via {s.via} closing {list(s.closing)} differs from {list(s.differs)}")
        return "\n".join(lines)
