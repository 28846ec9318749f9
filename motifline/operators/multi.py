"""Workloads: stars that several queries share are matched once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifline.operators.aggregate import two_phase
from motifline.operators.filters import candidates
from motifline.operators.graph import LabeledGraph
from motifline.operators.match import MatchConfig, count_plan, extend, name
from motifline.plans.pattern import QueryGraph, query_labels
from motifline.plans.planner import Group, Plan, group_queries, make_plan, order_steps
from motifline.session import materialize


def star_size(graph: LabeledGraph, root_label: int, labels: tuple[int, ...]) -> DataFrame:
    """(n): matches of a star of one leaf for each label, from neighbour counts alone."""
    near = graph.edges.where((F.col("src_label") == root_label) & F.col("dst_label").isin(list(labels)))
    counts = near.groupBy("src").pivot("dst_label", list(labels)).agg(F.count(F.lit(1)))
    product = reduce(lambda a, b: a * b, [F.coalesce(F.col(str(x)), F.lit(0)).cast("double") for x in labels], F.lit(1.0))
    return counts.agg(F.coalesce(F.sum(product), F.lit(0.0)).alias("n"))


def star_matches(graph: LabeledGraph, group: Group, roots: DataFrame | None = None) -> DataFrame:
    """Columns root and leaf_<label>: the common star with its common edges between leaves; of ``roots`` (id) only."""
    found = None
    for label in group.star_labels:
        edge = graph.slice(group.root_label, label).select(F.col("src").alias("root"), F.col("dst").alias(f"leaf_{label}"))
        if found is None and roots is not None:
            edge = edge.join(roots.withColumnRenamed("id", "root"), "root", "left_semi")
        found = edge if found is None else found.join(edge, "root")
        for a, b in group.star_edges:
            if b == label:
                inner = graph.slice(a, b).select(F.col("src").alias(f"leaf_{a}"), F.col("dst").alias(f"leaf_{b}"))
                found = found.join(inner, [f"leaf_{a}", f"leaf_{b}"], "left_semi")
    return found


def continue_star(graph: LabeledGraph, star: DataFrame, group: Group, plan: Plan, config: MatchConfig) -> DataFrame:
    """A query's matches from the shared star: edges that only it has, then its other vertices."""
    q, at = plan.query, group.mapped(plan)
    found = star.select(F.col("root").alias(name(plan.root)), *[F.col(f"leaf_{x}").alias(name(v)) for x, v in at.items()])
    for a in at:
        for b in at:
            if a < b and at[b] in q.neighbours[at[a]] and (a, b) not in group.star_edges:
                edge = graph.slice(a, b).select(F.col("src").alias(name(at[a])), F.col("dst").alias(name(at[b])))
                found = found.join(edge, [name(at[a]), name(at[b])], "left_semi")
    done = [plan.root, *at.values()]
    rest = [s.vertex for s in plan.steps if s.vertex not in done]
    labels = set(q.labels.values())
    for s in order_steps(q, [*done, *rest], graph.frequencies(labels), graph.pair_counts(labels))[len(done) :]:
        found = extend(graph, found, q, s, config)
    return found


def count_workload(graph: LabeledGraph, workload: list[QueryGraph], config: MatchConfig = MatchConfig()) -> DataFrame:
    """(query_id, n_matches), one row a query, in any order."""
    spark = graph.vertices.sparkSession
    labels = query_labels(workload)
    frequency, pairs = graph.frequencies(labels), graph.pair_counts(labels)
    plans = [make_plan(q, frequency, config.collapse and config.semantics != "induced", pairs=pairs) for q in workload]
    # no vertex of some label, or no edge between the labels of a query edge
    empty = [p for p in plans if any(not frequency.get(x) for x in p.query.labels.values()) or any(not pairs[p.query.labels[a], p.query.labels[b]] for a, b in p.query.edges)]
    plans_left = [p for p in plans if p not in empty]
    shares = config.share and config.semantics == "iso" and not config.grow
    groups = group_queries(plans_left, config.exact_groups) if shares else []
    parts, shared = [], set()
    for g in groups:
        if len(g.plans) < 2 or star_size(graph, g.root_label, g.star_labels).first()["n"] > config.share_limit:
            continue
        roots = None
        if config.root_filter != "label":
            roots = reduce(DataFrame.union, [candidates(graph, p.query, p.root, config.root_filter) for p in g.plans]).distinct()
        star = materialize(star_matches(graph, g, roots), "star")
        for p in g.plans:
            uncounted = Plan(p.query, p.root, p.levels, p.steps, tuple(x for x in p.leaves if x[0] not in g.mapped(p).values()))
            found = continue_star(graph, star, g, uncounted, config)
            parts.append((p, count_plan(graph, uncounted, config, found)))
            shared.add(p.root)
    for p in plans_left:
        if p.root not in shared:
            parts.append((p, count_plan(graph, p, config)))
    every = spark.createDataFrame([(p.root,) for p in plans], "query_id int")
    if not parts:
        return every.withColumn("n_matches", F.lit(0).cast("bigint"))
    counts = reduce(DataFrame.union, [c.select(F.lit(p.root).alias("query_id"), "n_matches") for p, c in parts])
    total = two_phase(counts, ["query_id"], {"n": F.sum("n_matches")}, {"n_matches": F.sum("n")}, ["n_matches"])
    return every.join(total, "query_id", "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0)).cast("bigint"))
