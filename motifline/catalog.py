"""Registered queries of the graph engine over the driver's tables, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifline.functions import lsh
from motifline.operators import aggregate, filters, growth, multi, partition
from motifline.operators.graph import GraphError
from motifline.operators.match import MatchConfig, Matcher, extend, intersect_lists, name
from motifline.plans import planner
from motifline.plans.pattern import QueryGraph
from motifline.session import checkpoint_dir
from motifline.sources import text
from motifline.sources.tables import part_graph, schema_graph
from motifline.sources.text import parse_lines, workload_tables

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

PART = """WITH RECURSIVE a AS (SELECT DISTINCT l_orderkey o, l_partkey p FROM lineitem),
pe AS (SELECT DISTINCT x.p src, y.p dst FROM a x JOIN a y ON x.o = y.o AND x.p <> y.p),
v AS (SELECT p_partkey id, CAST(p_size % 8 AS INT) label FROM part),
e AS (SELECT src, v1.label src_label, dst, v2.label dst_label FROM pe JOIN v v1 ON v1.id = src JOIN v v2 ON v2.id = dst)"""


def _schema_sql() -> str:
    node = lambda label, key: f"{label} * CAST(1000000000 AS BIGINT) + CAST({key} AS BIGINT)"
    kinds = (("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"), ("orders", "o_orderkey"))
    v = " UNION ALL ".join(f"SELECT {node(i, k)} id, {i} label FROM {t}" for i, (t, k) in enumerate(kinds))
    links = (("nation", 1, "n_nationkey", 0, "n_regionkey"), ("customer", 2, "c_custkey", 1, "c_nationkey"), ("supplier", 3, "s_suppkey", 1, "s_nationkey"), ("orders", 5, "o_orderkey", 2, "o_custkey"), ("lineitem", 5, "l_orderkey", 4, "l_partkey"), ("lineitem", 5, "l_orderkey", 3, "l_suppkey"), ("lineitem", 4, "l_partkey", 3, "l_suppkey"))
    e = " UNION ".join(f"SELECT DISTINCT {node(a, x)} src, {a} src_label, {node(b, y)} dst, {b} dst_label FROM {t}" for t, a, x, b, y in links)
    return f"WITH v AS ({v}), h AS ({e}), e AS (SELECT * FROM h UNION SELECT dst, dst_label, src, src_label FROM h)"


def register(key: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        _QUERIES[key] = f
        if sql:
            _SQL[key] = f"{sql} ORDER BY ALL"  # a bare LIMIT around a join of common tables stalls in DuckDB
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def match_sql(query: QueryGraph, select: str, graph: str = PART) -> str:
    """Self-joins of the edges in file order, checks for every edge and for distinct vertices."""
    order, left = [next(iter(query.labels))], list(query.labels)[1:]
    while left:
        u = next(x for x in left if any(n in order for n in query.neighbours[x]))
        order.append(u)
        left.remove(u)
    tables, at = [], {}
    for i, u in enumerate(order[1:]):
        p = next(n for n in order if n in query.neighbours[u] and order.index(n) < order.index(u))
        if not at:
            at[order[0]] = "e0.src"
        on = [f"e{i}.src_label = {query.labels[p]}", f"e{i}.dst_label = {query.labels[u]}"]
        if i:
            on.append(f"e{i}.src = {at[p]}")
        at[u] = f"e{i}.dst"
        on += [f"{at[u]} <> {at[w]}" for w in at if w != u and query.labels[w] == query.labels[u]] if i else [f"{at[u]} <> e0.src"]
        for n in query.neighbours[u]:
            if n in at and n != p:
                on.append(f"EXISTS (SELECT 1 FROM e c WHERE c.src = {at[n]} AND c.dst = {at[u]})")
        tables.append((f"e e{i}", on))
    exists = [c for _, on in tables for c in on if c.startswith("EXISTS")]
    plain = lambda on: " AND ".join(c for c in on if not c.startswith("EXISTS"))
    text = f"FROM {tables[0][0]} " + " ".join(f"JOIN {t} ON {plain(on)}" for t, on in tables[1:])
    where = " AND ".join([plain(tables[0][1]), *exists])
    return f"{graph} SELECT {select.format(**{name(u): c for u, c in at.items()})} {text} WHERE {where}"


# Patterns, vertices numbered from 0.
PATTERNS = {
    "edge": QueryGraph.of([0, 1], (0, 1)),
    "path4": QueryGraph.of([0, 1, 2, 3], (0, 1), (1, 2), (2, 3)),
    "star3": QueryGraph.of([0, 1, 2, 3], (0, 1), (0, 2), (0, 3)),
    "star_repeated_label": QueryGraph.of([0, 1, 1, 2], (0, 1), (0, 2), (0, 3)),
    "triangle": QueryGraph.of([0, 1, 2], (0, 1), (1, 2), (0, 2)),
    "triangle_repeated_label": QueryGraph.of([0, 1, 1], (0, 1), (1, 2), (0, 2)),
    "square": QueryGraph.of([0, 1, 2, 3], (0, 1), (1, 2), (2, 3), (0, 3)),
    "tailed_triangle": QueryGraph.of([0, 1, 2, 1], (0, 1), (1, 2), (0, 2), (2, 3)),
    "clique4": QueryGraph.of([0, 1, 2, 3], (0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)),
    "sample_shape": QueryGraph.of([0, 2, 1, 1, 3], (0, 1), (0, 2), (1, 2), (1, 3), (3, 4)),
}
LEAFED = QueryGraph.of([0, 1, 2, 3], (0, 1), (1, 2), (0, 2), (2, 3))

for _name, _query in PATTERNS.items():

    def _count(spark: SparkSession, sf_dir: str, query: QueryGraph = _query) -> DataFrame:
        return Matcher(part_graph(spark, sf_dir), MatchConfig(root_filter="label")).count(query)

    register(f"count_{_name}", match_sql(_query, "count(*) AS n_matches"))(_count)


@register("graph_vertices", f"{PART} SELECT id, label FROM v")
def graph_vertices(spark, sf_dir):
    return part_graph(spark, sf_dir).vertices


@register("graph_edges_symmetric", f"{PART} SELECT src, src_label, dst, dst_label FROM e")
def graph_edges_symmetric(spark, sf_dir):
    return part_graph(spark, sf_dir).edges


@register("adjacency_rows", f"{PART} SELECT v.id, v.label, count(dst) AS deg, coalesce(string_agg(dst || ' ' || dst_label, ' ' ORDER BY dst), '') AS adj FROM v LEFT JOIN e ON src = v.id GROUP BY ALL")
def adjacency_rows(spark, sf_dir):
    adj = part_graph(spark, sf_dir).adjacency()
    text = F.array_join(F.transform("adj", lambda x: F.concat_ws(" ", x["id"], x["l"])), " ")
    return adj.select("id", "label", F.size("adj").cast("bigint").alias("deg"), text.alias("adj"))


@register("parse_vertex_lines", f"{PART} SELECT v.id, v.label, count(dst) AS deg, CAST(coalesce(sum(dst_label), 0) AS BIGINT) AS label_sum FROM v LEFT JOIN e ON src = v.id GROUP BY ALL")
def parse_vertex_lines(spark, sf_dir):
    item = F.transform("adj", lambda x: F.concat_ws(" ", x["id"], x["l"]))
    lines = part_graph(spark, sf_dir).adjacency().select(F.concat(F.concat_ws(" ", "id", "label"), F.lit("\t"), F.array_join(item, " ")).alias("value"))
    total = F.aggregate("adj", F.lit(0).cast("bigint"), lambda s, x: s + x["l"])
    return parse_lines(lines).where("good").select("id", "label", F.size("adj").cast("bigint").alias("deg"), total.alias("label_sum"))


@register("validate_graph", f"{PART} SELECT 'problems' AS what, count(*) AS n FROM e WHERE src = dst OR NOT EXISTS (SELECT 1 FROM e b WHERE b.src = e.dst AND b.dst = e.src)")
def validate_graph(spark, sf_dir):
    found = part_graph(spark, sf_dir).validate()
    return found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("problems").alias("what"), "n")


@register("schema_graph_label_pairs", f"{_schema_sql()} SELECT src_label, dst_label, count(*) AS n FROM e GROUP BY ALL")
def schema_graph_label_pairs(spark, sf_dir):
    return schema_graph(spark, sf_dir).edges.groupBy("src_label", "dst_label").agg(F.count("*").alias("n"))


@register("schema_graph_triangle", match_sql(QueryGraph.of([5, 4, 3], (0, 1), (1, 2), (0, 2)), "count(*) AS n_matches", _schema_sql()))
def schema_graph_triangle(spark, sf_dir):
    return Matcher(schema_graph(spark, sf_dir), MatchConfig(root_filter="label")).count(QueryGraph.of([5, 4, 3], (0, 1), (1, 2), (0, 2)))


@register("schema_graph_square", match_sql(QueryGraph.of([2, 5, 3, 1], (0, 1), (1, 2), (2, 3), (0, 3)), "count(*) AS n_matches", _schema_sql()))
def schema_graph_square(spark, sf_dir):
    return Matcher(schema_graph(spark, sf_dir), MatchConfig(root_filter="label")).count(QueryGraph.of([2, 5, 3, 1], (0, 1), (1, 2), (2, 3), (0, 3)))


@register("label_frequency", f"{PART} SELECT label, count(*) AS freq FROM v GROUP BY label")
def label_frequency(spark, sf_dir):
    return part_graph(spark, sf_dir).label_frequency()


@register("vertex_degree", f"{PART} SELECT v.id, v.label, count(dst) AS degree FROM v LEFT JOIN e ON src = v.id GROUP BY ALL")
def vertex_degree(spark, sf_dir):
    return part_graph(spark, sf_dir).profiles.select("id", "label", "degree")


@register("label_pair_counts", f"{PART} SELECT src_label, dst_label, count(*) AS n FROM e GROUP BY ALL")
def label_pair_counts(spark, sf_dir):
    return part_graph(spark, sf_dir).edges.groupBy("src_label", "dst_label").agg(F.count("*").alias("n"))


@register("neighbor_label_frequency", f"{PART} SELECT src AS id, dst_label AS nbr_label, count(*) AS cnt FROM e GROUP BY ALL")
def neighbor_label_frequency(spark, sf_dir):
    return part_graph(spark, sf_dir).neighbour_counts


@register("query_label_trim", f"{PART} SELECT src, src_label, dst, dst_label FROM e WHERE src_label IN (0, 1, 2) AND dst_label IN (0, 1, 2)")
def query_label_trim(spark, sf_dir):
    return part_graph(spark, sf_dir).trimmed([0, 1, 2]).edges


HEAVY = QueryGraph.of([0, *[1] * 20, *[2] * 20], *[(0, i) for i in range(1, 41)])
_NEED = "(SELECT src FROM e GROUP BY src HAVING count(*) FILTER (dst_label = 1) >= 20 AND count(*) FILTER (dst_label = 2) >= 20)"


@register("label_filter", f"{PART} SELECT id FROM v WHERE label = 0")
def label_filter(spark, sf_dir):
    return filters.candidates(part_graph(spark, sf_dir), HEAVY, 0, "label")


@register("ldf_filter", f"{PART} SELECT id FROM v WHERE label = 0 AND id IN (SELECT src FROM e GROUP BY src HAVING count(*) >= 40)")
def ldf_filter(spark, sf_dir):
    return filters.candidates(part_graph(spark, sf_dir), HEAVY, 0, "degree")


@register("nlf_filter", f"{PART} SELECT id FROM v WHERE label = 0 AND id IN {_NEED}")
def nlf_filter(spark, sf_dir):
    return filters.candidates(part_graph(spark, sf_dir), HEAVY, 0)


WORKLOAD = [
    QueryGraph.of({10: 0, 11: 1, 12: 2}, (10, 11), (11, 12), (10, 12)),
    QueryGraph.of({20: 0, 21: 1, 22: 2, 23: 3}, (20, 21), (20, 22), (22, 23)),
    QueryGraph.of({30: 0, 31: 1, 32: 2, 33: 1}, (30, 31), (31, 32), (30, 32), (32, 33)),
    QueryGraph.of({40: 3, 41: 4}, (40, 41)),
    QueryGraph.of({50: 99, 51: 4}, (50, 51)),
    QueryGraph.of({60: 5}),
]
_QV = ", ".join(f"({i}, {k}, {u}, {label}, {q.degree(u)})" for i, q in enumerate(WORKLOAD) for k, (u, label) in enumerate(q.labels.items()))
_QE = ", ".join(f"({i}, {a}, {b}), ({i}, {b}, {a})" for i, q in enumerate(WORKLOAD) for a, b in sorted(q.edges))
WORK = f"{PART}, qv(query, nth, u, label, degree) AS (VALUES {_QV}), qe(query, a, b) AS (VALUES {_QE}), f AS (SELECT label, count(*) freq FROM v GROUP BY label), cost AS (SELECT query, nth, u, qv.label, coalesce(freq, 0) / CAST(greatest(degree, 1) AS DOUBLE) AS cost FROM qv LEFT JOIN f USING (label)), root AS (SELECT query, u, label FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cost, nth) r FROM cost) WHERE r = 1)"


@register("frontier_classify", f"""{WORK}, need AS (SELECT qe.a AS u, qv.label, count(*) AS n FROM qe JOIN qv ON qv.u = qe.b GROUP BY ALL),
have AS (SELECT src AS id, dst_label AS label, count(*) AS n FROM e GROUP BY ALL)
SELECT qv.u AS query_vertex, v.id FROM qv JOIN v ON v.label = qv.label
WHERE NOT EXISTS (SELECT 1 FROM need LEFT JOIN have ON have.id = v.id AND have.label = need.label WHERE need.u = qv.u AND coalesce(have.n, 0) < need.n)""")
def frontier_classify(spark, sf_dir):
    return filters.classify(part_graph(spark, sf_dir), WORKLOAD)


_C1, _C2 = "(SELECT id FROM v WHERE label = 0)", "(SELECT id FROM v WHERE label = 1)"


@register("edge_check_reduce", f"""{PART}, l AS (SELECT id FROM {_C1} WHERE EXISTS (SELECT 1 FROM e WHERE src = id AND dst IN {_C2})),
r AS (SELECT id FROM {_C2} WHERE EXISTS (SELECT 1 FROM e WHERE src = id AND dst IN (SELECT id FROM l)))
SELECT 'left' AS side, id FROM l UNION ALL SELECT 'right', id FROM r""")
def edge_check_reduce(spark, sf_dir):
    g = part_graph(spark, sf_dir)
    left, right = filters.reduce_edge(g, g.vertices.where("label = 0").select("id"), g.vertices.where("label = 1").select("id"))
    return left.select(F.lit("left").alias("side"), "id").union(right.select(F.lit("right").alias("side"), "id"))


@register("pull_frontier", f"{PART} SELECT DISTINCT dst AS id FROM e WHERE src_label = 0 AND dst_label IN (1, 2)")
def pull_frontier(spark, sf_dir):
    g, q = part_graph(spark, sf_dir), PATTERNS["sample_shape"]
    levels = planner.bfs_levels(q, 0)
    wanted = sorted({q.labels[u] for u in levels[1] if not filters.needs_no_row(q, levels, u)})
    return g.edges.where((F.col("src_label") == 0) & F.col("dst_label").isin(wanted)).select(F.col("dst").alias("id")).distinct()


@register("pull_elision", f"{PART} SELECT src AS id, count(*) AS n FROM e WHERE src_label = 2 AND dst_label = 3 GROUP BY src")
def pull_elision(spark, sf_dir):
    """Leaf neighbours are counted from edges alone; their vertices are never joined."""
    g, q = part_graph(spark, sf_dir), LEAFED
    levels = planner.bfs_levels(q, 0)
    leaf = next(u for u in levels[2] if filters.needs_no_row(q, levels, u))
    near = q.neighbours[leaf][0]
    return g.slice(q.labels[near], q.labels[leaf]).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))


@register("seed_spawn", f"""{WORK}, need AS (SELECT qe.a AS u, qv.label, count(*) AS n FROM qe JOIN qv ON qv.u = qe.b GROUP BY ALL),
have AS (SELECT src AS id, dst_label AS label, count(*) AS n FROM e GROUP BY ALL)
SELECT root.u AS query_id, count(v.id) AS seeds FROM root LEFT JOIN v ON v.label = root.label AND NOT EXISTS (SELECT 1 FROM need LEFT JOIN have ON have.id = v.id AND have.label = need.label WHERE need.u = root.u AND coalesce(have.n, 0) < need.n) GROUP BY root.u""")
def seed_spawn(spark, sf_dir):
    g = part_graph(spark, sf_dir)
    m = Matcher(g)
    roots = [m.plan(q).root for q in WORKLOAD]
    found = filters.classify(g, WORKLOAD).where(F.col("query_vertex").isin(roots)).groupBy("query_vertex").agg(F.count("*").alias("seeds"))
    every = spark.createDataFrame([(r,) for r in roots], "query_id int")
    return every.join(found, F.col("query_id") == F.col("query_vertex"), "left").select("query_id", F.coalesce("seeds", F.lit(0)).alias("seeds"))


@register("khop_task_subgraph", f"""{PART}, l0 AS (SELECT id FROM v WHERE label = 0), l1 AS (SELECT DISTINCT dst AS id FROM e WHERE src IN (SELECT id FROM l0) AND dst_label = 1),
l2 AS (SELECT DISTINCT dst AS id FROM e WHERE src IN (SELECT id FROM l1) AND dst_label = 2)
SELECT 0 AS level, count(*) AS n FROM l0 UNION ALL SELECT 1, count(*) FROM l1 UNION ALL SELECT 2, count(*) FROM l2""")
def khop_task_subgraph(spark, sf_dir):
    g = part_graph(spark, sf_dir)
    levels = growth.khop(g, g.vertices.where("label = 0"), [0, 1, 2])
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("level"), "n") for k, df in enumerate(levels)]
    return reduce(DataFrame.union, parts)


@register("intersect_k_lists", f"{PART} SELECT x.src AS a, x.dst AS b, count(*) AS n FROM e x JOIN e y ON y.src = x.src JOIN e z ON z.src = x.dst AND z.dst = y.dst WHERE x.src_label = 0 AND x.dst_label = 1 AND y.dst_label = 2 GROUP BY ALL")
def intersect_k_lists(spark, sf_dir):
    g = part_graph(spark, sf_dir)
    near = lambda label, c: g.slice(label, 2).toDF(c, "c")
    both = intersect_lists(g.slice(0, 1).toDF("a", "b"), [near(0, "a"), near(1, "b")], "c")
    return both.groupBy("a", "b").agg(F.count("*").alias("n"))


@register("contains_common", f"{PART} SELECT x.src AS a, x.dst AS b FROM e x WHERE x.src_label = 0 AND x.dst_label = 1 AND EXISTS (SELECT 1 FROM e y JOIN e z ON z.dst = y.dst WHERE y.src = x.src AND z.src = x.dst AND y.dst_label = 2)")
def contains_common(spark, sf_dir):
    g = part_graph(spark, sf_dir)
    return filters.with_common(g.slice(0, 1).toDF("a", "b"), g.slice(0, 2).toDF("a", "c"), g.slice(1, 2).toDF("b", "c"))


def _extended(q: QueryGraph, n: int) -> Query:
    def run(spark, sf_dir):
        g = part_graph(spark, sf_dir)
        labels = set(q.labels.values())
        steps = planner.order_steps(q, list(q.labels), g.frequencies(labels), g.pair_counts(labels))
        found = g.vertices.where(F.col("label") == q.labels[0]).select(F.col("id").alias("u0"))
        for s in steps[1:n]:
            found = extend(g, found, q, s)
        return found.select(*[name(u) for u in list(q.labels)[:n]])

    return run


register("extend_one_parent", f"{PART} SELECT src AS u0, dst AS u1 FROM e WHERE src_label = 0 AND dst_label = 1")(_extended(PATTERNS["triangle"], 2))
register("extend_injective", f"{PART} SELECT x.src AS u0, x.dst AS u1, y.dst AS u2 FROM e x JOIN e y ON y.src = x.src AND y.dst <> x.dst WHERE x.src_label = 7 AND x.dst_label = 6 AND y.dst_label = 6")(_extended(QueryGraph.of([7, 6, 6], (0, 1), (0, 2)), 3))
register("extend_multi_parent", match_sql(PATTERNS["triangle"], "{u0} AS u0, {u1} AS u1, {u2} AS u2"))(_extended(PATTERNS["triangle"], 3))


@register("embeddings_triangle", match_sql(PATTERNS["triangle_repeated_label"], "{u0} AS u0, {u1} AS u1, {u2} AS u2"))
def embeddings_triangle(spark, sf_dir):
    return Matcher(part_graph(spark, sf_dir)).embeddings(PATTERNS["triangle_repeated_label"])


@register("count_intersect_join", match_sql(PATTERNS["clique4"], "count(*) AS n_matches"))
def count_intersect_join(spark, sf_dir):
    return Matcher(part_graph(spark, sf_dir), MatchConfig(intersect=True)).count(PATTERNS["clique4"])


@register("count_single_vertex", f"{PART} SELECT count(*) AS n_matches FROM v WHERE label = 5")
def count_single_vertex(spark, sf_dir):
    return Matcher(part_graph(spark, sf_dir)).count(QueryGraph.of([5]))


@register("count_leaf_collapsed", match_sql(LEAFED, "count(*) AS n_matches"))
def count_leaf_collapsed(spark, sf_dir):
    return Matcher(part_graph(spark, sf_dir), MatchConfig(root_filter="label")).count(LEAFED)


@register("count_last_vertex", match_sql(LEAFED, "count(*) AS n_matches"))
def count_last_vertex(spark, sf_dir):
    return Matcher(part_graph(spark, sf_dir), MatchConfig(collapse=False)).count(LEAFED)


@register("unlabelled_triangle", f"{PART} SELECT count(*) AS n_matches FROM e x JOIN e y ON y.src = x.dst JOIN e z ON z.src = x.src AND z.dst = y.dst")
def unlabelled_triangle(spark, sf_dir):
    return Matcher(part_graph(spark, sf_dir, unlabelled=True), MatchConfig(root_filter="label")).count(QueryGraph.of([0, 0, 0], (0, 1), (1, 2), (0, 2)))


_STAR = planner.Group((), 0, (1, 2), ((1, 2),))


@register("common_star_matches", match_sql(PATTERNS["triangle"], "{u0} AS root, {u1} AS leaf_1, {u2} AS leaf_2"))
def common_star_matches(spark, sf_dir):
    return multi.star_matches(part_graph(spark, sf_dir), _STAR).select("root", "leaf_1", "leaf_2")


@register("common_star_size_estimate", f"{PART} SELECT CAST(sum(a * b) AS DOUBLE) AS n FROM (SELECT src, count(*) FILTER (dst_label = 1) a, count(*) FILTER (dst_label = 2) b FROM e WHERE src_label = 0 GROUP BY src)")
def common_star_size_estimate(spark, sf_dir):
    return multi.star_size(part_graph(spark, sf_dir), 0, (1, 2))


def _workload_sql(of: list[int]) -> str:
    parts = []
    for i in of:
        q = WORKLOAD[i]
        if len(q.labels) == 1:
            body = f"SELECT {i} AS query, (SELECT count(*) FROM v WHERE label = {next(iter(q.labels.values()))}) AS n_matches"
        else:
            body = f"SELECT {i} AS query, (SELECT n_matches FROM ({match_sql(q, 'count(*) AS n_matches', '')})) AS n_matches"
        parts.append(body)
    return f"{WORK}, n AS ({' UNION ALL '.join(parts)}) SELECT root.u AS query_id, n_matches FROM n JOIN root USING (query)"


def _counted(of: list[int], **config) -> Query:
    def run(spark, sf_dir):
        return Matcher(part_graph(spark, sf_dir), MatchConfig(**config)).count_workload([WORKLOAD[i] for i in of])

    return run


register("multi_query_counts", _workload_sql([0, 1, 2, 3]))(_counted([0, 1, 2, 3], share=False, root_filter="label"))
register("multi_query_shared_counts", _workload_sql([0, 1, 2, 3]))(_counted([0, 1, 2, 3], exact_groups=False, root_filter="label"))
register("multi_query_zero_fill", _workload_sql([3, 4, 5]))(_counted([3, 4, 5]))
register("multi_query_filtered_roots", _workload_sql([0, 1, 2, 3]))(_counted([0, 1, 2, 3], exact_groups=False))
register("multi_query_grown_candidates", _workload_sql([0, 2]))(_counted([0, 2], grow="neighbours"))
register("multi_query_size_gate", _workload_sql([0, 1, 2]))(_counted([0, 1, 2], exact_groups=False, share_limit=0))


_TAILED = PATTERNS["tailed_triangle"]
_NLF = lambda name, label, need, extra="": f"{name} AS (SELECT id FROM v WHERE label = {label} AND id IN (SELECT src FROM e GROUP BY src HAVING " + " AND ".join(f"count(*) FILTER (dst_label = {x}) >= {n}" for x, n in need.items()) + f"){extra})"
_BY = lambda near: f" AND id IN (SELECT dst FROM e WHERE src IN (SELECT id FROM {near}))"
_GROWN = f"""{PART}, {_NLF("c0", 0, {1: 1, 2: 1})}, {_NLF("c1", 1, {0: 1, 2: 1}, _BY("c0"))}, {_NLF("c2", 2, {0: 1, 1: 2}, _BY("c0"))},
r1 AS (SELECT id FROM c1 WHERE TRUE{_BY("c2")}), r2 AS (SELECT id FROM c2 WHERE TRUE{_BY("r1")}), {_NLF("c3", 1, {2: 1}, _BY("r2"))}"""


@register("candidate_growth", f"{_GROWN} SELECT 0 AS u, id FROM c0 UNION ALL SELECT 1, id FROM r1 UNION ALL SELECT 2, id FROM r2 UNION ALL SELECT 3, id FROM c3")
def candidate_growth(spark, sf_dir):
    """Level-synchronous growth with filters and pruning inside a level."""
    found = growth.grow(part_graph(spark, sf_dir), planner.make_plan(_TAILED, {}, root=0))
    return reduce(DataFrame.union, [df.select(F.lit(u).alias("u"), "id") for u, df in found.items()])


@register("query_elimination", f"""{_GROWN}, h AS (SELECT id FROM v WHERE label = 3 AND id IN (SELECT src FROM e GROUP BY src HAVING count(*) FILTER (dst_label = 9) >= 1))
SELECT 'tailed' AS query, NOT (EXISTS (FROM c0) AND EXISTS (FROM r1) AND EXISTS (FROM r2) AND EXISTS (FROM c3)) AS eliminated UNION ALL SELECT 'hopeless', NOT EXISTS (FROM h)""")
def query_elimination(spark, sf_dir):
    """Queries that a level without candidates rules out."""
    g = part_graph(spark, sf_dir)
    work = {"tailed": (_TAILED, 0), "hopeless": (QueryGraph.of([3, 9], (0, 1)), 0)}
    rows = [(k, growth.eliminated(growth.grow(g, planner.make_plan(q, {}, root=r)))) for k, (q, r) in work.items()]
    return spark.createDataFrame(rows, "query string, eliminated boolean")


register("count_grown_candidates", match_sql(_TAILED, "count(*) AS n_matches"))(
    lambda spark, sf_dir: Matcher(part_graph(spark, sf_dir), MatchConfig(grow="neighbours")).count(_TAILED)
)


@register("partial_final_aggregate", f"{PART} SELECT src_label AS query_id, count(*) AS n_matches FROM e WHERE src_label < dst_label GROUP BY 1")
def partial_final_aggregate(spark, sf_dir):
    e = part_graph(spark, sf_dir).edges.where("src_label < dst_label").select(F.col("src_label").alias("query_id"), "src")
    return aggregate.two_phase(e, ["query_id"], {"n": F.count("*")}, {"n_matches": F.sum("n")}, ["src"])


@register("aggregate_distinct_neighbours", f"{PART} SELECT src_label, count(DISTINCT dst) AS n_dst, CAST(max(dst) AS BIGINT) AS last FROM e GROUP BY 1")
def aggregate_distinct_neighbours(spark, sf_dir):
    """An aggregate that is not combined before the shuffle: distinct ends by label, dealt out by the end."""
    e = part_graph(spark, sf_dir).edges
    return aggregate.two_phase(e, ["src_label"], {"n": F.countDistinct("dst"), "last": F.max("dst")}, {"n_dst": F.sum("n"), "last": F.max("last")}, ["dst"])


@register("root_selection_cost", f"{WORK} SELECT query, cost.u, cost.cost, cost.u = root.u AS is_root FROM cost JOIN root USING (query)")
def root_selection_cost(spark, sf_dir):
    g = part_graph(spark, sf_dir)
    frequency = g.frequencies({x for q in WORKLOAD for x in q.labels.values()})
    rows = [(i, u, c, u == planner.choose_root(q, frequency)) for i, q in enumerate(WORKLOAD) for u, c in planner.root_costs(q, frequency).items()]
    return spark.createDataFrame(rows, "query int, u int, cost double, is_root boolean")


_BFS = f"{WORK}, w(query, u, level) AS (SELECT query, u, 0 FROM root UNION SELECT w.query, qe.b, level + 1 FROM w JOIN qe ON qe.a = w.u WHERE level < 8), lv AS (SELECT query, u, min(level) AS level FROM w GROUP BY ALL)"


def _plans(spark, sf_dir) -> list[planner.Plan]:
    m = Matcher(part_graph(spark, sf_dir))
    return [m.plan(q) for q in WORKLOAD]


@register("bfs_levels", f"{_BFS} SELECT query, u, level FROM lv")
def bfs_levels(spark, sf_dir):
    rows = [(i, u, k) for i, p in enumerate(_plans(spark, sf_dir)) for k, level in enumerate(p.levels) for u in level]
    return spark.createDataFrame(rows, "query int, u int, level int")


@register("plan_roles", f"{_BFS} SELECT a.query, a.u, count(*) FILTER (b.level = a.level - 1) AS parents, count(*) FILTER (b.level = a.level) AS partners, count(*) FILTER (b.level = a.level + 1) AS children FROM lv a LEFT JOIN qe ON qe.a = a.u LEFT JOIN lv b ON b.u = qe.b GROUP BY ALL")
def plan_roles(spark, sf_dir):
    rows = [(i, u, *[len(r[k]) for k in ("parents", "partners", "children")]) for i, p in enumerate(_plans(spark, sf_dir)) for u, r in planner.roles(p.query, p.root).items()]
    return spark.createDataFrame(rows, "query int, u int, parents bigint, partners bigint, children bigint")


@register("linear_order", f"""{_BFS}, p AS (SELECT query, u, row_number() OVER (PARTITION BY query ORDER BY level, u) - 1 AS pos FROM lv)
SELECT p.query, p.u, p.pos, CAST((SELECT count(*) FROM qe JOIN p b ON b.u = qe.b WHERE qe.a = p.u AND b.pos < p.pos) AS BIGINT) AS earlier,
CAST((SELECT count(*) FROM p b JOIN qv x ON x.u = b.u JOIN qv y ON y.u = p.u WHERE b.query = p.query AND b.pos < p.pos AND x.label = y.label AND NOT EXISTS (SELECT 1 FROM qe WHERE qe.a = p.u AND qe.b = b.u)) AS BIGINT) AS same_label FROM p""")
def linear_order(spark, sf_dir):
    """Positions of the flattened levels: earlier neighbours and earlier vertices of the same label to differ from."""
    rows = []
    for i, p in enumerate(_plans(spark, sf_dir)):
        for pos, s in enumerate(planner.order_steps(p.query, [u for level in p.levels for u in sorted(level)])):
            rows.append((i, s.vertex, pos, (s.via is not None) + len(s.closing), len(s.differs)))
    return spark.createDataFrame(rows, "query int, u int, pos bigint, earlier bigint, same_label bigint")


@register("query_grouping", f"""{_BFS}, k AS (SELECT root.query, root.label AS root_label, coalesce((SELECT string_agg(DISTINCT CAST(qv.label AS VARCHAR), ',' ORDER BY CAST(qv.label AS VARCHAR)) FROM lv JOIN qv ON qv.u = lv.u WHERE lv.query = root.query AND lv.level = 1), '') AS near,
EXISTS (SELECT 1 FROM qe JOIN lv a ON a.u = qe.a JOIN lv b ON b.u = qe.b WHERE a.query = root.query AND a.level = 1 AND b.level = 1) AS inside FROM root)
SELECT root_label, near, inside, count(*) AS n_queries FROM k GROUP BY ALL""")
def query_grouping(spark, sf_dir):
    keys = [planner.grouping_key(p) for p in _plans(spark, sf_dir)]
    rows = [(a, ",".join(sorted(map(str, b))), c) for a, b, c in keys]
    return spark.createDataFrame(rows, "root_label int, near string, inside boolean").groupBy("root_label", "near", "inside").agg(F.count("*").alias("n_queries"))


_FIXED = [(WORKLOAD[0], 10), (WORKLOAD[1], 20), (WORKLOAD[2], 30)]


def _rooted() -> list[planner.Plan]:
    return [planner.make_plan(q, {}, root=r) for q, r in _FIXED]


_NEAR = f"q(query, root) AS (VALUES (0, 10), (1, 20), (2, 30)), qv(query, nth, u, label, degree) AS (VALUES {_QV}), qe(query, a, b) AS (VALUES {_QE}), l1 AS (SELECT q.query, qe.b AS u, qv.label FROM q JOIN qe ON qe.a = q.root JOIN qv ON qv.u = qe.b)"


@register("common_labels", f"WITH {_NEAR} SELECT label FROM l1 GROUP BY label HAVING count(DISTINCT query) = 3")
def common_labels(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in planner.common_labels(_rooted())], "label int")


@register("common_nontree_edges", f"WITH {_NEAR} SELECT x.label AS a, y.label AS b FROM l1 x JOIN l1 y ON x.query = y.query AND x.label < y.label JOIN qe ON qe.a = x.u AND qe.b = y.u WHERE x.query IN (0, 2) GROUP BY ALL HAVING count(DISTINCT x.query) = 2")
def common_nontree_edges(spark, sf_dir):
    plans = _rooted()
    group = next(g for g in planner.group_queries([plans[0], plans[2]]) if len(g.plans) == 2)
    return spark.createDataFrame(list(group.star_edges), "a int, b int")


@register("workload_tables", f"WITH qv(query, nth, u, label, degree) AS (VALUES {_QV}), qe(query, a, b) AS (VALUES {_QE}) SELECT 'vertex' AS kind, query, u, label AS x FROM qv UNION ALL SELECT 'edge', query, a, b FROM qe WHERE a < b")
def workload_rows(spark, sf_dir):
    v, e = workload_tables(spark, WORKLOAD)
    return v.select(F.lit("vertex").alias("kind"), "query", "u", F.col("label").alias("x")).union(e.select(F.lit("edge"), "query", "u", F.col("w")))


@register("text_graph_round_trip", f"{PART} SELECT src_label, dst_label, count(*) AS n, 'filled' AS state, 'refused' AS second FROM e GROUP BY ALL")
def text_graph_round_trip(spark, sf_dir):
    """The graph written as adjacency lines, with the paths checked, and scanned again."""
    path = f"{checkpoint_dir(spark)}/motifline-{spark.sparkContext.applicationId}/lines-{uuid.uuid4().hex}"
    g = part_graph(spark, sf_dir)
    text.write_graph(g, path)
    try:
        text.check_paths(spark, [path], path)
        second = "allowed"
    except GraphError:
        second = "refused"
    again = text.read_graph(spark, path)
    counts = again.edges.groupBy("src_label", "dst_label").agg(F.count("*").alias("n"))
    return counts.withColumn("state", F.lit(text.path_state(spark, path))).withColumn("second", F.lit(second))


@register("text_workload_round_trip", f"WITH qv(query, nth, u, label, degree) AS (VALUES {_QV}), qe(query, a, b) AS (VALUES {_QE}) SELECT 'vertex' AS kind, query, u, label AS x FROM qv UNION ALL SELECT 'edge', query, a, b FROM qe WHERE a < b")
def text_workload_round_trip(spark, sf_dir):
    """The workload written as one text file and scanned again."""
    path = f"{checkpoint_dir(spark)}/motifline-{spark.sparkContext.applicationId}/workload-{uuid.uuid4().hex}"
    spark.createDataFrame([(text.workload_text(WORKLOAD),)], "value string").coalesce(1).write.text(path)
    v, e = workload_tables(spark, text.read_workload(spark, path))
    return v.select(F.lit("vertex").alias("kind"), "query", "u", F.col("label").alias("x")).union(e.select(F.lit("edge"), "query", "u", F.col("w")))


@register("result_report", f"{PART} SELECT 'the number of matching results for query0 is ' || count(*) AS line FROM e WHERE src_label = 0 AND dst_label = 1")
def result_report(spark, sf_dir):
    counts = Matcher(part_graph(spark, sf_dir), MatchConfig(root_filter="label")).count(PATTERNS["edge"])
    return text.format_results(counts.select(F.lit(0).alias("query_id"), "n_matches"))


def _hash_sql(j: int, x: str) -> str:
    wrap = lambda s: f"((({s}) + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648"
    return f"({wrap(f'({wrap(x)}) * CAST({lsh.A[j]} AS BIGINT) + {lsh.B[j]}')}) % 2147483647"


_SIG = "sig AS (SELECT src AS id, " + ", ".join(f"min({_hash_sql(j, 'dst')}) AS s{j}" for j in range(5)) + " FROM e GROUP BY src)"


@register("minhash_signature", f"{PART}, {_SIG} SELECT id, s0, s1, s2, s3, s4 FROM sig")
def minhash_signature(spark, sf_dir):
    sig = partition.neighbour_signature(part_graph(spark, sf_dir))
    return sig.select("id", *[F.col("sig")[j].alias(f"s{j}") for j in range(5)])


@register("minhash_hash", f"{PART}, {_SIG} SELECT id, least(" + ", ".join(f"CASE WHEN s{j} >= 0 THEN s{j} ELSE 2147483647 END" for j in range(5)) + ") AS h FROM sig")
def minhash_hash(spark, sf_dir):
    return partition.neighbour_signature(part_graph(spark, sf_dir)).select("id", lsh.signature_hash(F.col("sig")).alias("h"))


_MINHASH = f"m AS (SELECT src AS id, dst_label, min({_hash_sql(0, 'dst')}) AS h FROM e GROUP BY ALL), x AS (SELECT id, ((h * 31 + (CAST(dst_label AS BIGINT) + 1) * 1000003) % 2147483647 + 2147483647) % 2147483647 AS t FROM m), p AS (SELECT id, CAST(sum(t * t % 2147483647) AS BIGINT) AS minhash FROM x GROUP BY id)"


@register("labeled_minhash", f"{PART}, {_MINHASH} SELECT id, minhash FROM p")
def labeled_minhash(spark, sf_dir):
    return partition.labelled_minhash(part_graph(spark, sf_dir))


@register("lsh_bucket", f"{PART}, {_SIG}, s1 AS (SELECT id, s0, xor(CAST(1 AS BIGINT), ((s0 + 2654435769) % 4294967296 + 4294967296) % 4294967296 + 64) % 1013 AS bucket FROM sig) SELECT id, bucket FROM s1")
def lsh_bucket(spark, sf_dir):
    return partition.seed_buckets(part_graph(spark, sf_dir), 1)


@register("seed_merge_groups", f"{PART}, {_SIG}, s1 AS (SELECT id, xor(CAST(1 AS BIGINT), ((s0 + 2654435769) % 4294967296 + 4294967296) % 4294967296 + 64) % 1013 AS bucket FROM sig) SELECT bucket, count(*) AS seeds FROM s1 JOIN v USING (id) WHERE label = 0 GROUP BY bucket")
def seed_merge_groups(spark, sf_dir):
    g = part_graph(spark, sf_dir)
    seeds = g.vertices.where("label = 0").select("id")
    return partition.seed_buckets(g, 1).join(seeds, "id", "left_semi").groupBy("bucket").agg(F.count("*").alias("seeds"))


def _sizes(edges: DataFrame) -> DataFrame:
    """Edges by part, and how many of them lie in the partition of that number."""
    return edges.withColumn("at", F.spark_partition_id()).groupBy("part").agg(F.count("*").alias("n"), F.count_if(F.col("at") == F.col("part")).alias("n_placed"))


@register("hash_partition_sizes", f"{PART} SELECT CAST(abs(src) % 16 AS INT) AS part, count(*) AS n, count(*) AS n_placed FROM e GROUP BY 1")
def hash_partition_sizes(spark, sf_dir):
    return _sizes(partition.layout(part_graph(spark, sf_dir), 16))


@register("lsh_partition_sizes", f"{PART}, {_MINHASH} SELECT CAST(minhash % 16 AS INT) AS part, count(*) AS n, count(*) AS n_placed FROM e JOIN p ON p.id = e.src GROUP BY 1")
def lsh_partition_sizes(spark, sf_dir):
    return _sizes(partition.layout(part_graph(spark, sf_dir), 16, "lsh"))
