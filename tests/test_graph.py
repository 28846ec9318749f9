import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from motifline import catalog, run, session
from motifline.functions import lsh
from motifline.operators import aggregate, growth, partition
from motifline.operators.graph import GraphError, LabeledGraph
from motifline.operators.match import MatchConfig, Matcher
from motifline.plans import planner
from motifline.plans.pattern import PatternError, QueryGraph, parse_workload
from motifline.sources import tables, text
from motifline.streaming import progress

# The sample graph and query.
SAMPLE = """0 0\t1 2 3 2 4 1
1 2\t0 0 2 1 4 1
2 1\t1 2 3 2 4 1 12 3
3 2\t0 0 2 1 4 1 8 1
4 1\t0 0 1 2 2 1 3 2
5 3\t6 0 8 1 9 3
6 0\t5 3 7 3 9 3 10 0
7 3\t6 0 8 1 9 3
8 1\t3 2 5 3 7 3 9 3
9 3\t5 3 6 0 7 3 8 1
10 0\t6 0 11 1 13 1 14 2
11 1\t10 0 12 3 14 2
12 3\t2 1 11 1 13 1 14 2
13 1\t10 0 12 3 14 2
14 2\t10 0 11 1 12 3 13 1
"""
QUERY = "0 0\t1 2 2 1\n1 2\t0 0 2 1 3 1\n2 1\t0 0 1 2\n3 1\t1 2 4 3\n4 3\t3 1\n"


@pytest.fixture(scope="module")
def sample(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("graph") / "g.txt"
    path.write_text(SAMPLE)
    return text.read_graph(spark, str(path)).persisted()


def brute(labels, edges, query, semantics="iso"):
    near, us = set(edges) | {(b, a) for a, b in edges}, list(query.labels)
    pools = [[v for v, x in labels.items() if x == query.labels[u]] for u in us]
    n = 0
    for choice in itertools.product(*pools):
        f = dict(zip(us, choice))
        if semantics != "homo" and len(set(choice)) < len(choice):
            continue
        if all((f[a], f[b]) in near for a, b in query.edges):
            others = ((a, b) for a, b in itertools.combinations(us, 2) if (min(a, b), max(a, b)) not in query.edges)
            n += semantics != "induced" or not any((f[a], f[b]) in near for a, b in others)
    return n


def test_sample_query(sample):
    (query,) = parse_workload(QUERY)
    rows = {tuple(r) for r in Matcher(sample).embeddings(query).collect()}
    assert rows == {(0, 1, 4, 2, 12), (0, 3, 4, 2, 12), (0, 3, 4, 8, 5), (0, 3, 4, 8, 7), (0, 3, 4, 8, 9), (10, 14, 11, 13, 12), (10, 14, 13, 11, 12)}
    counts = Matcher(sample).count_workload([query])
    assert [tuple(r) for r in counts.collect()] == [(1, 7)]
    assert text.format_results(counts).first()["line"].endswith("query1 is 7")
    for semantics, n in (("homo", 9), ("induced", 3)):
        assert Matcher(sample, MatchConfig(semantics=semantics)).count(query).first()[0] == n


@pytest.mark.parametrize(
    "labels, edges, n",
    [
        ([2, 1], [(0, 1)], 7),
        ([0, 2, 1], [(0, 1), (1, 2), (0, 2)], 4),
        ([2, 1, 1], [(0, 1), (1, 2), (0, 2)], 4),
        ([0, 3, 3], [(0, 1), (1, 2), (0, 2)], 4),
        ([2, 1, 1, 0], [(0, 1), (0, 2), (0, 3)], 10),
        ([3, 1, 2, 1], [(0, 1), (1, 2), (2, 3)], 11),
        ([2, 1, 3, 1], [(0, 1), (1, 2), (2, 3), (0, 3)], 2),
        ([9, 1], [(0, 1)], 0),
        ([3, 3], [(0, 1)], 4),
        ([0, 1, 1, 2], list(itertools.combinations(range(4), 2)), 0),
    ],
)
def test_small_patterns(sample, labels, edges, n):
    assert Matcher(sample).count(QueryGraph.of(labels, *edges)).first()[0] == n


def test_random_graphs_agree_with_brute_force_under_all_switches(spark):
    rng = random.Random(3)
    labels = {i: rng.randrange(3) for i in range(14)}
    edges = [(a, b) for a, b in itertools.combinations(range(14), 2) if rng.random() < 0.4]
    v = spark.createDataFrame(list(labels.items()), "id bigint, label int")
    g = LabeledGraph.from_tables(v, spark.createDataFrame(edges, "src bigint, dst bigint")).persisted()
    query = QueryGraph.of([0, 1, 1, 2], (0, 1), (1, 2), (0, 2), (2, 3))
    want = brute(labels, edges, query)
    for config in (MatchConfig(), MatchConfig(collapse=False), MatchConfig(intersect=True), MatchConfig(root_filter="label"), MatchConfig(grow="label", prune=False), MatchConfig(grow="neighbours")):
        assert Matcher(g, config).count(query).first()[0] == want
    work = [QueryGraph.of({10: 0, 11: 1, 12: 2}, (10, 11), (10, 12), (11, 12)), QueryGraph.of({20: 0, 21: 1, 22: 2, 23: 1}, (20, 21), (20, 22), (22, 23)), QueryGraph.of({30: 7, 31: 1}, (30, 31))]
    wanted = sorted(brute(labels, edges, q) for q in work)
    for config in (MatchConfig(), MatchConfig(share=False), MatchConfig(exact_groups=False), MatchConfig(root_filter="label"), MatchConfig(grow="degree"), MatchConfig(share_limit=0)):
        assert sorted(r["n_matches"] for r in Matcher(g, config).count_workload(work).collect()) == wanted


def test_workload_text():
    crlf = parse_workload(QUERY.replace("\n", "\r\n") + "\r\n\r\n\r\n5 1\t6 2\r\n6 2\t5 1\r\n")
    assert [len(q.labels) for q in crlf] == [5, 2] and crlf[0] == parse_workload(QUERY)[0]
    for bad in ("0 0 1", "0 x", "0 0\t1 1\n1 1\t0 0\n\n0 0", "0 0\n1 1"):
        with pytest.raises(PatternError):
            parse_workload(bad)


def test_bad_lines_and_round_trip(spark, tmp_path, sample):
    (tmp_path / "bad.txt").write_text("0 0\t1 1\n1 1\t0 0\nx 1\n2 2\t3\n")
    with pytest.raises(GraphError):
        text.read_graph(spark, str(tmp_path / "bad.txt"))
    assert text.read_graph(spark, str(tmp_path / "bad.txt"), bad_rows="drop").vertices.count() == 2
    text.write_graph(sample, str(tmp_path / "out"))
    again = text.read_graph(spark, str(tmp_path / "out"))
    assert again.edges.exceptAll(sample.edges).count() == 0 and again.edges.count() == 54
    assert sample.validate().count() == 0
    broken = LabeledGraph(sample.vertices.where("id <> 14"), sample.edges)
    assert {r["problem"] for r in broken.validate().collect()} == {"missing neighbour"}


def test_plan_of_the_sample(sample):
    (query,) = parse_workload(QUERY)
    plan = Matcher(sample).plan(query)
    assert plan.root == 1 and plan.levels == ((1,), (0, 2, 3), (4,))
    assert plan.leaves == ((4, 3),)
    assert planner.roles(query, 1)[2] == {"parents": (1,), "partners": (0,), "children": ()}


def test_minhash_values():
    assert lsh.signature_of([0, 1, 1], 5) == (-1957043958, 14444113, -1857856565, -1589448510, -1632737572)
    assert lsh.signature_of([], 1) == (2147483647,)
    for items, one, five in (([0, 1, 1], 128, 773), ([8, 5, 1], 128, 989), ([5], 898, 935), ([0, 2, 4], 896, 921), ([2, 3], 134, 307), ([], 387, 766)):
        assert lsh.bucket_of(lsh.signature_of(items, 1)) == one
        assert lsh.bucket_of(lsh.signature_of(items, 5)) == five


def test_minhash_columns_agree(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([0, 1, 1],), ([8, 5, 1],), ([],)], "x array<bigint>").withColumn("s", lsh.signature(F.col("x"), 5))
    for r in df.select("x", "s", lsh.bucket(F.col("s")).alias("b")).collect():
        assert tuple(r["s"]) == lsh.signature_of(r["x"], 5) and r["b"] == lsh.bucket_of(tuple(r["s"]))


@pytest.fixture()
def small_part_graph(spark, monkeypatch):
    """Labels and neighbours of a random graph, which the registered queries read in place of the tables."""
    rng = random.Random(12)
    labels = {i: rng.randrange(3) for i in range(1, 61)}
    edges = [(a, b) for a, b in itertools.combinations(labels, 2) if rng.random() < 0.03]
    v = spark.createDataFrame(list(labels.items()), "id bigint, label int")
    g = LabeledGraph.from_tables(v, spark.createDataFrame(edges, "src bigint, dst bigint"))
    monkeypatch.setattr(catalog, "part_graph", lambda spark, sf_dir: g)
    near = {i: {b for a, b in edges if a == i} | {a for a, b in edges if b == i} for i in labels}
    return labels, near


def test_khop_starts_from_all_vertices(spark, small_part_graph):
    labels, near = small_part_graph
    level = {i for i, x in labels.items() if x == 0}
    want = [(0, len(level))]
    for k in (1, 2):
        level = {b for a in level for b in near[a] if labels[b] == k}
        want.append((k, len(level)))
    assert sorted(tuple(r) for r in catalog.queries()["khop_task_subgraph"](spark, "").collect()) == want


def test_edge_check_takes_all_candidates(spark, small_part_graph):
    labels, near = small_part_graph
    left = {i for i, x in labels.items() if x == 0 and any(labels[b] == 1 for b in near[i])}
    right = {i for i, x in labels.items() if x == 1 and near[i] & left}
    got = {tuple(r) for r in catalog.queries()["edge_check_reduce"](spark, "").collect()}
    assert got == {("left", i) for i in left} | {("right", i) for i in right}


def test_joins_go_through_the_least_fan_out():
    # order 5, part 4, supplier 3: a supplier has many parts and orders, an order few parts and suppliers
    query = QueryGraph.of([5, 4, 3], (0, 1), (1, 2), (0, 2))
    frequency = {3: 10, 4: 200, 5: 1500}
    pairs = {(3, 4): 800, (4, 3): 800, (3, 5): 6000, (5, 3): 6000, (4, 5): 6000, (5, 4): 6000}
    plan = planner.make_plan(query, frequency, pairs=pairs)
    last = plan.steps[-1]
    assert plan.root == 2 and [s.vertex for s in plan.steps] == [2, 1, 0]
    assert (last.via, last.closing) == (1, (2,)) and planner.fan_out(query, frequency, pairs, 1, 0) < planner.fan_out(query, frequency, pairs, 2, 0)
    few = pairs | {(5, 4): 150, (4, 5): 150, (3, 5): 500, (5, 3): 500}
    plan = planner.make_plan(query, frequency, pairs=few)
    assert [s.vertex for s in plan.steps] == [2, 0, 1] and plan.steps[-1].via == 0


def test_switches_change_plans(sample):
    (query,) = parse_workload(QUERY)
    plain, filtered, grown = (Matcher(sample, MatchConfig(root_filter=f, grow=g)).count_workload([query]) for f, g in (("label", ""), ("neighbours", ""), ("", "neighbours")))
    texts = [x._jdf.queryExecution().optimizedPlan().toString() for x in (plain, filtered, grown)]
    assert len(set(texts)) == 3
    assert all([tuple(r) for r in x.collect()] == [(1, 7)] for x in (plain, filtered, grown))


def test_growth_and_elimination(sample):
    (query,) = parse_workload(QUERY)
    found = growth.grow(sample, Matcher(sample).plan(query))
    got = {u: {r["id"] for r in df.collect()} for u, df in found.items()}
    listed = [dict(zip(query.labels, r)) for r in Matcher(sample).embeddings(query).collect()]
    assert all(m[u] in got[u] for m in listed for u in query.labels)
    labels = dict((int(x.split()[0]), int(x.split()[1])) for x in SAMPLE.splitlines())
    assert all(labels[i] == query.labels[u] for u, ids in got.items() for i in ids) and not growth.eliminated(found)
    none = QueryGraph.of({0: 0, 1: 9, 2: 1}, (0, 1), (1, 2))
    found = growth.grow(sample, planner.make_plan(none, {}, root=0))
    assert growth.eliminated(found) and found[2].count() == 0
    assert {r["u"]: r["n"] for r in growth.sizes(found).collect()}[1] == 0
    assert Matcher(sample, MatchConfig(grow="label")).count(none).first()[0] == 0


def test_runner_and_paths(spark, tmp_path, capsys):
    (tmp_path / "g.txt").write_text(SAMPLE)
    (tmp_path / "q.txt").write_text(QUERY + "\n20 2\t21 1\n21 1\t20 2\n")
    data, query, out = (str(tmp_path / x) for x in ("g.txt", "q.txt", "out"))
    report = run.run(spark, data, query, out)
    assert [x.rsplit("query", 1)[1] for x in report.lines] == ["1 is 7", "20 is 7"] and report.load_seconds > 0 < report.task_seconds
    assert sorted(r["value"] for r in spark.read.text(out).collect()) == sorted(report.lines)
    with pytest.raises(GraphError):
        run.run(spark, data, query, out)
    with pytest.raises(GraphError):
        run.run(spark, str(tmp_path / "none"), query)
    assert [text.path_state(spark, str(tmp_path / x)) for x in ("none", "g.txt")] == ["missing", "filled"]
    text.check_paths(spark, [data], out, overwrite=True)


def test_workload_text_round_trip():
    work = parse_workload(QUERY + "\n7 1\n\n8 1\t9 2\n9 2\t8 1\n")
    assert parse_workload(text.workload_text(work)) == work


def test_graphs_are_loaded_once_and_anew_if_their_files_change(spark, tmp_path):
    def write(n):
        spark.range(n).selectExpr("id AS p_partkey", "id AS p_size").write.mode("overwrite").parquet(str(tmp_path / "part.parquet"))
        spark.range(2 * n).selectExpr("id DIV 4 AS l_orderkey", "id % 7 AS l_partkey").write.mode("overwrite").parquet(str(tmp_path / "lineitem.parquet"))

    write(10)
    first = tables.part_graph(spark, str(tmp_path))
    assert tables.part_graph(spark, str(tmp_path)) is first and first.vertices.count() == 10
    assert first.validate().count() == 0
    write(30)
    again = tables.part_graph(spark, str(tmp_path))
    assert again is not first and again.vertices.count() == 30


def test_layouts(sample):
    from pyspark.sql import functions as F

    for by in ("hash", "lsh"):
        rows = partition.layout(sample, 4, by).withColumn("at", F.spark_partition_id()).collect()
        assert len(rows) == 54 and all(r["at"] == r["part"] for r in rows)
        assert all(len({r["part"] for r in rows if r["src"] == v}) == 1 for v in range(15))
    near = {i: frozenset(x.split("\t")[1].split()) for i, x in enumerate(SAMPLE.splitlines())}
    got = {r["id"]: r["minhash"] for r in partition.labelled_minhash(sample).collect()}
    assert all(got[a] == got[b] for a in near for b in near if near[a] == near[b]) and len(set(got.values())) > 5


def test_progress_is_reported_while_a_job_runs(spark):
    seen = []
    with progress.Progress(spark, seen.append, gap=0.05):
        spark.range(4_000_000, numPartitions=8).selectExpr("sum(sqrt(id))").collect()
        spark.range(50, numPartitions=2).rdd.map(lambda x: __import__("time").sleep(0.03)).count()
    assert "seconds" in seen[-1] and all({"tasks", "active", "done"} <= set(s) for s in seen)
    assert any(s["tasks"] for s in seen[:-1])


def test_two_phase_equals_one_phase(spark):
    from pyspark.sql import functions as F

    df = spark.range(1000).selectExpr("id % 3 AS k", "id % 37 AS x")
    got = aggregate.two_phase(df, ["k"], {"n": F.countDistinct("x"), "m": F.max("x")}, {"n": F.sum("n"), "m": F.max("m")}, ["x"]).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, df.groupBy("k").agg(F.countDistinct("x"), F.max("x")).collect()))


def test_triangles_of_one_label_by_blocks(spark):
    """Equal to brute force at any number of blocks, with a hub, ids of one residue and negative ones."""
    import itertools
    import random

    from motifline.operators import triangles

    g = random.Random(3)
    ids = [(i - 20) * 1_000_000_007 for i in range(60)]
    pairs = {tuple(sorted(g.sample(ids, 2))) for _ in range(500)} | {(ids[0], x) for x in ids[1:]}
    near = {x: {b if a == x else a for a, b in pairs if x in (a, b)} for x in ids}
    expected = 6 * sum(b in near[a] and c in near[a] and c in near[b] for a, b, c in itertools.combinations(ids, 3))
    vertices = spark.createDataFrame([(x, 5) for x in ids] + [(1, 6)], "id long, label int")
    graph = LabeledGraph.from_tables(vertices, spark.createDataFrame([*pairs, (1, ids[0])], "src long, dst long")).persisted()
    for block in (1000, 120, 20):
        assert triangles.count_triangles(graph, 5, block).first()[0] == expected
    assert triangles.count_triangles(graph, 6).first()[0] == 0
    query = QueryGraph.of([5, 5, 5], (0, 1), (1, 2), (0, 2))
    assert Matcher(graph).embeddings(query).count() == expected
    counted = Matcher(graph).count(query)
    assert "left_semi" not in counted._jdf.queryExecution().logical().toString().lower().replace("leftsemi", "left_semi")  # no partial match is closed
    assert counted.first()[0] == expected


def test_few_rows_are_written_to_few_files_and_no_others(spark):
    """Each file of a local folder costs its executor a process, or two with a checksum file."""
    rows = spark.range(2_000).withColumn("k", F.col("id") % 7).repartition(64)
    for n, files in ((None, 64), (2_000, session.LEAST_TASKS), (20 * session.TASK_ROWS, 20)):
        table = session.materialize(rows, "few", n)
        written = os.listdir(table._motifline_path)
        assert len(written) == files and all(x.startswith("part-") and x.endswith(".parquet") for x in written)
        assert table.agg(F.count("*"), F.sum("id")).first() == (2_000, 1_999_000)
        session.discard(table)
