"""Adjacency-list text to graphs, workload text to query graphs, and result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifline.operators.graph import GraphError, LabeledGraph
from motifline.plans.pattern import QueryGraph, parse_workload


def parse_lines(lines: DataFrame, label_type: str = "int", unlabelled: bool = False) -> DataFrame:
    """(value) lines ``id label<TAB>neighbour label ...`` -> (value, id, label, adj, good), adj sorted by id.

    label_type "char" takes the code of the first character as label.
    """
    token = F.filter(F.split("value", r"[ \t\r]+"), lambda t: t != "")
    parts = lines.select("value", token.alias("t")).where(F.size("t") > 0)

    def label(text):
        return F.lit(0) if unlabelled else F.ascii(text) if label_type == "char" else text.try_cast("int")

    # every second token from the third on; filters, not lookups, so that a line is split a fixed number of times
    ids = F.filter("t", lambda x, i: (i >= 2) & (i % 2 == 0))
    labels = F.filter("t", lambda x, i: (i >= 2) & (i % 2 == 1))
    adj = F.zip_with(ids, labels, lambda x, y: F.struct(x.try_cast("bigint").alias("id"), label(y).cast("int").alias("l")))
    out = parts.select("value", F.size("t").alias("n"), F.get("t", F.lit(0)).try_cast("bigint").alias("id"), label(F.get("t", F.lit(1))).cast("int").alias("label"), F.array_sort(adj).alias("adj"))
    bad = F.col("id").isNull() | F.col("label").isNull() | (F.col("n") % 2 == 1) | F.exists("adj", lambda x: x["id"].isNull() | x["l"].isNull())
    return out.select("value", "id", "label", "adj", (~bad).alias("good"))


def read_graph(spark: SparkSession, path: str, label_type: str = "int", unlabelled: bool = False, bad_rows: str = "raise") -> LabeledGraph:
    """The graph in a file or folder of adjacency lines; bad_rows: "raise" or "drop"."""
    rows = parse_lines(spark.read.text(path), label_type, unlabelled)
    if bad_rows == "raise":
        wrong = rows.where("not good").select("value").limit(3).collect()
        if wrong:
            raise GraphError(f"malformed lines, such as {[r['value'] for r in wrong]}")
    rows = rows.where("good")
    edges = rows.select(F.col("id").alias("src"), F.col("label").alias("src_label"), F.explode("adj").alias("n"))
    return LabeledGraph(rows.select("id", "label"), edges.select("src", "src_label", F.col("n.id").alias("dst"), F.col("n.l").alias("dst_label")))


def read_workload(spark: SparkSession, path: str, unlabelled: bool = False) -> list[QueryGraph]:
    """Query graphs from one small text file."""
    return parse_workload("\n\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()), unlabelled)


def workload_tables(spark: SparkSession, workload: list[QueryGraph]) -> tuple[DataFrame, DataFrame]:
    """query_vertices (query, u, label) and query_edges (query, u, w)."""
    v = [(i, u, label) for i, q in enumerate(workload) for u, label in q.labels.items()]
    e = [(i, a, b) for i, q in enumerate(workload) for a, b in sorted(q.edges)]
    return spark.createDataFrame(v, "query int, u int, label int"), spark.createDataFrame(e, "query int, u int, w int")


def format_results(counts: DataFrame) -> DataFrame:
    """(line): the report of each query's count."""
    return counts.select(F.format_string("the number of matching results for query%d is %d", "query_id", "n_matches").alias("line"))


def write_results(counts: DataFrame, path: str, overwrite: bool = False) -> None:
    """The report as text; fails if the folder is there, unless it may be overwritten."""
    format_results(counts).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def write_graph(graph: LabeledGraph, path: str, overwrite: bool = False) -> None:
    """The graph as adjacency lines, as :func:`read_graph` reads them."""
    item = F.transform("adj", lambda x: F.concat_ws(" ", x["id"], x["l"]))
    line = F.concat(F.concat_ws(" ", "id", "label"), F.lit("\t"), F.array_join(item, " "))
    graph.adjacency().select(line.alias("value")).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def path_state(spark: SparkSession, path: str) -> str:
    """"missing", "empty" or "filled": what a reader finds at ``path``, and what a writer would have to delete."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(hadoop):
        return "missing"
    return "filled" if store.getContentSummary(hadoop).getLength() else "empty"


def check_paths(spark: SparkSession, inputs: list[str], output: str | None = None, overwrite: bool = False) -> None:
    """Raise GraphError before any job runs if an input is not there, or the output is and may not be overwritten."""
    for path in inputs:
        if path_state(spark, path) != "filled":
            raise GraphError(f"nothing to read at {path}")
    if output and not overwrite and path_state(spark, output) != "missing":
        raise GraphError(f"{output} is there already")


def workload_text(workload: list[QueryGraph]) -> str:
    """The workload as :func:`read_workload` reads it."""
    lines = lambda q: [f"{u} {x}\t" + " ".join(f"{n} {q.labels[n]}" for n in q.neighbours[u]) for u, x in q.labels.items()]
    return "\n\n".join("\n".join(lines(q)) for q in workload) + "\n"
