"""``python -m motifline.run DATA QUERY [--threads N] [--out PATH]``: count a workload's matches and report.

DATA is a file or folder of adjacency lines, QUERY one file of query graphs. Load time is reading, checking and
statistics; task time is planning and matching.
"""

from __future__ import annotations

import argparse
import time
from dataclasses import dataclass

from pyspark.sql import SparkSession

from motifline.operators.match import MatchConfig, Matcher
from motifline.plans.pattern import query_labels
from motifline.sources.text import check_paths, format_results, read_graph, read_workload, write_results


@dataclass(frozen=True)
class Report:
    load_seconds: float
    task_seconds: float
    lines: list[str]


def run(spark: SparkSession, data: str, query: str, out: str | None = None, config: MatchConfig = MatchConfig(), **reading) -> Report:
    """Counts of all queries; written to ``out`` too, which must not be there."""
    check_paths(spark, [data, query], out)
    began = time.monotonic()
    work = read_workload(spark, query, reading.get("unlabelled", False))
    graph = read_graph(spark, data, **reading).stored()
    labels = query_labels(work)
    graph.frequencies(labels), graph.pair_counts(labels)
    load = time.monotonic()
    counts = Matcher(graph, config).count_workload(work)
    rows = counts.collect()  # one a query
    done = time.monotonic()
    counts = spark.createDataFrame(rows, counts.schema).orderBy("query_id")
    if out:
        write_results(counts, out)
    return Report(load - began, done - load, [r["line"] for r in format_results(counts).collect()])


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="motifline.run", description="Count the matches of query graphs in a data graph.")
    parser.add_argument("data")
    parser.add_argument("query")
    parser.add_argument("--threads", type=int, help="local threads; the master of the environment without it")
    parser.add_argument("--out", help="folder for the report")
    parser.add_argument("--unlabelled", action="store_true")
    got = parser.parse_args(args)
    builder = SparkSession.builder.appName("motifline")
    spark = (builder.master(f"local[{got.threads}]") if got.threads else builder).getOrCreate()
    report = run(spark, got.data, got.query, got.out, unlabelled=got.unlabelled)
    print(f"Load Time : {report.load_seconds:.3f} seconds")
    print(f"Task Time : {report.task_seconds:.3f} seconds")
    for line in report.lines:
        print(line)


if __name__ == "__main__":
    main()
