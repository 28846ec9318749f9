"""The labelled data graph as two flat DataFrames, and its statistics."""

from __future__ import annotations

from collections.abc import Iterable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifline.session import materialize


class GraphError(ValueError):
    """Data that is not a simple, closed, labelled graph."""


class LabeledGraph:
    """``vertices`` (id, label) and ``edges`` (src, src_label, dst, dst_label) in both directions.

    Edges carry both labels, so that expansion never has to look a vertex up.
    """

    def __init__(self, vertices: DataFrame, edges: DataFrame):
        self.vertices, self.edges = vertices, edges
        self._frequency: dict[int, int] = {}
        self._pairs: dict[tuple[int, int], int] = {}

    @classmethod
    def from_tables(cls, vertices: DataFrame, pairs: DataFrame, unlabelled: bool = False) -> LabeledGraph:
        """From (id, label) and (src, dst) in any direction, repeated or not; loops are dropped."""
        label = F.lit(0) if unlabelled else F.col("label")
        v = vertices.select(F.col("id").cast("bigint").alias("id"), label.cast("int").alias("label"))
        both = symmetric(pairs)
        named = both.join(v.select(F.col("id").alias("src"), F.col("label").alias("src_label")), "src").join(
            v.select(F.col("id").alias("dst"), F.col("label").alias("dst_label")), "dst"
        )
        return cls(v, named.select("src", "src_label", "dst", "dst_label"))

    def trimmed(self, labels: Iterable[int]) -> LabeledGraph:
        """Without vertices and edges of other labels. Degree and neighbour labels must be taken before."""
        wanted = sorted(labels)
        return LabeledGraph(
            self.vertices.where(F.col("label").isin(wanted)),
            self.edges.where(F.col("src_label").isin(wanted) & F.col("dst_label").isin(wanted)),
        )

    def persisted(self) -> LabeledGraph:
        from pyspark import StorageLevel

        level = StorageLevel.MEMORY_AND_DISK
        return LabeledGraph(self.vertices.persist(level), self.edges.persist(level))

    def stored(self) -> LabeledGraph:
        """Written to the shared folder, edges sorted by their labels, so that a slice reads only its pages.

        The sort is within partitions: nothing is shuffled for it, and no pair of labels has to fit in a task.
        """
        order = ["src_label", "dst_label", "src"]
        return LabeledGraph(materialize(self.vertices, "vertices"), materialize(self.edges.sortWithinPartitions(*order), "edges"))

    def slice(self, a: int, b: int) -> DataFrame:
        """(src, dst) of the edges from label ``a`` to label ``b``."""
        return self.edges.where((F.col("src_label") == a) & (F.col("dst_label") == b)).select("src", "dst")

    @cached_property
    def neighbour_counts(self) -> DataFrame:
        """(id, nbr_label, cnt): neighbours of each label."""
        return self.edges.groupBy(F.col("src").alias("id"), F.col("dst_label").alias("nbr_label")).agg(F.count("*").alias("cnt"))

    @cached_property
    def profiles(self) -> DataFrame:
        """(id, label, degree, near): near maps neighbour label to count. One shuffle over edges."""
        near = self.neighbour_counts.groupBy("id").agg(
            F.sum("cnt").alias("degree"), F.map_from_entries(F.collect_list(F.struct("nbr_label", "cnt"))).alias("near")
        )
        none = F.expr("cast(map() as map<int,bigint>)")
        return self.vertices.join(near, "id", "left").select(
            "id", "label", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"), F.coalesce("near", none).alias("near")
        )

    def label_frequency(self) -> DataFrame:
        return self.vertices.groupBy("label").agg(F.count("*").alias("freq"))

    def frequencies(self, labels: Iterable[int]) -> dict[int, int]:
        """Frequencies of a query workload's labels, over the whole graph; counted once a graph."""
        wanted = set(labels)
        if new := sorted(wanted - set(self._frequency)):
            rows = self.label_frequency().where(F.col("label").isin(new)).collect()
            self._frequency.update(dict.fromkeys(new, 0) | {r["label"]: r["freq"] for r in rows})
        return {x: n for x in wanted if (n := self._frequency[x])}

    def pair_counts(self, labels: Iterable[int]) -> dict[tuple[int, int], int]:
        """Directed edges between a workload's labels (0 without any); counted once a graph."""
        wanted = sorted(set(labels))
        if any((x, y) not in self._pairs for x in wanted for y in wanted):
            rows = self.edges.where(F.col("src_label").isin(wanted) & F.col("dst_label").isin(wanted))
            rows = rows.groupBy("src_label", "dst_label").agg(F.count("*").alias("n")).collect()  # the workload's labels squared at most
            self._pairs.update({(x, y): 0 for x in wanted for y in wanted} | {(r["src_label"], r["dst_label"]): r["n"] for r in rows})
        return {(x, y): self._pairs[x, y] for x in wanted for y in wanted}

    def adjacency(self) -> DataFrame:
        """(id, label, adj): neighbours as an array of (id, l), sorted by id."""
        item = F.struct(F.col("dst").alias("id"), F.col("dst_label").alias("l"))
        near = self.edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(item)).alias("adj"))
        empty = F.expr("cast(array() as array<struct<id:bigint,l:int>>)")
        return self.vertices.join(near, "id", "left").withColumn("adj", F.coalesce("adj", empty))

    def validate(self) -> DataFrame:
        """(problem, n) of what keeps this from being a simple, closed, symmetric, consistently labelled graph."""
        e, v = self.edges, self.vertices
        back = e.select(F.col("dst").alias("src"), F.col("dst_label").alias("src_label"), F.col("src").alias("dst"), F.col("src_label").alias("dst_label"))
        ends = e.select(F.col("dst").alias("id"), F.col("dst_label").alias("label"))
        found = {
            "null": v.where("id is null or label is null").select("id"),
            "repeated vertex": v.groupBy("id").count().where("count > 1").select("id"),
            "repeated edge": e.groupBy("src", "dst").count().where("count > 1").select("src"),
            "loop": e.where("src = dst").select("src"),
            "one-way edge": e.join(back, e.columns, "left_anti").select("src"),
            "missing neighbour": ends.join(v, "id", "left_anti").select("id"),
            "wrong label": ends.join(v.withColumnRenamed("label", "own"), "id").where("label <> own").select("id"),
        }
        parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n") for name, df in found.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out.where("n > 0")


def symmetric(pairs: DataFrame) -> DataFrame:
    """Distinct (src, dst) in both directions, without loops."""
    p = pairs.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst")).where("src <> dst")
    return p.union(p.select("dst", "src")).distinct()
