"""Layouts: partitions by id or by the MinHash of labelled adjacency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifline.functions.lsh import bucket, hashed, signature
from motifline.operators.graph import LabeledGraph


# Fixed values of this layout: modulus and factors that mix a label with its least hash.
_PRIME, _OF_LABEL, _OF_HASH = 2147483647, 1000003, 31


def labelled_minhash(graph: LabeledGraph) -> DataFrame:
    """(id, minhash): least neighbour hash by label, mixed with the label and summed; equal neighbourhoods are equal.

    No list is gathered: both steps are sums and minima, combined before the shuffle.
    """
    least = graph.edges.groupBy(F.col("src").alias("id"), F.col("dst_label")).agg(F.min(hashed(F.col("dst"), 0)).alias("h"))
    mixed = F.pmod(F.col("h") * _OF_HASH + (F.col("dst_label").cast("bigint") + 1) * _OF_LABEL, F.lit(_PRIME).cast("bigint"))
    return least.groupBy("id").agg(F.sum(F.pmod(mixed * mixed, F.lit(_PRIME).cast("bigint"))).alias("minhash"))


def neighbour_signature(graph: LabeledGraph, size: int = 5) -> DataFrame:
    """(id, sig): the signature of the neighbours' ids. Minima are taken before the shuffle."""
    least = [F.min(hashed(F.col("dst"), j)).alias(f"s{j}") for j in range(size)]
    return graph.edges.groupBy(F.col("src").alias("id")).agg(*least).select("id", F.array(*[f"s{j}" for j in range(size)]).alias("sig"))


def seed_buckets(graph: LabeledGraph, size: int = 1) -> DataFrame:
    """(id, bucket): seeds whose neighbours hash alike."""
    return neighbour_signature(graph, size).select("id", bucket(F.col("sig")).alias("bucket"))


def partitioned(graph: LabeledGraph, parts: int, by: str = "hash") -> DataFrame:
    """Edges with ``part``: of the source id ("hash") or of its labelled MinHash ("lsh")."""
    if by == "hash":
        return graph.edges.withColumn("part", (F.abs("src") % parts).cast("int"))
    near = labelled_minhash(graph).select(F.col("id").alias("src"), F.pmod("minhash", F.lit(parts)).cast("int").alias("part"))
    return graph.edges.join(near, "src")


def layout(graph: LabeledGraph, parts: int, by: str = "hash") -> DataFrame:
    """Edges dealt out so that partition ``part`` holds all edges of its sources, sorted by source."""
    return partitioned(graph, parts, by).repartitionById(parts, F.col("part")).sortWithinPartitions("src")


def query_bucket(labels, size: int = 1):
    """The bucket column of an array of labels."""
    return bucket(signature(labels, size))
