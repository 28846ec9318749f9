"""Nearest neighbours by multiprobe p-stable hashing with exact reranking.

Each of ``TABLES`` tables has ``FUNCTIONS`` hash functions floor((a.x + b) / w) with Gaussian a, for which
Euclidean distance is stable. A query visits, table by table, its own and the perturbed buckets in the order of
their estimated success: the probability that a neighbour at distance r falls there, a product of Gaussian
integrals over the functions' slots. It goes on until the tables together reach ``target`` success. What the
tables name is merged and ranked by the exact distance in double precision.

One more such function deals the index to slots, and slots of more than a shard's bytes to shards by a hash of the
id, each with its part of all tables: no bucket, however full, is in one task, and no table copies the vectors.
A query goes to the slots in the order of their success until ``ROUTED`` is reached, and to no other shard.

r is measured on a sample of at most ``SAMPLE`` vectors; every vector is indexed. Three passes:

1. All queries probe for r. One that has its k rows within r is done.
2. One that has k rows but the kth farther, within ``WIDER`` * r, probes again for that distance.
3. Others (far from the rest, short of k) are answered by a scan, which is exact, of every shard that may hold
   a nearer row: projections differ at most by the distance times the function's norm.

So every query has its k rows, or all there are. Of identical vectors only the ``k`` + 1 with the least ids are
indexed, which is exact: no answer can hold more.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids.
Vectors of other lengths are never neighbours. Slots of huge components are cut at 2 ** 62 either way, distances
beyond double precision are infinite. Ties go to the smaller id. Repeated rows are separate candidates only up to
k + 1 copies; an id that repeats with other vectors asks as the least of them. Extra columns are never read.
"""

from __future__ import annotations

from itertools import product
from math import erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motifline.llm.components import join_unique
from motifline.llm.text import col
from motifline.session import discard, materialize

TABLES, FUNCTIONS, SAMPLE, QUERY_BLOCK = 4, 4, 2000, 4096
#: Bytes of the vectors in a shard, about.
SHARD_BYTES = 8 << 20
#: Slots on either side of the query's that are considered.
REACH = 3
#: Success of the slots that a query goes to, and the distance, in r, up to which probes are repeated.
ROUTED, WIDER = 0.995, 1.5
_ERF = np.vectorize(erf)


def functions(dim: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    g = np.random.default_rng(dim)
    return g.normal(size=(dim, TABLES * FUNCTIONS)), g.uniform(0, width, TABLES * FUNCTIONS)


def route(dim: int) -> np.ndarray:
    """The function that deals out the index."""
    return np.random.default_rng(dim + (1 << 32)).normal(size=dim)


_STEPS = np.array(list(product(range(-REACH, REACH + 1), repeat=FUNCTIONS)))
#: A bucket's key is linear in its slots, modulo 2 ** 64, so a step adds its own key.
_FACTORS = np.random.default_rng(5).integers(0, 2**63, FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP_KEYS = (_STEPS.astype(np.int64).view(np.uint64) * _FACTORS).sum(1, dtype=np.uint64)


def slots_of(x: np.ndarray) -> np.ndarray:
    """Slots as integers, cut at 2 ** 62."""
    return np.clip(np.floor(np.nan_to_num(x)), -(2.0**62), 2.0**62).astype(np.int64)


def probes(place: np.ndarray, width: float, r: float, target: float) -> np.ndarray:
    """Which perturbations (of _STEPS) of one table's bucket in descending success, as many as reach ``target``.

    place: where the query lies in its slots (0 to width), by function.
    """
    edges = np.arange(-REACH, REACH + 2) * width - place[:, None]
    mass = np.diff(0.5 * (1 + _ERF(edges / (r * sqrt(2)))), axis=1)
    success = np.prod(mass[np.arange(FUNCTIONS), _STEPS + REACH], axis=1)
    order = np.argsort(-success, kind="stable")
    return order[: int(np.searchsorted(np.cumsum(success[order]), target)) + 1]


def slots_to_visit(along: float, width: float, r: float) -> list[int]:
    """Slots of the routing function in the order of their success for distance r, until ROUTED."""
    own = int(slots_of(np.array([along / width]))[0])
    reach = int(np.ceil(4 * r / width)) + 1
    steps = np.arange(-reach, reach + 1)
    inside = min(max(along / width - own, 0.0), 1.0) * width
    edges = np.append(steps, reach + 1) * width - inside
    mass = np.diff(0.5 * (1 + _ERF(edges / (r * sqrt(2)))))
    order = np.argsort(-mass, kind="stable")
    n = int(np.searchsorted(np.cumsum(mass[order]), ROUTED)) + 1
    return [own + int(s) for s in steps[order[:n]]]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def scan_shard(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, names=None):
    """(query, id, distance) of the nearest ``k`` of the shard's vectors, for each query; of those that ``names`` tells."""
    norms = (x * x).sum(1)
    for i in range(0, len(queries), 64):
        some = queries[i : i + 64]
        own = (some * some).sum(1)[:, None]
        with np.errstate(over="ignore", invalid="ignore"):
            near = norms - 2 * (some @ x.T) + own
            slack = 1e-9 * (norms + own)  # more than the products' rounding, for each vector
        near -= slack  # a lower bound
        near[np.isnan(near)] = -np.inf
        near[ids == query_ids[i : i + 64, None]] = np.inf
        for q, low in enumerate(near):
            if names is not None:
                low[~names(i + q)] = np.inf
            use = min(k, len(x))
            most = np.partition(low + 2 * slack[q], use - 1)[use - 1]
            found = np.flatnonzero((low <= most) & (ids != query_ids[i + q]) & ~np.isposinf(low) if not np.isnan(most) else ~np.isposinf(low))
            if len(found):
                with np.errstate(over="ignore"):
                    d = np.sqrt(((x[found] - some[q]) ** 2).sum(1))
                best = np.lexsort((ids[found], d))[:k]
                yield query_ids[i + q], ids[found[best]], d[best]


def search_shard(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, r, target: float, width: float | None = None):
    """(query, id, distance) of the nearest ``k`` that the shard's tables name, for each query; r: one number or one a query."""
    r = np.broadcast_to(np.asarray(r, float), len(queries))
    width = float(r[0]) if width is None else width
    a, b = functions(x.shape[1], width)
    with np.errstate(over="ignore", invalid="ignore"):
        slots = slots_of((x @ a + b) / width).reshape(len(x), TABLES, FUNCTIONS)
        place = np.nan_to_num((queries @ a + b) / width)
    own = slots_of(place).reshape(len(queries), TABLES, FUNCTIONS)
    inside = np.clip(place - np.floor(place), 0, 1).reshape(len(queries), TABLES, FUNCTIONS) * width
    keys = (slots.view(np.uint64) * _FACTORS).sum(-1, dtype=np.uint64)
    own_keys = (own.view(np.uint64) * _FACTORS).sum(-1, dtype=np.uint64)
    tables = [np.unique(keys[:, t], return_inverse=True) for t in range(TABLES)]
    each = 1 - (1 - target) ** (1 / TABLES)

    def names(q: int) -> np.ndarray:
        named = np.zeros(len(x), bool)
        for t, (buckets, member) in enumerate(tables):
            cells = own_keys[q, t] + _STEP_KEYS[probes(inside[q, t], width, float(r[q]), each)]
            i = np.minimum(np.searchsorted(buckets, cells), len(buckets) - 1)
            visited = np.zeros(len(buckets), bool)
            visited[i[buckets[i] == cells]] = True
            named |= visited[member]
        return named

    yield from scan_shard(ids, x, query_ids, queries, k, names)


def _valid(v) -> F.Column:
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return ~bad & F.exists(v, lambda e: e != 0)


def _along(batches):
    """Adds the place along the routing function."""
    known: dict[int, np.ndarray] = {}
    for b in batches:
        along = np.zeros(b.num_rows)
        dims = b.column(1).to_numpy()
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            a = known.setdefault(dim, route(dim))
            with np.errstate(over="ignore", invalid="ignore"):
                along[at] = np.clip(np.nan_to_num(_matrix(pa.chunked_array([b.column(2).take(pa.array(at))])) @ a), -1e300, 1e300)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(along)], ["id", "dim", "v", "along"])


def _radius(v: DataFrame, dim: int, n: int, k: int) -> float:
    """The 0.75 quantile of the distances to the ``k`` th of ``n`` rows, from a sample."""
    rows = v.where(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    x = np.array([r["v"] for r in rows])
    near = []
    with np.errstate(over="ignore"):
        for i in range(0, len(x), max(1, len(x) // 200)):
            d = np.sort(np.sqrt(((x - x[i]) ** 2).sum(1)))
            near.append(d[min(len(d) - 1, max(1, round(k * len(x) / n)))])
    return min(max(float(np.quantile(near, 0.75)), 1e-9), 1e150)


def nearest(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", target: float = 0.97) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of ``is_query`` (a condition on ``id``) against all rows."""
    v = vectors.select(col(id_col).cast("bigint").alias("id"), col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    v = v.where(_valid(F.col("v"))).select("id", F.size("v").alias("dim"), "v")
    v = materialize(v.mapInArrow(_along, "id bigint, dim int, v array<double>, along double"), "vectors")
    sizes = {r["dim"]: r["n"] for r in v.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # one row a length of vectors
    width = {dim: _radius(v, dim, n, k) for dim, n in sizes.items()}
    of_dim = F.lit(None).cast("double")
    for dim, w in width.items():
        of_dim = F.when(F.col("dim") == dim, F.lit(w)).otherwise(of_dim)
    v = v.withColumn("r", of_dim)
    slot = F.floor(F.greatest(F.least(F.col("along") / F.col("r"), F.lit(2.0**62)), F.lit(-(2.0**62)))).cast("bigint")
    copies = Window.partitionBy("v").orderBy("id")
    index = v.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1)
    index = materialize(index.select("id", "dim", "v", slot.alias("slot"), F.xxhash64("dim", slot).alias("cell")), "index")
    shards = index.groupBy("cell").agg(F.first("dim").alias("dim"), F.first("slot").alias("slot"), F.expr(f"cast(ceil(count(*) * 8 * first(dim) / {SHARD_BYTES}) as int)").alias("shards"))
    shards = materialize(shards, "shards")
    asking = v.where(is_query(F.col("id"))).groupBy("id").agg(F.min(F.struct("dim", "v", "along", "r")).alias("q"))
    asking = materialize(asking.select("id", "q.*"), "queries")
    top = Window.partitionBy("query_id").orderBy("score", "vec_id")

    def visits(batches):
        for b in batches:
            slots = [slots_to_visit(a, width[d], r) for d, a, r in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in (0, 1, 2, 4)), pa.array(slots, pa.list_(pa.int64()))], ["id", "dim", "v", "r", "slots"])

    def ask(queries: DataFrame, whole: bool) -> DataFrame:
        """The best ``k`` of the shards that the queries (id, dim, v, along, r) go to; whole: a scan within r."""
        if whole:  # every shard that may hold a row within r: a projection changes by at most r times the function's norm
            norm = {dim: float(np.linalg.norm(route(dim))) * (1 + 1e-9) for dim in sizes}
            far = F.lit(None).cast("double")
            for dim in sizes:
                far = F.when(F.col("dim") == dim, F.col("r") * norm[dim] / width[dim] + 1e-6 * F.abs(F.col("along")) / width[dim]).otherwise(far)
            here = queries.withColumn("far", far).withColumn("here", F.col("along") / of_dim)
            routed = here.join(shards, "dim").where((F.col("slot") + 2 >= F.col("here") - F.col("far")) & (F.col("slot") - 1 <= F.col("here") + F.col("far")))
        else:
            kinds = "id bigint, dim int, v array<double>, r double, slots array<bigint>"
            routed = queries.select("id", "dim", "v", "along", "r").mapInArrow(visits, kinds).withColumn("slot", F.explode("slots"))
            routed = routed.withColumn("cell", F.xxhash64("dim", "slot")).drop("dim", "slot").join(shards, "cell")
        routed = materialize(routed.select("id", "dim", "cell", "shards", "r", "v"), "routed")
        blocks = routed.groupBy("cell").agg(F.first("shards").alias("shards"), F.expr(f"cast(ceil(count(*) / {QUERY_BLOCK}) as int)").alias("blocks"))
        blocks = materialize(blocks, "blocks")
        rows = join_unique(index.select("cell", "dim", "id", "v"), blocks, "cell")
        rows = rows.withColumn("shard", F.expr("cast(pmod(xxhash64(id), shards) as int)")).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
        asked = join_unique(routed, blocks.select("cell", "blocks"), "cell")
        asked = asked.withColumn("block", F.expr("cast(pmod(xxhash64(id, 1), blocks) as int)")).withColumn("shard", F.explode(F.expr("sequence(0, shards - 1)")))

        def answer(key, left: pa.Table, right: pa.Table) -> pa.Table:
            out = ([], [], [])
            if left.num_rows and right.num_rows:
                dim = key[3].as_py()
                both = left["id"].to_numpy(), _matrix(left["v"]), right["id"].to_numpy(), _matrix(right["v"])
                for q, ids, d in scan_shard(*both, k) if whole else search_shard(*both, k, right["r"].to_numpy(), target, width[dim]):
                    out[0].extend([q] * len(ids)), out[1].extend(ids.tolist()), out[2].extend(d.tolist())
            return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

        keys = ["cell", "shard", "block", "dim"]
        left = rows.select(*keys, "id", "v").groupBy(*keys)
        found = left.cogroup(asked.select(*keys, "id", "v", "r").groupBy(*keys)).applyInArrow(answer, "query_id bigint, vec_id bigint, score double")
        found = found.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        found = materialize(found, "answers")
        discard(routed), discard(blocks)
        return found

    def uncovered(queries: DataFrame, found: DataFrame) -> DataFrame:
        """Queries short of k or with the kth answer beyond their r; kth: its distance."""
        kth = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
        left = queries.join(kth, "id", "left").where(F.col("kth").isNull() | (F.col("kth") > F.col("r")))
        return materialize(left.select(*queries.columns, "kth"), "uncovered")

    answers = ask(asking, False)
    left = uncovered(asking, answers)
    if not left.limit(1).count():
        return answers
    again = left.where(F.col("kth") <= WIDER * F.col("r")).withColumn("r", F.col("kth")).drop("kth")
    more = ask(again, False)
    # what was found for r and for the kth distance, merged
    both = answers.select("query_id", "vec_id", "score").union(more.select("query_id", "vec_id", "score")).distinct()
    both = both.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    far = left.where(F.col("kth").isNull() | (F.col("kth") > WIDER * F.col("r"))).withColumn("r", F.coalesce("kth", F.lit(float("inf")))).drop("kth")
    if not far.limit(1).count():
        return both
    done = both.join(far.select(F.col("id").alias("query_id")), "query_id", "left_anti").select(*both.columns)
    return done.union(ask(far, True))
