"""Near-duplicate groups by an LSH forest over MinHash signatures.

1. A document becomes its set of distinct ``shingle``-word shingles (64-bit hashes of lower-cased words),
   the set's digest and a signature of 128 minima. Documents with one set form a class at once.
2. The forest: ``TREES`` orders of the signature, each sorted. Classes that share a prefix are neighbours;
   the depth of the prefix adapts to the region: one value where at most ``WIDE`` * ``BLOCK`` classes share
   it, longer where more do. Regions over ``BLOCK`` are cut into blocks and all pairs of blocks meet, each in
   a task of its own. Sketches (one byte of each minimum) of neighbours are compared in place; of the pairs
   that may reach the threshold a region tells only a spanning forest, so its rows are linear in its size.
3. The parts that these span are clusters; every link lies within one. The sets of a cluster meet once, in one
   task (or in pairs of blocks by number and bytes), where all pairs are confirmed on the full sets but those
   joined already. Again only a spanning forest comes out.
4. Classes whose prefixes were made longer (their region had over ``WIDE`` * ``BLOCK``), and clusters over that
   size, whose spanning pairs alone are confirmed in place of step 3, are compared once more, exactly: two sets
   of the threshold's similarity share one of their rarest shingles (the prefix of each set in one order of all
   shingles), so all classes of different components that share one meet. Of a shingle of more than ``BLOCK``
   classes, all pairs of blocks meet in tasks of their own, except those within the component that most of
   the classes are in. A class names its most similar candidates, eight times as many when they bring no
   link, until none is untried.

Every link is confirmed on full sets. A pair at the threshold is missed if it shares the first value in none of
the trees (0.2 ** 8 at 0.8) or its sketches underrate it by ``SLACK`` standard deviations.

Edge cases: null, empty and wordless texts have an empty set, no link and stay. A document without an id
is kept (it cannot be named by id) and never names a component if another member can. Repeated rows share
a class. Extra columns are never read.
"""

from __future__ import annotations

import hashlib
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifline.llm.components import components, join_unique
from motifline.llm.text import col, runs, space_words, texts
from motifline.session import discard, few_tasks, materialize

TREES, DEPTH, SKETCH, BLOCK = 8, 6, 128, 2048
#: Blocks of a region or cluster of which all pairs meet; bytes of the sets in one block of a cluster.
WIDE, BLOCK_BYTES = 8, 32 << 20
#: Standard deviations of the sketch estimate below the threshold that are still confirmed.
SLACK = 4.0
#: Buckets in which shingles are counted to order them by rarity.
RARITY_BITS = 18
#: Bytes of ids to broadcast at most; more are joined by a shuffle.
MAX_BROADCAST = 32 << 20

_RNG = np.random.default_rng(20240607)
_MIX = _RNG.integers(0, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PERM = (_RNG.integers(0, 2**63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= 250_000:
                self.clear()
            self[word] = h
        return h


_HASHES = _Hashes()


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles; of all words if they are fewer."""
    words = space_words(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.array([_HASHES[w] for w in words], np.uint64)
    n, k = max(1, len(h) - size + 1), min(size, len(h))
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out += h[i : i + n] * _MIX[i % 8] + np.uint64(i // 8)
        out ^= out >> np.uint64(29)
        out *= _MIX[(i + 3) % 8]
    out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(items: np.ndarray) -> np.ndarray:
    """The 128 least 64-bit hashes."""
    low = np.full(SKETCH, 2**64 - 1, np.uint64)
    for i in range(0, len(items), 4096):
        x = items[None, i : i + 4096] * _PERM
        low = np.minimum(low, x.min(axis=1))
    return low


def _signed(size: int):
    def run(batches):
        for b in batches:
            n, digest, orders, sketch = [], [], [], []
            for t in texts(b.column(2)):
                s = shingle_set(t, size)
                n.append(len(s))
                if not len(s):
                    digest.append(None), orders.append(None), sketch.append(None)
                    continue
                sig = signature(s)
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                orders.append((sig[: TREES * DEPTH] >> np.uint64(32)).astype(">u4").tobytes())
                sketch.append((sig >> np.uint64(24)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (digest, orders, sketch))],
                ["id", "h", "n", "digest", "orders", "sketch"],
            )

    return run


def _sets(size: int):
    def run(batches):
        for b in batches:
            sets = [shingle_set(t, size) for t in texts(b.column(0))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["digest", "items"],
            )

    return run


def _close(threshold: float) -> float:
    """Equal sketch bytes that a pair at the threshold has at least, but for ``SLACK`` standard deviations."""
    return (threshold - SLACK * (threshold * (1 - threshold) / SKETCH) ** 0.5) * SKETCH


def _near(sketch, n, rows, right, threshold: float) -> np.ndarray:
    """Equal sketch bytes of ``rows`` with ``right``; 0 where the pair cannot reach the threshold."""
    near = (sketch[rows, None] == sketch[right][None]).sum(-1, dtype=np.int16)
    small, big = np.minimum(n[rows, None], n[right][None]), np.maximum(n[rows, None], n[right][None])
    near[(near < _close(threshold)) | (small < threshold * big * (1 - 1e-9))] = 0
    return near


_TILE = ["cell", "lo", "hi"]


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of a tile's two blocks, and whether they are the same block."""
    part, lo, hi = t["part"].to_numpy(), t["lo"][0].as_py(), t["hi"][0].as_py()
    return np.flatnonzero(part == lo), np.flatnonzero(part == hi), lo == hi


def _pairs_out(pairs: list):
    for i in range(0, len(pairs), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs[i : i + 10_000]], pa.binary()) for k in (0, 1)], ["a", "b"])


def _spans(threshold: float):
    """Tiles of a region -> pairs (a, b) that span the parts that candidate pairs join."""

    def tile(t: pa.Table):
        n, digest = t["n"].to_numpy(), t["digest"].to_pylist()
        sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(len(digest), SKETCH)
        left, right, same = _sides(t)
        group = np.arange(len(digest))
        for i in range(0, len(left), 32):
            rows = left[i : i + 32]
            others = right[i:] if same else right
            near = _near(sketch, n, rows, others, threshold)
            for r, found in zip(rows, near):
                js = np.flatnonzero(found)
                js = js[group[others[js]] != group[r]]
                if len(js):
                    js = js[np.argsort(-found[js], kind="stable")]
                    parts, first = np.unique(group[others[js]], return_index=True)
                    for j in others[js[first]]:
                        yield digest[r], digest[j]
                    group[np.isin(group, parts)] = group[r]

    def run(batches):
        pairs: list = []
        for t in runs(batches, _TILE):
            if t.num_rows > 1:
                pairs.extend(tile(t))
            if len(pairs) >= 10_000:
                yield from _pairs_out(pairs)
                pairs = []
        yield from _pairs_out(pairs)

    return run


def _linked(percent: int):
    """Tiles of a cluster with full sets -> links (a, b) that span what its links join; ``b`` is the least of a part."""

    def tile(t: pa.Table):
        digest = t["digest"].to_pylist()
        kept = sorted({d: i for i, d in enumerate(digest)}.values())  # a document may be repeated
        t, digest = t.take(kept), [digest[i] for i in kept]
        sets = [np.frombuffer(x, np.uint64) for x in t["items"].to_pylist()]
        left, right, same = _sides(t)
        n = np.array([len(x) for x in sets], np.int64)
        ends = np.cumsum(n)
        values, token = np.unique(np.concatenate(sets), return_inverse=True)
        own = [token[e - k : e] for e, k in zip(ends.tolist(), n.tolist())]
        sketch = np.stack([signature(x) >> np.uint64(24) for x in sets]).astype(np.uint8) if len(sets) > 64 else None
        seen, group = np.zeros(len(values), bool), np.arange(len(digest))
        for i in range(0, len(left), 32):
            rows = left[i : i + 32]
            others = right[i + 1 :] if same else right
            near = np.ones((len(rows), len(others)), np.int16) if sketch is None else _near(sketch, n, rows, others, percent / 100)
            for r, found in zip(rows, near):
                js = others[np.flatnonzero(found)]
                js = js[group[js] != group[r]]
                js = js[100 * np.minimum(n[js], n[r]) >= percent * np.maximum(n[js], n[r])]
                if not len(js):
                    continue
                seen[own[r]] = True
                for lo in range(0, len(js), 256):
                    some = js[lo : lo + 256]
                    some = some[group[some] != group[r]]
                    if len(some):
                        both = np.add.reduceat(seen[np.concatenate([own[j] for j in some])].astype(np.int64), np.cumsum(n[some]) - n[some])
                        good = some[100 * both >= percent * (n[r] + n[some] - both)]
                        group[np.isin(group, group[good])] = group[r]
                seen[own[r]] = False
        order = np.argsort(group, kind="stable")
        for part in np.split(order, 1 + np.flatnonzero(np.diff(group[order]))):
            if len(part) > 1:
                names = sorted(digest[j] for j in part)
                yield from ((x, names[0]) for x in names[1:])

    def run(batches):
        pairs: list = []
        for t in runs(batches, _TILE):
            if t.num_rows > 1:
                pairs.extend(tile(t))
            if len(pairs) >= 10_000:
                yield from _pairs_out(pairs)
                pairs = []
        yield from _pairs_out(pairs)

    return run


def _cluster_sets(size: int):
    """(digest, cell, blocks, text) -> the text's shingles in its place; a row goes if it is another text of the id."""

    def run(batches):
        for b in batches:
            keep, items = [], []
            for i, (want, t) in enumerate(zip(b.column(0).to_pylist(), texts(b.column(3)))):
                s = shingle_set(t, size)
                if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == want:
                    keep.append(i)
                    items.append(s.tobytes())
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in range(3)), pa.array(items, pa.binary())], ["digest", "cell", "blocks", "items"])

    return run


def _rarity(batches):
    """Counts of the shingles by bucket."""
    c = np.zeros(1 << RARITY_BITS, np.int64)
    for b in batches:
        for lo in range(0, b.num_rows, 128):
            x = np.frombuffer(b"".join(b.column(0).slice(lo, 128).to_pylist()), np.uint64)
            c += np.bincount((x >> np.uint64(64 - RARITY_BITS)).astype(np.int64), minlength=len(c))
    used = np.flatnonzero(c)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(c[used], pa.int64())], ["bucket", "c"])


def _prefixes(percent: int, counts: np.ndarray):
    """(token, digest): the rarest shingles of each set, of which similar sets share one."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 128):
                digest, token = [], []
                for d, x in zip(b.column(0).slice(lo, 128).to_pylist(), b.column(1).slice(lo, 128).to_pylist()):
                    x = np.frombuffer(x, np.uint64)
                    order = np.lexsort((x, counts[(x >> np.uint64(64 - RARITY_BITS)).astype(np.int64)]))
                    first = x[order[: len(x) + percent * len(x) // -100 + 1]]
                    digest.extend([d] * len(first)), token.append(first.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token), pa.int64()), pa.array(digest, pa.binary())], ["token", "digest"])

    return run


def _meet(threshold: float, most: int):
    """Pairs (a, b) of a tile's two blocks that may be links; (a, null) if ``a`` has more than the ``most`` it names."""

    def cell(t, pairs, cut):
        n, digest = t["n"].to_numpy(), t["digest"].to_pylist()
        sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(len(digest), SKETCH)
        _, group = np.unique(t["component"].to_pylist(), return_inverse=True)
        left, right, _ = _sides(t)
        top = min(most, len(right))
        for i in range(0, len(left) if top else 0, 32):
            rows = left[i : i + 32]
            near = _near(sketch, n, rows, right, threshold)
            near[group[rows, None] == group[right][None]] = 0
            cut.update(digest[rows[r]] for r in np.flatnonzero(np.count_nonzero(near, axis=1) > top))
            best = np.argpartition(-near, top - 1, axis=1)[:, :top]
            for r, c in zip(*np.nonzero(np.take_along_axis(near, best, 1))):
                x, y = digest[rows[r]], digest[right[best[r, c]]]
                pairs.add((min(x, y), max(x, y)))

    def run(batches):
        pairs: set = set()
        more: set = set()
        for t in runs(batches, _TILE):
            if t.num_rows > 1:
                cell(t, pairs, more)
        yield from _pairs_out([*pairs, *((x, None) for x in more)])

    return run


def _rare_prefixes(sets: DataFrame, percent: int) -> DataFrame:
    counts = np.zeros(1 << RARITY_BITS, np.int64)
    for r in sets.select("items").mapInArrow(_rarity, "bucket int, c bigint").groupBy("bucket").agg(F.sum("c").alias("c")).toLocalIterator():
        counts[r["bucket"]] = r["c"]
    return sets.select("digest", "items").mapInArrow(_prefixes(percent, counts), "token bigint, digest binary")


def _exact(active: DataFrame, prefixes: DataFrame, threshold: float, most: int) -> DataFrame:
    """Candidate pairs of all classes that share a shingle of their prefixes and are in different components."""
    own = prefixes.join(active.select("digest", "sketch", "n", "component"), "digest")
    by = prefixes.join(active.select("digest", "component"), "digest").groupBy("token", "component").agg(F.count("*").alias("c"))
    lists = by.groupBy("token").agg(F.sum("c").alias("size"), F.max(F.struct("c", "component")).alias("top")).where("size > top.c").selectExpr(
        "token", "size", "top.component AS major", f"cast(ceil((size - top.c) / {BLOCK}) AS int) AS minors", f"cast(ceil(top.c / {BLOCK}) AS int) AS majors"
    )
    part = f"CASE WHEN size <= {BLOCK} THEN 0 WHEN component = major THEN minors + pmod(xxhash64(digest), majors) ELSE pmod(xxhash64(digest), minors) END"
    others = f"CASE WHEN size <= {BLOCK} THEN 1 WHEN component = major THEN minors ELSE minors + majors END"
    rows = own.join(lists, "token").withColumn("part", F.expr(part).cast("int")).withColumn("other", F.explode(F.expr(f"sequence(0, cast({others} AS int) - 1)")))
    rows = rows.select(F.col("token").alias("cell"), F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "digest", "sketch", "n", "component")
    met = rows.repartition(*_TILE).sortWithinPartitions(*_TILE)
    return met.mapInArrow(_meet(threshold, most), "a binary, b binary").distinct()


def _confirm(threshold_percent: int):
    def run(batches):
        for b in batches:
            linked = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= threshold_percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return run


def _tiles(rows: DataFrame, blocks: str, all_pairs: str = "true") -> DataFrame:
    """Rows of (cell, digest, ...) dealt to all pairs of their cell's ``blocks``, or only to their own one."""
    rows = rows.withColumn("part", F.expr(f"cast(pmod(xxhash64(digest), {blocks}) AS int)"))
    rows = rows.withColumn("other", F.explode(F.expr(f"CASE WHEN {blocks} > 1 AND {all_pairs} THEN sequence(0, cast({blocks} AS int) - 1) ELSE array(part) END")))
    rows = rows.withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other")).drop("other")
    return rows.repartition(*_TILE).sortWithinPartitions(*_TILE)


def _forest(classes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame | None]:
    """Spanning pairs of all regions, and the classes (digest) of which a prefix was made longer, None without any.

    A region is the hash of its tree and prefix; equal hashes would only make a region larger.
    """
    label = F.expr(f"substring(orders, tree * {4 * DEPTH} + 1, {4 * DEPTH})")
    todo = classes.select(F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "digest", "n", "sketch", "orders")
    todo = todo.select("tree", label.alias("label"), "digest", "n", "sketch")
    parts, dense = [], None
    for depth in range(1, DEPTH + 1):
        at = todo.withColumn("cell", F.xxhash64("tree", F.substring("label", 1, 4 * depth)))
        sizes = at.groupBy("cell").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK)
        sizes = materialize(sizes, "regions")  # one row for more than BLOCK classes
        most = sizes.agg(F.max("size")).first()[0] or 0
        deeper = most > WIDE * BLOCK and depth < DEPTH
        at = at.join(sizes, "cell", "left").withColumn("blocks", F.expr(f"ceil(coalesce(size, 1) / {BLOCK})"))
        whole = at.where(F.col("blocks") <= WIDE) if deeper else at
        tiles = _tiles(whole.select("cell", "digest", "n", "sketch", "blocks"), "blocks", f"blocks <= {WIDE}")
        parts.append(tiles.select(*_TILE, "part", "digest", "n", "sketch").mapInArrow(_spans(threshold), "a binary, b binary"))
        if most > WIDE * BLOCK and dense is None:
            dense = materialize(at.where(F.col("blocks") > WIDE).select("digest").distinct(), "dense")
        if not deeper:
            break
        todo = at.where(F.col("blocks") > WIDE).select("tree", "label", "digest", "n", "sketch")
    spans = parts[0]
    for p in parts[1:]:
        spans = spans.union(p)
    return spans, dense


def _of_ids(src: DataFrame, rows: DataFrame) -> DataFrame:
    """``src`` joined with ``rows`` by id (null ids too); the ids are broadcast if their bytes allow it."""
    rows = rows.withColumnRenamed("id", "_id")
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col("_id").cast("string"))), F.lit(0))).first()
    rows = F.broadcast(rows) if 64 * n + size <= MAX_BROADCAST else rows
    return src.join(rows, src["id"].eqNullSafe(F.col("_id")))


def _cluster_links(src: DataFrame, members: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) within clusters: members are (id, digest, cell, blocks)."""
    rows = _of_ids(src, members).select("digest", "cell", "blocks", "text")
    sets = rows.mapInArrow(_cluster_sets(shingle), "digest binary, cell bigint, blocks int, items binary")
    tiles = _tiles(sets, "blocks").select(*_TILE, "part", "digest", "items")
    return materialize(tiles.mapInArrow(_linked(percent), "a binary, b binary"), "links")


def _dense_links(src: DataFrame, active: DataFrame, spans: DataFrame, found: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Components (node, component) after all links between ``active`` classes; see step 4 of the module.

    ``spans``: pairs of giant clusters, tried first. ``found``: components by the links so far.
    """
    source = _of_ids(src, active.select("id").distinct()).select("text")
    sets = source.mapInArrow(_sets(shingle), "digest binary, items binary").join(active.select("digest"), "digest", "left_semi")
    sets = materialize(sets.dropDuplicates(["digest"]), "sets")
    prefixes = materialize(_rare_prefixes(sets, percent), "prefixes")
    tested, most = None, 2
    for turn in count():
        if turn:
            now = active.join(found.withColumnRenamed("node", "digest"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))
            pairs = _exact(now, prefixes, percent / 100, most)
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        else:
            pairs = spans.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = materialize(pairs, "pairs")
        more = pairs.where("b is null").limit(1).count()
        full = pairs.where("b is not null").join(sets.select(F.col("digest").alias("a"), F.col("items").alias("x")), "a").join(
            sets.select(F.col("digest").alias("b"), F.col("items").alias("y")), "b"
        )
        results = materialize(full.select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a binary, b binary, linked boolean"), "tried")
        discard(pairs)
        new = results.where("linked").limit(1).count()
        if turn and not new and not more:
            break
        most = most if not turn else max(6, most) if new else 8 * most
        tested = results.select("a", "b") if tested is None else tested.union(results.select("a", "b"))
        if new:
            last = found
            found = components(results.where("linked").select("a", "b").union(found.select(F.col("node").alias("a"), F.col("component").alias("b"))))
            discard(last)
    discard(sets)
    discard(prefixes)
    return found


def near_duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, percent: int = 80
) -> DataFrame:
    """One row a document: id, h (xxhash64 of the text), n_shingles, component_id, kept.

    Documents are linked whose shingle sets have a Jaccard similarity of ``percent`` or more.
    """
    src = docs.select(col(id_col).alias("id"), F.xxhash64(col(text_col)).alias("h"), col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    signed = materialize(src.mapInArrow(_signed(shingle), f"id {kind}, h bigint, n bigint, digest binary, orders binary, sketch binary"), "signatures")
    classes = signed.where("digest is not null").groupBy("digest").agg(
        F.min("id").alias("id"), F.first("n").alias("n"), F.first("orders").alias("orders"), F.first("sketch").alias("sketch")
    )
    n_rows = signed.count()
    classes = materialize(classes, "classes", n_rows)
    n_classes = classes.count()
    spans, dense = _forest(classes, percent / 100)
    spans = materialize(spans, "spans")
    cluster = components(spans).withColumnRenamed("component", "cluster")
    members = materialize(classes.select("digest", "id", "n").join(cluster, F.col("digest") == F.col("node")).drop("node"), "members", n_classes)
    discard(cluster)
    sizes = members.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("n").alias("weight"))
    big = materialize(sizes.where((F.col("size") > BLOCK) | (8 * F.col("weight") > BLOCK_BYTES)), "big")
    several, giant = big.agg(F.count("*"), F.coalesce(F.sum((F.col("size") > WIDE * BLOCK).cast("int")), F.lit(0))).first()
    dealt = members.join(big, "cluster", "left").where(F.coalesce("size", F.lit(0)) <= WIDE * BLOCK)
    blocks = F.expr(f"cast(greatest(ceil(coalesce(size, 1) / {BLOCK}), ceil(8 * coalesce(weight, 1) / {BLOCK_BYTES})) AS int)")
    found = _cluster_links(src, dealt.select("id", "digest", F.xxhash64("cluster").alias("cell"), blocks.alias("blocks")), shingle, percent)
    if several:
        links, found = found, components(found)
        discard(links)
    else:
        found = found.select(F.col("a").alias("node"), F.col("b").alias("component")).union(found.select("b", "b").distinct())
    if giant or dense is not None:
        of_giants = members.join(big.where(F.col("size") > WIDE * BLOCK), "cluster", "left_semi").select("digest")
        active = of_giants if dense is None else of_giants.union(dense).distinct()
        active = materialize(classes.join(active, "digest", "left_semi").select("digest", "id", "n", "sketch"), "active")
        inside = spans.join(of_giants.withColumnRenamed("digest", "a"), "a", "left_semi")
        found = _dense_links(src, active, inside, found, shingle, percent)
        discard(active)
    discard(spans), discard(members)
    member = classes.select("digest", "id").join(found, F.col("digest") == F.col("node")).drop("node")
    member = materialize(member, "linked", n_classes)
    first = member.groupBy("component").agg(F.min("id").alias("first"))
    named = join_unique(member, first, "component").select("digest", F.col("first").alias("of"))
    names = classes.select("digest", F.col("id").alias("own")).join(named, "digest", "left")
    names = materialize(names.select("digest", F.coalesce("of", "own").alias("component_id")), "names", n_classes)
    discard(member), discard(classes)
    some, none = signed.where("digest is not null"), signed.where("digest is null")
    out = join_unique(some.select("id", "h", "n", "digest"), names, "digest").drop("digest")
    out = few_tasks(out.unionByName(none.select("id", "h", "n", F.col("id").alias("component_id"))), n_rows)
    kept = F.col("id").isNull() | F.col("id").eqNullSafe(F.col("component_id"))
    return out.select("id", "h", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The documents, all columns, with one of each group: the one with the least id."""
    groups = materialize(near_duplicate_groups(docs, id_col, text_col, **parameters), "groups")
    gone = groups.where("not kept").select(F.col("id").alias("_id"), F.col("h").alias("_h")).distinct()
    n, size = gone.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col("_id").cast("string"))), F.lit(0))).first()
    gone = F.broadcast(gone) if 64 * n + size <= MAX_BROADCAST else gone
    left = docs.join(gone, (col(id_col) == F.col("_id")) & (F.xxhash64(col(text_col)) == F.col("_h")), "left_anti")
    twice = groups.where("kept and n_shingles > 0 and id is not null").groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1")
    if twice.limit(1).count():  # rows that repeat with their id
        empty = F.size(F.filter(F.split(F.coalesce(col(text_col), F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")) == 0
        left = left.where(~empty & col(id_col).isNotNull()).dropDuplicates([id_col]).unionAll(left.where(empty | col(id_col).isNull()))
    return left
