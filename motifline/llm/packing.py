"""Best-fit packing by bin completion over the histogram of piece lengths.

A packing plan needs only how many pieces there are of each length, at most ``capacity`` numbers however
large the corpus. The driver plans on that histogram; a plan is a list of fillings, each with the number
of sequences that use it. Executors give every piece its rank among the pieces of its length and look up
the sequence and the place that the plan has for this rank. No text or token leaves its partition.

Bin completion: the largest length left is placed, the undominated fillings of the space beside it are
enumerated, of each ``CHUNK`` the least waste first; a branch whose waste exceeds what the incumbent allows is pruned.
A filling is dominated if a piece that is left could take the place of some of its pieces that are together no
longer, and still fit. The best-fit-decreasing packing is the first incumbent. The search is complete: it ends at
the lower bound on sequences, when no branch is left, or after ``steps`` steps of enumeration and search, a limit on
the driver's time beyond which the incumbent is returned, valid and whole but perhaps not the least.

Edge cases: a null text is an empty one; every document has at least its end token. Repeated rows are
packed as often as they occur. An empty table gives an empty result. Extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motifline.llm.text import col, texts, word_ids
from motifline.session import few_tasks, materialize

Filling = tuple[tuple[int, int], ...]  # (length, how many), longest first
Plan = list[tuple[Filling, int]]  # filling, number of sequences


def best_fit_decreasing(hist: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing on runs of equal lengths: each into the open sequences with the least space."""
    space: dict[int, list[list]] = {}  # space left -> [filling, number of sequences]
    for length in sorted(hist, reverse=True):
        left = hist[length]
        while left:
            fit = min((r for r in space if r >= length), default=None)
            if fit is None:
                per = capacity // length
                for n, k in ((left // per, per), (1, left % per)):
                    if n and k:
                        space.setdefault(capacity - k * length, []).append([((length, k),), n])
                break
            group = space[fit][-1]
            n = min(left, group[1])
            filling = group[0]
            grown = (*filling[:-1], (length, filling[-1][1] + 1)) if filling[-1][0] == length else (*filling, (length, 1))
            group[1] -= n
            if not group[1]:
                space[fit].pop()
                if not space[fit]:
                    del space[fit]
            space.setdefault(fit - length, []).append([grown, n])
            left -= n
    return [(f, n) for groups in space.values() for f, n in groups]


#: Undominated fillings that are put in the order of their waste at a time.
CHUNK = 64


def dominated(filling: Filling, hist: dict[int, int], room: int) -> bool:
    """Whether a piece that ``filling`` leaves out could replace some (or none) of its pieces that are together no longer."""
    waste = room - sum(n * k for n, k in filling)
    one, more = 0, 0  # sums of one piece and of several pieces, as bits
    for n, k in filling:
        for _ in range(k):
            more |= (one | more) << n
            one |= 1 << n
    used = dict(filling)
    for x, count in hist.items():
        if count > used.get(x, 0) and x <= room:
            low = max(1, x - waste)
            if x <= waste or ((one | more) >> low) & ((1 << (x - low)) - 1) or more >> x & 1:
                return True
    return False


def fillings(hist: dict[int, int], room: int, spend) -> Iterator[tuple[int, Filling]]:
    """(waste, filling) of the undominated fillings of ``room``; ``spend()`` counts a step and tells whether to go on."""
    lengths = sorted((n for n, c in hist.items() if c and n <= room), reverse=True)

    def maximal(i: int, left: int, chosen: Filling) -> Iterator[Filling]:
        """Fillings that go on with lengths from the ``i`` th on, and take one if any fits: others are dominated."""
        while i < len(lengths) and lengths[i] > left:
            i += 1
        if i == len(lengths):
            yield chosen
        for j in range(i, len(lengths)):
            n = lengths[j]
            for k in range(min(hist[n], left // n), 0, -1):
                if not spend():
                    return
                yield from maximal(j + 1, left - k * n, (*chosen, (n, k)))

    chunk: list[tuple[int, Filling]] = []
    for filling in maximal(0, room, ()):
        if not dominated(filling, hist, room):
            chunk.append((room - sum(n * k for n, k in filling), filling))
        if len(chunk) == CHUNK:
            yield from sorted(chunk, key=lambda x: (x[0], sum(k for _, k in x[1])))
            chunk = []
    yield from sorted(chunk, key=lambda x: (x[0], sum(k for _, k in x[1])))


def plan_sequences(hist: dict[int, int], capacity: int, steps: int = 200_000) -> Plan:
    """Fillings and how many sequences use each; see the module for the method."""
    hist = {n: c for n, c in hist.items() if c > 0}
    total = sum(n * c for n, c in hist.items())
    lower = max(-(-total // capacity), sum(c for n, c in hist.items() if 2 * n > capacity))
    best = best_fit_decreasing(hist, capacity)
    bins, left_steps = sum(n for _, n in best), steps

    def spend() -> bool:
        nonlocal left_steps
        left_steps -= 1
        return left_steps > 0

    def branches(left: dict[int, int]) -> Iterator[tuple[int, Filling, int]]:
        """(waste, sequence, how many alike): as many as there are pieces for, and else one at a time."""
        largest = max(left)
        rest = {n: c - (n == largest) for n, c in left.items()}
        for lost, filling in fillings(rest, capacity - largest, spend):
            whole = {largest: 1}
            for n, k in filling:
                whole[n] = whole.get(n, 0) + k
            times = min(left[n] // k for n, k in whole.items())
            for t in (times, 1)[: 1 + (times > 1)]:
                yield lost, tuple(sorted(whole.items(), reverse=True)), t

    # a level: its branches, and what is left, the waste and the sequences before them
    stack = [(branches(hist), hist, 0, 0)] if hist else []
    path: Plan = []
    while stack and bins > lower and spend():
        options, left, waste, used = stack[-1]
        step = next(options, None)
        if step is None:
            stack.pop()
            path = path[:-1]
            continue
        lost, whole, times = step
        if waste + times * lost > (bins - 1) * capacity - total:
            continue
        after = {n: c for n, c in ((n, c - times * dict(whole).get(n, 0)) for n, c in left.items()) if c}
        if not after:
            if used + times < bins:
                bins, best = used + times, [*path, (whole, times)]
            continue
        path = [*path, (whole, times)]
        stack.append((branches(after), after, waste + times * lost, used + times))
    return best


def lookup(plan: Plan) -> dict[str, np.ndarray]:
    """The plan by length and rank: from which rank on, how many sequences, which one, at which offset."""
    rows, taken, base = [], {}, 0
    for filling, n in plan:
        offset = 0
        for length, k in filling:
            first = taken.get(length, 0)
            rows.append(((length << 40) + first, n, base, offset))
            taken[length] = first + n * k
            offset += length * k
        base += n
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return dict(zip(("key", "n", "base", "offset"), table.T.copy()))


def tokenize_pieces(
    docs: DataFrame, tokenizer: str, capacity: int, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, cached: int = 125_000
) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: id, piece, start, length, ids (unsigned 32-bit little-endian).

    Each also has the partition that made it and its rank there among the pieces of its length.
    The result is written to the shared folder, so that both stay as they are.
    """
    src = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    names = ["id", "piece", "start", "length", "ids", "part", "place"]
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]):
        cache, part, seen = word_ids(tokenizer, cached), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for b in batches:
            index, piece, start, length, ids, place = [], [], [], [], [], []
            for row, text in enumerate(texts(b.column(1))):
                data = cache.encode(text) + end
                n = len(data) // 4
                for k in range(-(-n // capacity)):
                    size = min(capacity, n - k * capacity)
                    index.append(row)
                    piece.append(k)
                    start.append(k * capacity)
                    length.append(size)
                    ids.append(data[4 * k * capacity : 4 * (k * capacity + size)])
                    place.append(seen[size])
                    seen[size] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(index, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array([part] * len(index), pa.int32()),
                    pa.array(place, pa.int64()),
                ],
                names,
            )

    schema = f"id {kind}, piece int, start bigint, length bigint, ids binary, part int, place bigint"
    return materialize(src.mapInArrow(run, schema), "pieces")


def assign_sequences(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to rows with length, part and place (which are dropped).

    The rank of a piece among those of its length is its place in its partition plus the pieces of this
    length in the partitions before; a long run of equal lengths is thus never in one task.
    """
    rows = pieces.count()
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialize(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "lengths", rows)
    hist = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    table = lookup(plan_sequences(hist, capacity))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def at(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        i = np.searchsorted(table["key"], (size << 40) + r, side="right") - 1
        nth, seq = np.divmod(r - (table["key"][i] & ((1 << 40) - 1)), table["n"][i])
        return pd.DataFrame({"sequence_id": table["base"][i] + seq, "offset": table["offset"][i] + nth * size})

    ranked = pieces.join(counts.select("length", "part", "before"), ["length", "part"])
    placed = ranked.withColumn("_at", at(F.col("length"), F.col("place") + F.col("before")))
    keep = [c for c in pieces.columns if c not in ("part", "place")]
    return few_tasks(placed.select(*keep, "_at.sequence_id", "_at.offset"), rows)


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every piece with its tokens and its place: id, piece, start, length, ids, sequence_id, offset."""
    return assign_sequences(tokenize_pieces(docs, tokenizer, capacity, id_col, text_col), capacity)
