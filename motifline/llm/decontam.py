"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Test strings are windows of ``window`` consecutive words of a benchmark item; an item of fewer words,
but not none, is one shorter string. Strings of one length share a searcher: a shift table over blocks
of words tells how far the search may jump, the bucket of the block that ends a string (and of its
first word) names the strings to try, and direct comparison confirms an occurrence.

Edge cases: null and empty texts have no words and are never hit. A benchmark row without an id still
marks words, but counts as no item. Repeated benchmark rows count once, repeated document rows each get
their own result. An empty benchmark hits nothing. Extra columns are never read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from motifline.llm.text import alnum_words, col, fresh, map_batches, texts

#: Benchmark bytes that one pass searches for; more is searched in further passes over the documents.
MAX_PASS_BYTES = 16 << 20


class WuManber:
    """Finds all occurrences of word strings of one length."""

    def __init__(self, length: int, owners: dict[tuple[bytes, ...], set[int]], block: int = 3):
        self.m, self.b = length, min(block, length)
        self.default = self.m - self.b + 1
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[tuple[bytes, bytes], list[tuple[list[bytes], frozenset]]] = {}
        for words, own in owners.items():
            for end in range(self.b, self.m + 1):
                key, jump = b" ".join(words[end - self.b : end]), self.m - end
                if jump < self.shift.get(key, self.default):
                    self.shift[key] = jump
            suffix = b" ".join(words[self.m - self.b :])
            self.buckets.setdefault((suffix, words[0]), []).append((list(words), frozenset(own)))

    def search(self, words: list[bytes]):
        """Yields (start, owners) of every occurrence."""
        m, b, default, shift, buckets, join = self.m, self.b, self.default, self.shift, self.buckets, b" ".join
        i, n = m, len(words)  # i: end of the position under test
        while i <= n:
            key = join(words[i - b : i])
            jump = shift.get(key, default)
            if jump:
                i += jump
                continue
            for pattern, own in buckets.get((key, words[i - m]), ()):
                if words[i - m : i] == pattern:
                    yield i - m, own
            i += 1


def build(items: list[tuple[int | None, bytes]], window: int) -> list[WuManber]:
    """A searcher for each string length that occurs among the items."""
    by_length: dict[int, dict[tuple[bytes, ...], set[int]]] = {}
    for item, text in items:
        words = alnum_words(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1) if size else ():
            own = by_length.setdefault(size, {}).setdefault(tuple(words[i : i + size]), set())
            if item is not None:
                own.add(item)
    return [WuManber(size, owners) for size, owners in sorted(by_length.items())]


def scan(searchers: list[WuManber], words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
    """Merged word spans [start, end) inside occurrences, and the items that occur."""
    spans, found = [], set()
    for s in searchers:
        for start, own in s.search(words):
            spans.append((start, start + s.m))
            found |= own
    return merge(spans), found


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_FIELDS = [("n_words", "bigint"), ("spans", "array<struct<start:int,end:int>>"), ("items", "array<{}>")]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    carry: list[str],
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
) -> DataFrame:
    """Columns ``carry`` plus n_words, spans (hit words) and items (sorted as strings), one row a document.

    The benchmark is read in blocks of about ``MAX_PASS_BYTES``; each block is one map over the documents
    that adds its hits to those before, so no benchmark size needs more memory and nothing is shuffled.
    """
    bench = benchmark.select(
        col(item_col).alias("item"), F.coalesce(col(item_text_col), F.lit("")).alias("text")
    ).distinct()
    kind = bench.schema["item"].dataType
    fields = [t.format(kind.simpleString()) for _, t in _FIELDS]
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // MAX_PASS_BYTES))
    names: list[str] = []
    for name, _ in _FIELDS:
        names.append(fresh(name, [*docs.columns, *names]))
    base = list(dict.fromkeys([*carry, text_col])) if blocks > 1 else list(carry)
    out = docs
    for k in range(blocks):
        rows = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()
        items = [(r["item"], r["text"].encode()) for r in rows]
        inputs, seen = ([text_col, *names[1:]], base) if k else ([text_col], base)
        out = map_batches(out, inputs, list(zip(names, fields)), _searcher(items, window, to_arrow_type(kind)), seen).toDF(*base, *names)
    final = out.select(*[col(c) for c in carry], *[col(n) for n in names])
    return final.toDF(*carry, *[fresh(n, carry) for n, _ in _FIELDS])


def _searcher(items: list[tuple[object, bytes]], window: int, kind: pa.DataType):
    def factory():
        searchers = build(items, window)

        def run(text, spans=None, own=None):
            n, hits, found = [], [], []
            before = zip(spans.to_pylist(), own.to_pylist()) if spans is not None else iter(lambda: ([], []), None)
            for t, (old, ids) in zip(texts(text), before):
                words = alnum_words(t)
                got, items_got = scan(searchers, words)
                n.append(len(words))
                hits.append([{"start": a, "end": b} for a, b in merge([*got, *((s["start"], s["end"]) for s in old)])])
                found.append(sorted({*items_got, *ids}, key=str))
            return [pa.array(n, pa.int64()), pa.array(hits, pa.list_(_SPAN)), pa.array(found, pa.list_(kind))]

        return run

    return factory


def n_hit(spans) -> F.Column:
    """Words inside spans."""
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda s, x: s + (x["end"] - x["start"]))


def is_contaminated(hit, words) -> F.Column:
    """Some word is hit, and at least one in twenty."""
    return (hit > 0) & (20 * hit >= words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents, all columns, without the contaminated ones."""
    found = find_contamination(docs, benchmark, docs.columns, text_col)
    words, spans = found.columns[-3], found.columns[-2]
    return found.where(~is_contaminated(n_hit(col(spans)), col(words))).select(*[col(c) for c in docs.columns])
