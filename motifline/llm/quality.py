"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

A document is the set of its hashed features: lower-cased words, the first five bytes of longer words
(stems), runs of punctuation, and coarse shares (capitals, punctuation, repeated lines). One weight a
feature, shared by all grades, gives a score s; ordered thresholds t_1 < ... < t_K give
P(grade >= k) = sigmoid(s - t_k). From them follow the expected grade and the tail probability by which
documents are selected.

The model is fitted on at most ``MAX_TRAIN`` labelled documents (those with the least hash of their id);
every document is scored whole, in one map without a shuffle.

Edge cases: null and empty texts have only the shares as features. Labels without an id or a grade are
left out; of repeated labels the least grade counts, of repeated documents one is fitted on. Without labelled rows nothing is known and every
document is kept with tail probability 1. Extra columns are never read; repeated rows are scored alike.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifline.llm.text import alnum_words, col, map_batches, texts

BITS = 20
#: Labelled documents to fit on at most, and documents that a feature must occur in there.
MAX_TRAIN, MIN_DOCUMENTS = 12_000, 4
_PUNCTUATION = re.compile(rb"[!-/:-@\[-`{-~]{2,4}|\|")
_CAPITALS = bytes(c for c in range(256) if not 65 <= c <= 90)
_LETTERS = bytes(c for c in range(256) if not (65 <= c <= 90 or 97 <= c <= 122))
_MASK = (1 << BITS) - 1


class _Features(dict):
    """Word -> its own feature and that of its stem."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        got = (xxhash.xxh32_intdigest(b"w" + word) & _MASK,)
        if len(word) > 5:
            got += (xxhash.xxh32_intdigest(b"s" + word[:5]) & _MASK,)
        if len(word) <= 64:
            if len(self) >= 250_000:
                self.clear()
            self[word] = got
        return got


_CACHE = _Features()


def features(text: bytes) -> np.ndarray:
    """The distinct features of a text."""
    found: set[int] = set()
    for word in set(alnum_words(text)):
        found.update(_CACHE[word])
    marks = _PUNCTUATION.findall(text)
    lines = [x for x in text.split(b"\n") if x]
    letters = len(text.translate(None, _LETTERS))
    capitals = len(text.translate(None, _CAPITALS))
    shares = (
        (b"capitals", 8 * capitals // max(1, letters)),
        (b"marks", min(9, 40 * len(marks) // max(1, text.count(b" ")))),
        (b"lines", 8 * (len(lines) - len(set(lines))) // max(1, len(lines))),
    )
    for mark in set(marks):
        found.add(xxhash.xxh32_intdigest(b"p" + mark) & _MASK)
    for name, share in shares:
        found.add(xxhash.xxh32_intdigest(b"%s%d" % (name, share)) & _MASK)
    return np.fromiter(found, np.int32, len(found))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, top: int, steps: int = 150, rate: float = 0.05, ridge: float = 2e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ``top`` ordered thresholds by Adam on the negative log likelihood, grades weighted evenly."""
    size = np.array([len(r) for r in rows])
    index = np.concatenate(rows)
    enough = np.bincount(index, minlength=1 << BITS) >= min(MIN_DOCUMENTS, max(1, len(rows) // 50))
    used = np.flatnonzero(enough)
    place = np.full(1 << BITS, -1, np.int64)
    place[used] = np.arange(len(used))
    owner = np.repeat(np.arange(len(rows)), size)
    keep = place[index] >= 0
    index, owner = place[index[keep]], owner[keep]
    n, count = len(rows), np.bincount(grades, minlength=top + 1)
    weight = (n / np.maximum(count, 1) / max(1, (count > 0).sum()))[grades] ** 0.5
    above = grades[:, None] > np.arange(top)  # y >= k, for k = 1..top
    w, base, gaps = np.zeros(len(used)), np.array(-5.0), np.zeros(max(0, top - 1))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, base, gaps)]
    for t in range(1, steps + 1):
        cut = base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        p = sigmoid(np.bincount(owner, w[index], n)[:, None] - cut)
        # P(y) is a difference of neighbouring tails; its gradient by each tail
        tail = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], 1)
        row = np.arange(n)
        prob = np.maximum(tail[row, grades] - tail[row, grades + 1], 1e-12)
        d = np.zeros((n, top + 2))
        d[row, grades] -= 1 / prob
        d[row, grades + 1] += 1 / prob
        dz = d[:, 1:-1] * p * (1 - p) * (weight / n)[:, None]
        dcut = -dz.sum(0)
        grads = [
            np.bincount(index, dz.sum(1)[owner], len(used)) + ridge * w,
            np.array(dcut.sum()),
            np.array([dcut[i + 1 :].sum() for i in range(top - 1)]) * np.exp(gaps) if top > 1 else gaps,
        ]
        new = []
        for value, g, (m, s) in zip((w, base, gaps), grads, state):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            new.append(value - rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8))
        w, base, gaps = new[0], np.asarray(new[1]), new[2]
    full = np.zeros(1 << BITS, np.float32)
    full[used] = w
    return full, base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def fit(docs: DataFrame, labels: DataFrame, grade: Column, top: int, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id"):
    """A model (weights, thresholds) from labelled documents; None without any.

    ``grade``: 0 to ``top`` from the columns of ``labels``. Only ids (at most MAX_TRAIN) are broadcast and
    only features of these documents come to the driver.
    """
    rated = labels.select(col(label_id).alias("_id"), grade.cast("int").alias("_grade")).where("_id is not null and _grade is not null")
    rated = rated.groupBy("_id").agg(F.min("_grade").alias("_grade"))
    chosen = rated.orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").limit(MAX_TRAIN)
    src = docs.select(col(id_col).alias("_id"), col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")

    def run(batches):
        for b in batches:
            got = [features(t).tobytes() for t in texts(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.binary())], ["_id", "_grade", "f"])

    kind = src.schema["_id"].dataType.simpleString()
    found = src.select("_id", "_grade", "_text").mapInArrow(run, f"_id {kind}, _grade int, f binary")
    rows = found.groupBy("_id").agg(F.min("_grade").alias("_grade"), F.min("f").alias("f")).collect()  # <= MAX_TRAIN rows
    if not rows:
        return None
    rows.sort(key=lambda r: r["_id"])
    return fit_ordinal([np.frombuffer(r["f"], np.int32) for r in rows], np.array([r["_grade"] for r in rows]), top)


def grade_documents(docs: DataFrame, model, carry: list[str], text_col: str = "text", keep: int | None = None, least: float = 0.3) -> DataFrame:
    """Columns ``carry`` plus expected_grade, p_tail (of grade ``keep`` or more; the top grade if None), tails and accepted."""

    def factory():
        def run(text):
            if model is None:
                n = len(text)
                return [pa.array([None] * n, pa.float64()), pa.array([1.0] * n), pa.array([[]] * n, pa.list_(pa.float64())), pa.array([True] * n)]
            weights, cut = model
            s = np.array([weights[features(t)].sum(dtype=np.float64) for t in texts(text)])
            p = sigmoid(s[:, None] - cut)
            tail = p[:, (len(cut) if keep is None else keep) - 1]
            return [pa.array(p.sum(1)), pa.array(tail), pa.array(p.tolist(), pa.list_(pa.float64())), pa.array(tail >= least)]

        return run

    return map_batches(docs, [text_col], [("expected_grade", "double"), ("p_tail", "double"), ("tails", "array<double>"), ("accepted", "boolean")], factory, carry)


def select_documents(docs: DataFrame, model, text_col: str = "text", **parameters) -> DataFrame:
    """The documents, all columns, that the classifier accepts."""
    graded = grade_documents(docs, model, docs.columns, text_col, **parameters)
    return graded.where(col(graded.columns[-1])).select(*[col(c) for c in docs.columns])


def rating(quality: str = "quality", toxic: str = "toxic") -> Column:
    """Grades of the labels table: 0 toxic, 1 poor, 2 good; null without a quality."""
    return F.when(F.coalesce(col(toxic), F.lit(0)) == 1, 0).when(col(quality) == 0, 1).when(col(quality) == 1, 2)
