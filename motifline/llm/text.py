"""Shared text helpers: Arrow batch mapping, byte-wise words, cached subword ids."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A-Z to a-z, ASCII letters and digits and all bytes of non-ASCII characters kept, the rest to a space.
ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII characters."""
    return text.translate(ALNUM).split()


def space_words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs without space, tab, newline, vertical tab, form feed and return."""
    return text.lower().split()


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def col(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(name: str, taken: Sequence[str]) -> str:
    """``name``, with underscores added until no column has it (names compare without case)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def map_batches(
    df: DataFrame, inputs: Sequence[str], fields: Sequence[tuple[str, str]], factory: Callable, carry: Sequence[str]
) -> DataFrame:
    """Columns ``carry`` as they are, then ``fields`` (name, SQL type) computed from ``inputs`` batch by batch.

    ``factory()`` runs once a task and returns a function from Arrow arrays to a list of Arrow arrays.
    Columns travel under positional names, so that no extra column can clash; a result whose name is
    carried already gets underscores.
    """
    nc = len(carry)
    src = df.select(
        *[col(c).alias(f"c{i}") for i, c in enumerate(carry)], *[col(c).alias(f"i{i}") for i, c in enumerate(inputs)]
    )
    schema = T.StructType(
        [T.StructField(f"c{i}", src.schema[i].dataType) for i in range(nc)]
        + [T.StructField(f"r{i}", T._parse_datatype_string(kind)) for i, (_, kind) in enumerate(fields)]
    )
    names = schema.names

    def run(batches):
        fn = factory()
        for b in batches:
            out = fn(*b.columns[nc:])
            yield pa.RecordBatch.from_arrays([*b.columns[:nc], *out], names)

    final = list(carry)
    for name, _ in fields:
        final.append(fresh(name, final))
    return src.mapInArrow(run, schema).toDF(*final)


def runs(batches, keys: list[str]):
    """Tables of consecutive rows with equal ``keys``, one at a time."""
    rest = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t])
        k = np.stack([t[c].to_numpy() for c in keys])
        cuts = [0, *(1 + np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0))).tolist()]
        for lo, hi in zip(cuts, cuts[1:]):
            yield t.slice(lo, hi - lo)
        rest = t.slice(cuts[-1])
    if rest is not None:
        yield rest


#: The pre-tokenizer's pattern for ASCII text: contractions, letter runs, single digits, runs of the rest.
_ASCII_PIECE = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
#: Letters that lower-case and compose to themselves, one pre-token if nothing else is in a word.
_LATIN = re.compile("[a-zß-öø-ÿ]+")
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_TAIL = re.compile(rb"[!-/:-@\[-`{-~]+\Z")


def _byte_symbols() -> list[str]:
    """The symbol of each byte in byte-level vocabularies: itself if printable, else the next from 256 on."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in kept else next(spare)) for b in range(256)]


_SYMBOLS = _byte_symbols()


def _symbols(text: str) -> str:
    return "".join([_SYMBOLS[b] for b in text.encode()])


class WordIds(dict):
    """Whitespace-delimited lower-cased word -> its subword ids as little-endian unsigned 32-bit bytes.

    For tokenizers that drop white space, lower-case and never join across it, so a text's ids are its
    words' ids one after the other. Two levels: whole words, and the pieces that the pre-tokenizer makes
    of them, which repeat far more. Each level keeps two generations of ``limit`` entries: when the younger is
    full the older goes, so entries in use stay.
    """

    def __init__(self, path: str, limit: int = 125_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.pieces: dict[bytes, bytes] = {}
        self.old_pieces: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.limit = limit

    def _piece(self, piece: bytes) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            got = self.old_pieces.get(piece)
            if got is None:
                got = self._merged(piece)
            if len(piece) <= 64:
                if len(self.pieces) >= self.limit:
                    self.old_pieces, self.pieces = self.pieces, {}
                self.pieces[piece] = got
        return got

    def _merged(self, piece: bytes) -> bytes:
        if piece.isalpha():  # a-z
            return array("I", [t.id for t in self.model.tokenize(piece.decode())]).tobytes()
        text = piece.decode("utf-8", "replace").lower()
        if _LATIN.fullmatch(text):  # one pre-token in lower case: straight to the merges
            ids = [t.id for t in self.model.tokenize(_symbols(text))]
        else:
            ids = self.tokenizer.encode(piece.decode("utf-8", "replace"), add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        got = self.old.get(word)
        if got is None:
            got = self._word(word)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[word] = got
        return got

    def _word(self, word: bytes) -> bytes:
        stem = word.rstrip(_PUNCTUATION)
        if stem.isalpha():  # letters, then punctuation: no contraction
            return self._piece(stem) + self._piece(word[len(stem) :]) if len(stem) < len(word) else self._piece(word)
        if not word.isascii():
            # a run of ASCII punctuation after an ASCII letter or digit is a piece of its own; else keep the word whole
            m = _TAIL.search(word)
            if m and word[m.start() - 1 : m.start()].isalnum() and b"'" not in m[0]:
                return self._piece(word[: m.start()]) + self._piece(m[0])
            return self._piece(word)
        return b"".join(map(self._piece, _ASCII_PIECE.findall(word)))

    def of_each(self, words: list[bytes]) -> list[bytes]:
        """Ids of each of many lower-cased words; those of letters and punctuation are kept by piece only."""
        out, get = [], self.pieces.get
        for word in words:
            got = get(word) if word.isalpha() else None
            if got is None:
                stem = word.rstrip(_PUNCTUATION)
                if stem.isalpha():
                    got = get(stem)
                    if got is None:
                        got = self._piece(stem)
                        get = self.pieces.get
                    if len(stem) < len(word):
                        got += self._piece(word[len(stem) :])
                        get = self.pieces.get
                else:
                    got = self[word]
                    get = self.pieces.get
            out.append(got)
        return out

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.lower().split()))


_WORD_IDS: dict[tuple[str, int], WordIds] = {}


def word_ids(path: str, limit: int = 125_000) -> WordIds:
    """One cache for each worker process, tokenizer file and size."""
    if (path, limit) not in _WORD_IDS:
        _WORD_IDS[path, limit] = WordIds(path, limit)
    return _WORD_IDS[path, limit]


def forget_words() -> None:
    """Empties the caches of this process, which Spark uses again for stages that need none."""
    _WORD_IDS.clear()
    pa.default_memory_pool().release_unused()
