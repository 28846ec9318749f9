"""Count-only Viterbi segmentation with a unigram vocabulary.

An Aho-Corasick automaton enumerates every vocabulary piece that ends at a position, longest first;
dynamic programming keeps for each position the best score and the number of pieces on the way to it,
but no path. Ties follow the unigram tokenizer: paths are tried by ascending start and replaced only by
a strictly better score, a character that is no piece itself may be unknown at the lowest score less 10,
and neighbouring unknown characters are one token.

A word is a run without ASCII white space, with the meta space U+2581 before it unless it starts with
one; words are segmented one by one and their counts are cached.

Edge cases: null and empty texts have no tokens, score 0. Very long words take linear time and are not
cached. Extra columns are never read; repeated rows each get their result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from motifline.llm.text import map_batches, texts

META = "▁"
UNKNOWN_PENALTY = 10.0
#: Punctuation that ends words; cut off where no piece can span the cut, so that more words are alike.
TAIL = ".,;:!?*#%$&"


def unigram_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a public piece model: entry 0 is the unknown piece; control and byte pieces are left out."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    out = [("<unk>", 0.0)]
    for i in range(m.get_piece_size()):
        if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)):
            out.append((m.id_to_piece(i), float(m.get_score(i))))
    return out


class Counter(dict):
    """Word (UTF-8 bytes) -> (tokens, unknown tokens, score)."""

    def __init__(self, vocabulary: list[tuple[str, float]], limit: int = 400_000):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary[1:]:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in vocabulary[1:] if len(p) == 1}
        self.pairs = {p[i : i + 2] for p, _ in vocabulary[1:] for i in range(len(p) - 1)}
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.parts: dict[str, tuple[int, int, float]] = {}
        self.limit = limit

    def segment(self, text: str) -> tuple[int, int, float]:
        ends: dict[int, list[tuple[int, float]]] = {}
        for end, match in self.automaton.iter(text):
            ends.setdefault(end, []).append(match)
        unknown = self.unknown
        score, count, odd, last = [0.0], [0], [0], [False]  # by position; last: ends in an unknown piece
        for end in range(len(text)):
            best, start, size = None, 0, 0
            for size, worth in ends.get(end, ()):  # longest first: ascending start
                got = score[end + 1 - size] + worth
                if best is None or got > best:
                    best, start = got, end + 1 - size
            if size != 1 and (best is None or score[end] + unknown > best):
                new = not last[end]
                score.append(score[end] + unknown)
                count.append(count[end] + new)
                odd.append(odd[end] + new)
                last.append(True)
            else:
                score.append(best)
                count.append(count[start] + 1)
                odd.append(odd[start])
                last.append(False)
        return count[-1], odd[-1], score[-1]

    def _apart(self, a: str, b: str) -> bool:
        """Whether no piece holds ``ab`` and neither can be unknown: then a best path always ends between them."""
        return a + b not in self.pairs and a in self.single and b in self.single

    def part(self, text: str) -> tuple[int, int, float]:
        got = self.parts.get(text)
        if got is None:
            got = self.segment(text)
            if len(text) <= 64:
                if len(self.parts) >= self.limit:
                    self.parts.clear()
                self.parts[text] = got
        return got

    def __missing__(self, word: bytes) -> tuple[int, int, float]:
        text = word.decode("utf-8", "replace")
        text = text if text[0] == META else META + text
        core = text.rstrip(TAIL)
        if 1 < len(core) < len(text) and self._apart(core[-1], text[len(core)]):
            a, b = self.part(core), self.part(text[len(core) :])
            got = (a[0] + b[0], a[1] + b[1], a[2] + b[2])
        else:
            got = self.part(text)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = got
        return got


_COUNTERS: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, model: str, carry: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``carry`` plus n_tokens, n_unknown and score (of the best segmentation)."""

    def factory():
        if model not in _COUNTERS:
            _COUNTERS[model] = Counter(unigram_vocabulary(model))
        counter = _COUNTERS[model]

        def run(text):
            n, odd, score = [], [], []
            for t in texts(text):
                got = [counter[w] for w in t.split()]
                n.append(sum(x[0] for x in got))
                odd.append(sum(x[1] for x in got))
                score.append(sum(x[2] for x in got))
            return [pa.array(n, pa.int64()), pa.array(odd, pa.int64()), pa.array(score, pa.float64())]

        return run

    return map_batches(
        docs, [text_col], [("n_tokens", "bigint"), ("n_unknown", "bigint"), ("score", "double")], factory, carry
    )
