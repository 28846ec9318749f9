"""Surrogates for personal data and secrets: keyed, type-consistent, distinct and coreferent.

Detected entities are replaced by a keyed permutation of the entity's own format class, so one entity
always gets one surrogate, in every document, and two entities never share one; no table of entities is
gathered and nothing is shuffled. Digits stay digits, letters keep case and script, punctuation stays.

* email, phone, ip, card, key, secret: the characters are numbers in a mixed radix given by their
  classes; a Feistel network over that range, walked on until the value is in range, permutes them. A
  card with a valid check digit gets a valid one. After each step the surrogate must be detected as the
  same type again, else the walk goes on (the collision check between types).
* person: found by structure: a title or a known given name before capitalised words and initials, or, within a
  sentence, two initials before a name. Every name in it has its own surrogate: a known given name goes to the next one of its gender and
  script in a keyed order, other names are permuted letter by letter, vowels to vowels and consonants to consonants,
  initials likewise, titles stay. Other mentions in the text of a name that was found so get the same surrogate
  ("Anna Kowalski ... Anna said"). Names that nothing of this marks are not found.
* card: only numbers with a valid check digit and an issuer's first digits; others are ordinary numbers.

Small ranges (under 1,000 values) are shifted along a keyed order, so that no value stays as it is.
:func:`collisions` checks the whole mapping of a corpus.

Edge cases: null texts stay null and have no entities, empty ones stay empty; repeated rows are treated
alike. Extra columns are kept as they are.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifline.llm.text import col, fresh, map_batches

# Given names by script and gender.
GIVEN_NAMES = {
    ("latin", "f"): "Alice Amelie Anna Brigitte Carmen Claire Elena Emma Greta Helga Ingrid Isabel Julia Karen Laura Linda Lucia Maria Marie Martha Mary Nadia Olivia Paula Petra Rosa Sabine Sarah Sofia Ursula".split(),
    ("latin", "m"): "Adam Albert Carlos Charles David Diego Edward Felix Frank George Hans Henri Hugo James Jean John Jorge Karl Klaus Louis Marc Martin Michael Miguel Pablo Paul Peter Pierre Robert Thomas".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Ирина Мария Наталья Ольга Светлана Татьяна Юлия".split(),
    ("cyrillic", "m"): "Алексей Андрей Борис Виктор Владимир Дмитрий Иван Николай Олег Павел Сергей Юрий".split(),
}
# Titles that are followed by a family name.
TITLES = "Mr Mrs Ms Miss Sir Dr Prof Herr Frau Monsieur Madame Señor Señora".split()
# First digits of card numbers by issuer.
ISSUERS = ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "34", "37", "30", "35", "36", "38", "50", "56", "57", "58", "60", "62", "63", "64", "65", "67")
# Alphabets whose letters are exchanged with each other.
ALPHABETS = [
    "0123456789",
    "aeiou",
    "bcdfghjklmnpqrstvwxyz",
    "AEIOU",
    "BCDFGHJKLMNPQRSTVWXYZ",
    "аеиоуыэюя",
    "бвгджзйклмнпрстфхцчшщ",
    "АЕИОУЭЮЯ",
    "БВГДЖЗКЛМНПРСТФХЦЧШЩ",
    "áàâäéèêëíìîïóòôöúùûü",
    "ÁÀÂÄÉÈÊËÍÌÎÏÓÒÔÖÚÙÛÜ",
]
_NAME_CLASS = {c: a for a in ALPHABETS for c in a}
_LETTER_CLASS = {c: a for a in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", *ALPHABETS[5:]) for c in a}
_GIVEN = {name: group for group, names in GIVEN_NAMES.items() for name in names}

TYPES = ("email", "phone", "ip", "card", "key", "secret", "person")
_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_KEY = re.compile(r"A[KS]IA[A-Z0-9]{16}(?!\w)|gh[pousr]_[A-Za-z0-9]{36}(?!\w)|sk-[A-Za-z0-9]{20,}(?!\w)")
_SECRET = re.compile(r'[=:]\s?"?[A-Za-z0-9+/_-]{8,}"?')
_SECRET_NAME = re.compile(r"(?:password|passwd|secret|token|api_?key)\s?\Z", re.I)
_SECRET_HEAD = re.compile(r'(?:password|passwd|secret|token|api_?key)\s?[=:]\s?"?', re.I)
_PHONE = re.compile(
    r"\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\w)|\(\d{3}\) ?\d{3}-\d{4}(?!\w)"
    r"|\+(?!1\D)\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\w|[.-]\d)"
)
_IP = re.compile(r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w.]*\w)")
_CARD = re.compile(r"\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}(?![\w-]*\w)")
_CAPITAL = "[A-ZÀ-ÖØ-ÞА-ЯЁ]"
_NAME = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]+(?:-[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]+)?"
_WHOLE_NAME = re.compile(_NAME)
_TOKEN = rf"(?:(?:{'|'.join(TITLES)})\.(?= )|[A-ZÀ-ÖØ-ÞА-ЯЁ]\.|{_NAME}(?!\w))"
_RUN = re.compile(rf"(?={_CAPITAL}\S* {_CAPITAL}){_TOKEN}(?: {_TOKEN})+")  # most words fail at the lookahead
#: Shortest name of which other mentions are looked for.
MENTIONED = 3


def _inside(text: str, at: int) -> bool:
    """Whether ``at`` is within a sentence: at its start a capital with a full stop may be a sentence of one letter."""
    return at > 1 and text[at - 1] == " " and text[at - 2] not in ".!?:\n"


def _persons(text: str):
    """Spans of persons within runs of capitalised words, titles and initials."""
    for run in _RUN.finditer(text):
        if not _starts(text, run.start(), "_"):
            continue
        tokens = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^ ]+", run[0])]
        i = 0
        while i < len(tokens) - 1:
            word, rest = tokens[i][2], tokens[i + 1 :]
            initial = word[-1] == "." and word[:-1] not in TITLES
            if word.rstrip(".") in TITLES or word in _GIVEN:
                end = len(rest) if len(rest) <= 3 else next((k + 1 for k, t in enumerate(rest) if t[2][-1] != "."), 0)
            elif initial and len(rest) > 1 and rest[0][2][-1] == "." and rest[0][2][:-1] not in TITLES and _inside(text, run.start() + tokens[i][0]):
                end = next((k + 1 for k, t in enumerate(rest) if t[2][-1] != "."), 0)
            else:
                end = 0
            while end and rest[end - 1][2][-1] == ".":  # a name comes last
                end -= 1
            if end:
                yield run.start() + tokens[i][0], run.start() + rest[end - 1][1]
            i += 1 + end


def _mentions(text: str, spans: list[tuple[int, int, str]]):
    """Other places of the names in the ``person`` spans."""
    names = {w for a, b, kind in spans if kind == "person" for w in text[a:b].split(" ") if len(w) >= MENTIONED and w[-1] != "." and w not in TITLES}
    if names:
        for m in re.finditer(rf"(?<![\w-])(?:{'|'.join(sorted(names, key=len, reverse=True))})(?![\w-])", text):
            yield m.start(), m.end(), "person"


def _found(text: str):
    """Matches of each type, as (start, rank of the type, end, type). Each search starts at a rare character."""
    if "@" in text:
        yield from ((m.start(), 0, m.end(), "email") for m in _EMAIL.finditer(text))
    if "AKIA" in text or "ASIA" in text or "gh" in text or "sk-" in text:
        yield from ((m.start(), 1, m.end(), "key") for m in _KEY.finditer(text) if _starts(text, m.start(), "_"))
    if "=" in text or ":" in text:
        for m in _SECRET.finditer(text):
            low = max(0, m.start() - 9)
            if head := _SECRET_NAME.search(text[low : m.start()]):
                yield low + head.start(), 2, m.end(), "secret"
    if "+" in text or "(" in text:
        yield from ((m.start(), 3, m.end(), "phone") for m in _PHONE.finditer(text) if _starts(text, m.start(), "+"))
    yield from (
        (m.start(), 4, m.end(), "ip") for m in _IP.finditer(text) if _starts(text, m.start(), "._") and _valid("ip", m[0])
    )
    yield from (
        (m.start(), 5, m.end(), "card") for m in _CARD.finditer(text) if _starts(text, m.start(), "-_") and _valid("card", m[0])
    )
    yield from ((a, 6, b, "person") for a, b in _persons(text))


def _starts(text: str, at: int, more: str) -> bool:
    """Whether nothing that belongs to a word stands right before."""
    return not at or not (text[at - 1].isalnum() or text[at - 1] in more)


def detect(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, type) in order, without overlap: the earlier one stays, then the type named first."""
    spans: list[tuple[int, int, str]] = []
    for start, _, end, kind in sorted(_found(text)):
        if not spans or start >= spans[-1][1]:
            spans.append((start, end, kind))
    more = []
    for x in sorted([*spans, *_mentions(text, spans)], key=lambda x: (x[0], -x[1])) if any(k == "person" for *_, k in spans) else spans:
        if not more or x[0] >= more[-1][1]:
            more.append(x)
    return more


def _valid(kind: str, value: str) -> bool:
    if kind == "ip":
        return all(int(x) < 256 and (x == "0" or x[0] != "0") for x in value.split("."))
    if kind == "card":
        digits = "".join(c for c in value if c.isdigit())
        return 13 <= len(digits) <= 19 and digits.startswith(ISSUERS) and luhn(digits) == 0
    return True


def luhn(digits: str) -> int:
    """The sum that is a multiple of ten for a valid card number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


class Surrogates:
    """The keyed mapping. Equal keys give equal surrogates on all machines."""

    def __init__(self, key: bytes):
        self.key = key
        self.of = lru_cache(100_000)(self._of)

    def _prf(self, *parts: object) -> int:
        return int.from_bytes(hmac.new(self.key, repr(parts).encode(), hashlib.blake2b).digest()[:16], "big")

    def permute(self, value: int, size: int, tweak: str) -> int:
        """A keyed permutation of range(size)."""
        if size <= 1:
            return value
        if size < 1000:
            order = sorted(range(size), key=lambda i: self._prf(tweak, size, i))
            return order[(order.index(value) + 1) % size]
        half = (size.bit_length() + 1) // 2
        mask = (1 << half) - 1
        while True:
            a, b = value >> half, value & mask
            for r in range(8):
                a, b = b, a ^ (self._prf(tweak, size, r, b) & mask)
            value = a << half | b
            if value < size:
                return value

    def letters(self, text: str, classes: dict[str, str], tweak: str) -> str:
        """Permutes the characters that have a class, within their classes."""
        sets = [classes.get(c) for c in text]
        tweak += "|" + "".join(c if s is None else s[0] for c, s in zip(text, sets))
        value, size = 0, 1
        for c, s in zip(text, sets):
            if s:
                value, size = value * len(s) + s.index(c), size * len(s)
        value, out = self.permute(value, size, tweak), []
        for c, s in zip(reversed(text), reversed(sets)):
            if s:
                value, i = divmod(value, len(s))
                c = s[i]
            out.append(c)
        return "".join(reversed(out))

    def _step(self, kind: str, text: str) -> str:
        if kind == "email":
            local, _, domain = text.partition("@")
            name, dot, top = domain.rpartition(".")
            return f"{self.letters(local, _LETTER_CLASS, 'local')}@{self.letters(name, _LETTER_CLASS, 'domain')}{dot}{top}"
        if kind == "phone":
            head = re.match(r"\+\d{1,3}(?=\D)", text)
            n = head.end() if head else 0
            return text[:n] + self.letters(text[n:], {**dict.fromkeys("23456789", "23456789"), "0": "01", "1": "01"}, "phone" + text[:n])
        if kind == "ip":
            value, size, octets = 0, 1, [int(x) for x in text.split(".")]
            spans = [(0, 10) if x < 10 else (10, 90) if x < 100 else (100, 156) for x in octets]
            for x, (low, n) in zip(octets, spans):
                value, size = value * n + x - low, size * n
            value, out = self.permute(value, size, f"ip{spans}"), []
            for low, n in reversed(spans):
                value, i = divmod(value, n)
                out.append(str(low + i))
            return ".".join(reversed(out))
        if kind == "card":
            digits = "".join(c for c in text if c.isdigit())
            body = digits[0] + self.letters(digits[1:-1], _LETTER_CLASS, "card" + digits[0])
            new = iter(body + str(-luhn(body + "0") % 10))
            return "".join(next(new) if c.isdigit() else c for c in text)
        if kind == "key":
            n = 4 if text[0] == "A" else 4 if text[:2] == "gh" else 3
            return text[:n] + self.letters(text[n:], _LETTER_CLASS, "key" + text[:n])
        if kind == "secret":
            n = _SECRET_HEAD.match(text).end()
            hexa = re.fullmatch(r'[0-9a-f]+"?', text[n:]) is not None
            classes = dict.fromkeys("0123456789abcdef", "0123456789abcdef") if hexa else _LETTER_CLASS
            return text[:n] + self.letters(text[n:], classes, f"secret{hexa}")
        raise ValueError(kind)

    def _name(self, name: str) -> str:
        """The surrogate of one name, title or initial."""
        if name.rstrip(".") in TITLES:
            return name
        if name[-1] == ".":
            return self.letters(name, _NAME_CLASS, "initial")
        if name in _GIVEN:
            names = sorted(GIVEN_NAMES[_GIVEN[name]], key=lambda x: self._prf("given", x))
            return names[(names.index(name) + 1) % len(names)]
        while True:  # walks on within the names that are neither known given names nor titles
            name = self.letters(name, _NAME_CLASS, "family")
            if _WHOLE_NAME.fullmatch(name) and name not in _GIVEN and name not in TITLES:
                return name

    def _of(self, kind: str, text: str) -> str:
        if kind == "person":
            return " ".join(map(self._name, text.split(" ")))
        new = text
        for _ in range(64):
            new = self._step(kind, new)
            if detect(new) == [(0, len(new), kind)]:
                return new
        return new

    def replace(self, text: str) -> tuple[str, list[dict]]:
        """The text with surrogates, and each entity as type, start, end (in the old text) and surrogate."""
        out, at, entities = [], 0, []
        for start, end, kind in detect(text):
            new = self.of(kind, text[start:end])
            out += [text[at:start], new]
            at = end
            entities.append({"type": kind, "start": start, "end": end, "surrogate": new})
        return "".join([*out, text[at:]]) if out else text, entities


_ENTITY = "array<struct<type:string,start:int,end:int,surrogate:string>>"
_ENTITY_ARROW = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())]))


def replace_entities(docs: DataFrame, key: bytes, carry: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``carry``, then the new text as ``clean_text`` and ``entities``, one row a document."""

    def factory():
        surrogates = Surrogates(key)

        def run(text):
            new, entities = [], []
            for t in text.to_pylist():
                a, b = (None, []) if t is None else surrogates.replace(t)
                new.append(a)
                entities.append(b)
            return [pa.array(new, pa.string()), pa.array(entities, _ENTITY_ARROW)]

        return run

    return map_batches(docs, [text_col], [("clean_text", "string"), ("entities", _ENTITY)], factory, carry)


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The documents, all columns, with surrogates in the text; ``length_col``, if there, is the new length."""
    out = replace_entities(docs, key, docs.columns, text_col)
    new = col(out.columns[-2])
    change = {text_col: new, **({length_col: F.char_length(new).cast(docs.schema[length_col].dataType)} if length_col in docs.columns else {})}
    return out.select(*[change.get(c, col(c)).alias(c) for c in docs.columns])


def collisions(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """Surrogates of a corpus that stand for more than one entity, or entities with more than one: none, if all is well.

    Only distinct (type, entity, surrogate) triples are shuffled.
    """
    name = fresh("t", [])
    found = replace_entities(docs.select(col(text_col).alias(name)), key, [name], name)
    rows = found.select(F.col(name), F.explode("entities").alias("e")).select(
        F.col("e.type").alias("type"),
        F.expr(f"substring({name}, e.start + 1, e.end - e.start)").alias("entity"),
        F.col("e.surrogate").alias("surrogate"),
    ).distinct()
    twice = rows.groupBy("type", "surrogate").agg(F.count("*").alias("n")).where("n > 1")
    changed = rows.groupBy("type", "entity").agg(F.count("*").alias("n")).where("n > 1")
    return twice.select("type", F.col("surrogate").alias("value"), "n").union(changed)
