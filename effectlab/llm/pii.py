"""Personal data, also where it is disguised, with the characters of the source it stands in.

Each text is read as it is first: e-mail addresses, IPv4 addresses, card numbers and phone
numbers by their patterns (the base spans). Then a chain of transducers rewrites it, each
keeping for every character that it puts out the source characters that it stands for:

1. *look-alikes*: characters of other scripts that look like ASCII ones, wide and styled
   forms and other digits become the ASCII character; invisible ones go; O and l between
   digits become 0 and 1;
2. *dots*: ``[.]``, ``(dot)``, `` dot `` between words become a dot;
3. *at signs*: ``[@]``, ``(at)`` become an at sign; a bare `` at `` only before a label with
   a disguised dot, since it is a common word;
4. *spelled digits*: runs of three or more number words, or one beside a disguised dot or
   another such part, become digits.

The same patterns run over the result, and what they find is mapped back. A span is added
if it holds something that was rewritten and no base span of its kind contains it. Texts
that no transducer changes are done after the first reading, without copies.

Patterns are searched in time linear in the text: at signs are found first and addresses
grown from them, and runs of digits are entered at their first digit only.

Defined results: a null text is an empty one; positions count code points, ends are
exclusive; spans are ordered by start, then kind in the order of ``KINDS``, then end;
matches that fail their condition are dropped and not tried again from a later start;
texts of any length are read whole, one at a time; repeated rows are read alike; an empty
table gives no rows; other columns pass through, and one named like the result is replaced.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<start:bigint,place:int,end:bigint,base:boolean>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# A start inside a run of digits fails where the run's first digit does, so it isn't tried.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _octet(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    floor, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > floor and text[begin - 1] in _LOCAL:
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            yield begin, found.end()
            floor = found.end()
        else:
            floor = max(floor, at + 1)  # the local part can't go over an at sign
        at = text.find("@", max(at + 1, floor))


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the identifiers that stand in a text as it is."""
    spans = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        spans += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(_octet(p) for p in m.groups())]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() <= 37 else ""
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
        if "+" in text:
            spans += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(spans)


# Letters of other scripts and the ASCII characters that they look like.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "υ": "u", "κ": "k",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "∗": "*", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", "·": ".", "\u00a0": " ", "\u202f": " ",
}
#: Characters that take no room.
INVISIBLE = frozenset("\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff")
# The digits 0 to 9 in words.
NUMBER_WORDS = (
    ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"),
    ("null", "eins", "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun"),
    ("zéro", "un", "deux", "trois", "quatre", "cinq", "six", "sept", "huit", "neuf"),
    ("cero", "uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve"),
)
_DIGIT_OF = {word: str(i) for words in NUMBER_WORDS for i, word in enumerate(words)}
_WORDS = "|".join(sorted(_DIGIT_OF, key=len, reverse=True))
# Words that follow a bare "at" in prose and are no host.
_NO_HOST = "the|a|an|this|that|my|our|your|his|her|its|their"
_DOT_NAMES, _AT_NAMES = "dot|punkt|punto|point", "at|arroba"
#: What a rewritten dot or number word is until the last step, so that later ones know it.
_DOT, _NOT_DOT = "\ue000", "\ue001"

_BETWEEN = re.compile(r"(?<=[0-9])[OolI](?=[0-9])")
_DOTS = re.compile(rf"[ \t]{{0,2}}(?:\[[ \t]?(?:{_DOT_NAMES}|\.)[ \t]?\]|\([ \t]?(?:{_DOT_NAMES}|\.)[ \t]?\)|\{{[ \t]?(?:{_DOT_NAMES}|\.)[ \t]?\}})[ \t]{{0,2}}|(?<=[A-Za-z0-9])[ \t]{{1,2}}(?:{_DOT_NAMES})[ \t]{{1,2}}(?=[A-Za-z0-9])", re.I)
_ATS = re.compile(rf"[ \t]{{0,2}}(?:\[[ \t]?(?:{_AT_NAMES}|@)[ \t]?\]|\([ \t]?(?:{_AT_NAMES}|@)[ \t]?\)|\{{[ \t]?(?:{_AT_NAMES}|@)[ \t]?\}})[ \t]{{0,2}}|(?<=[A-Za-z0-9])[ \t]{{1,2}}(?:{_AT_NAMES})[ \t]{{1,2}}(?!(?:{_NO_HOST}){_DOT})(?=[A-Za-z0-9-]{{1,63}}{_DOT}[A-Za-z])", re.I)
_NUMBER = rf"(?:{_WORDS})(?![^\W_])"
_SEPARATOR = r"(?:[ \t]?[,-][ \t]?|[ \t])"
_RUN = re.compile(rf"(?<![^\W_])(?:plus{_SEPARATOR}|\+[ \t]?)?{_NUMBER}(?:{_SEPARATOR}(?:{_NUMBER}|[0-9]+(?![^\W_])))*", re.I)
_TOKEN = re.compile(rf"{_NUMBER}|[0-9]+|plus|\+", re.I)
#: Quick tests on lower-case text of what the patterns above need.
_A_NUMBER = re.compile(rf"(?<![^\W_]){_NUMBER}")
_MARKS = re.compile(r"[\[({][ \t]?[.@adp]")


@cache
def _ascii_of(char: str) -> str | None:
    """The ASCII character that ``char`` stands for, nothing if it is invisible, None if it stands for itself."""
    if char.isascii():
        return None
    if char in INVISIBLE:
        return ""
    if char == _DOT:
        return _NOT_DOT
    if char in LOOKALIKES:
        return LOOKALIKES[char]
    digit = unicodedata.decimal(char, None)
    if digit is not None:
        return str(digit)
    plain = unicodedata.normalize("NFKC", char)
    return plain if len(plain) == 1 and plain.isascii() and plain.isprintable() else None


class Rewritten:
    """A text after some rewrites: ``text``, and for each of its characters the source
    characters [``start``, ``end``) that it stands for."""

    def __init__(self, text: str):
        self.text = text
        self.start = np.arange(len(text))
        self.end = self.start + 1

    def put(self, changes: list[tuple[int, int, str]]) -> None:
        """Replace the ascending ranges of ``changes`` (first, last, text of 0 or 1 characters)."""
        keep = np.ones(len(self.text), bool)
        out, at = [], 0
        for first, last, new in changes:
            out += [self.text[at:first], new]
            at = last
            keep[first + len(new) : last] = False
            if new:
                self.end[first] = self.end[last - 1]
        self.text = "".join([*out, self.text[at:]])
        self.start, self.end = self.start[keep], self.end[keep]


def _looks(text: str) -> list[tuple[int, int, str]]:
    if text.isascii():
        return []
    odd = {c: a for c in set(text) if (a := _ascii_of(c)) is not None}
    return [(i, i + 1, odd[c]) for i, c in enumerate(text) if c in odd] if odd else []


def _between(text: str) -> list[tuple[int, int, str]]:
    if not _DIGIT.search(text):
        return []
    return [(m.start(), m.end(), "0" if m[0] in "Oo" else "1") for m in _BETWEEN.finditer(text)]


def _dots(text: str) -> list[tuple[int, int, str]]:
    low = text.lower()
    if not (_MARKS.search(low) or any(name in low for name in _DOT_NAMES.split("|"))):
        return []
    return [(m.start(), m.end(), _DOT) for m in _DOTS.finditer(text)]


def _ats(text: str) -> list[tuple[int, int, str]]:
    if _DOT not in text and not _MARKS.search(text.lower()):
        return []
    return [(m.start(), m.end(), "@") for m in _ATS.finditer(text)]


def _spelled(text: str) -> list[tuple[int, int, str]]:
    if not _A_NUMBER.search(text.lower()):
        return []
    changes = []
    for run in _RUN.finditer(text):
        tokens = list(_TOKEN.finditer(text, run.start(), run.end()))
        words = [t for t in tokens if t[0].lower() in _DIGIT_OF]
        beside = _DOT in (text[run.start() - 1 : run.start()], text[run.end() : run.end() + 1])
        if len(words) < 3 and not (beside and len(words) == len(tokens)):
            continue
        last = None
        for t in tokens:
            if last is not None:
                changes.append((last, t.start(), ""))
            word = t[0].lower()
            if word in _DIGIT_OF or word == "plus":
                changes.append((t.start(), t.end(), _DIGIT_OF.get(word, "+")))
            last = t.end()
    return changes


def rewrite(text: str) -> Rewritten | None:
    """The text without disguises, or None if no transducer changes it."""
    out = None
    for step in (_looks, _between, _dots, _ats, _spelled):
        changes = step(out.text if out else text)
        if changes:
            out = out or Rewritten(text)
            out.put(changes)
    if out:
        out.text = out.text.replace(_DOT, ".")
    return out


def spans(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, place of the kind, end, whether it is a base span), in order."""
    base = plain_spans(text)
    found = [(*s, True) for s in base]
    clear = rewrite(text)
    if clear:
        held: list[list[tuple[int, int]]] = [[(a, b) for a, k, b in base if k == kind] for kind in range(len(KINDS))]
        at = [0] * len(KINDS)
        for first, kind, last in plain_spans(clear.text):
            begin, end = int(clear.start[first]), int(clear.end[last - 1])
            own = held[kind]
            while at[kind] < len(own) and own[at[kind]][1] < end:
                at[kind] += 1
            inside = at[kind] < len(own) and own[at[kind]][0] <= begin
            if not inside and text[begin:end] != clear.text[first:last]:
                found.append((begin, kind, end, False))
    return sorted(found)


def detect(docs: DataFrame, text: str = "text", name: str = "pii", keep_text: bool = True) -> DataFrame:
    """``docs`` with the spans of each text: an array of (start, place of the kind, end, base)."""
    docs = docs.drop(name)
    names = [c for c in docs.columns if keep_text or c != text]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("place", pa.int32()), ("end", pa.int64()), ("base", pa.bool_())]))
    given = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ("start", "place", "end", "base")
        for batch in batches:
            made = [[dict(zip(fields, s)) for s in spans(t.as_py() or "")] for t in batch.column(given)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(made, kind)], [*names, name])

    fields = [f for f in docs.schema.fields if f.name in names]
    return docs.mapInArrow(run, T.StructType([*fields, T.StructField(name, T._parse_datatype_string(SPANS))]))


def count(found: Column, kind: str, base_only: bool = True) -> Column:
    """How many spans of a kind there are."""
    place = KINDS.index(kind)
    return F.size(F.filter(found, lambda s: (s["place"] == place) & (s["base"] | F.lit(not base_only)))).cast("bigint")


def told(found: Column, base_only: bool = False) -> Column:
    """Spans as kind:start:end, comma-joined, in order."""
    names = F.array(*[F.lit(k) for k in KINDS])
    chosen = F.filter(found, lambda s: s["base"]) if base_only else found
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", F.get(names, s["place"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; spans that overlap are one,
    named after the first. Null texts stay null."""
    kept = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = kept.index(text)
        for batch in batches:
            made = []
            for value in batch.column(place):
                body = value.as_py()
                out, at = [], 0
                for begin, kind, end, _ in spans(body or ""):
                    if begin >= at:
                        out += [body[at:begin], f"[{KINDS[kind].upper()}]"]
                    at = max(at, end)
                made.append(None if body is None else "".join([*out, body[at:]]))
            columns = list(batch.columns)
            columns[place] = pa.array(made, pa.string())
            yield pa.RecordBatch.from_arrays(columns, kept)

    return docs.mapInArrow(run, docs.schema)
