"""Operator 3: personal data, plain and disguised, with offsets of the source.

Four base patterns find plain identifiers. The method reads a text through transducers that keep, for each output character,
the source span it stands for: look-alike letters and digits and invisible characters, spelled digits, and disguised at, dot and
plus signs. The same patterns then run over the normalised text; what they find only there is mapped back to the source.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.common import batches_of, id_and_bytes, rows_of

Span = tuple[int, int, str]

#: The base patterns and the order of kinds.
KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: each begins where the run of local characters before an at sign begins, so no position is read twice."""
    free = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = at = m.end()
        else:
            at += 1
            free = at


def plain_spans(text: str) -> list[Span]:
    """(start, end, kind), leftmost and non-overlapping for each kind; matches that fail their test are dropped."""
    spans: list[Span] = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    spans += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(part_at_most_255(p) for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := only_digits(m[0])) <= 19 and luhn(d):
            spans.append((m.start(), m.end(), "card"))
    if "+" in text:
        spans += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(only_digits(m[0])) <= 15]
    return spans


def part_at_most_255(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


#: Letters of other scripts that look like Latin letters, each with the letter.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "χ": "x", "ε": "e",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ｰ": "-",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "﹣": "-", "․": ".", "。": ".", "｡": ".", "﹒": ".", "﹫": "@",
}
#: Characters that show nothing.
INVISIBLE = "­​‌‍⁠﻿"
#: Digits as spelled in English, German, French and Spanish.
SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "oh": "0",
}
#: Words for the signs.
AT_WORDS, DOT_WORDS, PLUS_WORDS = ("at", "arroba", "arobase", "ät"), ("dot", "punkt", "punto", "point"), ("plus", "más")
#: Last labels of domains after a bare word for the at sign, where the dots are not disguised.
LAST_LABELS = ("com", "org", "net", "edu", "gov", "info", "biz", "io", "co", "de", "fr", "es", "uk", "us", "eu", "ch", "at", "example", "test")


@functools.cache
def _looks_like(char: str) -> str | None:
    """What a character stands for in an identifier; None: itself."""
    if char < "\x7f":
        return None
    if char in INVISIBLE:
        return ""
    if (known := LOOKALIKES.get(char)) is not None:
        return known
    if (digit := unicodedata.decimal(char, None)) is not None:
        return str(digit)
    if (plain := unicodedata.normalize("NFKC", char)) != char and len(plain) == 1 and "\x20" <= plain < "\x7f":
        return plain
    return None


class Mapped:
    """A text with the source span of each character, and whether the character was rewritten."""

    __slots__ = ("text", "starts", "ends", "new")

    def __init__(self, text: str, starts: array, ends: array, new: bytearray):
        self.text, self.starts, self.ends, self.new = text, starts, ends, new

    @classmethod
    def of(cls, text: str) -> Mapped:
        return cls(text, array("i", range(len(text))), array("i", range(1, len(text) + 1)), bytearray(len(text)))

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """With each (start, end, replacement) applied; edits are in order and apart. An edit's characters stand for all of its source."""
        if not edits:
            return self
        parts, starts, ends, new, at = [], array("i"), array("i"), bytearray(), 0
        for a, b, put in edits:
            parts += (self.text[at:a], put)
            starts += self.starts[at:a]
            ends += self.ends[at:a]
            new += self.new[at:a]
            if put:
                starts.extend([self.starts[a]] * len(put))
                ends.extend([self.ends[b - 1]] * len(put))
                new += b"\1" * len(put)
            elif new:
                new[-1] = 1  # what was taken out counts for the character before it
            at = b
        parts.append(self.text[at:])
        starts += self.starts[at:]
        ends += self.ends[at:]
        return Mapped("".join(parts), starts, ends, new + self.new[at:])

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.starts[a], self.ends[b - 1]


_alternatives = lambda words: "|".join(sorted(map(re.escape, words), key=len, reverse=True))
_DIGIT_WORD = rf"(?:{_alternatives(SPELLED)})"
_WORDS = re.compile(r"[^\W_]+")
_DIGIT_TOKEN = re.compile(rf"(?<![^\W_])(?:{_DIGIT_WORD}|[0-9])(?![^\W_])", re.IGNORECASE)
_DIGIT_GAP = re.compile(r"[\x20,.-]{1,2}")
_BETWEEN_DIGITS = re.compile(rf"(?<=[0-9])\s*(?:\[\s*(?:{_alternatives(DOT_WORDS)}|\.)\s*\]|\(\s*(?:{_alternatives(DOT_WORDS)}|\.)\s*\)|\{{\s*(?:{_alternatives(DOT_WORDS)}|\.)\s*\}}|(?<=\s)(?:{_alternatives(DOT_WORDS)})(?=\s))\s*(?=[0-9])", re.IGNORECASE)
_PLUS = re.compile(rf"(?<![^\W_])(?:{_alternatives(PLUS_WORDS)})\s+(?=[0-9])|\(\s*(?:{_alternatives(PLUS_WORDS)})\s*\)\s*(?=[0-9])", re.IGNORECASE)
_LETTER_DIGIT = re.compile(r"(?<=[0-9])[OoIl|](?=[0-9]|[\x20.-][0-9]{2})|(?<=[0-9][\x20.-])[OoIl|](?=[0-9]{2})")
_SIGNS = re.compile(
    rf"[\[({{<]\s*(?:(?P<at>{_alternatives(AT_WORDS)}|@)|(?P<dot>{_alternatives(DOT_WORDS)}|\.))\s*[\])}}>]"
    rf"|(?<=\s)(?:(?P<at_word>{_alternatives(AT_WORDS)})|(?P<dot_word>{_alternatives(DOT_WORDS)}))(?=\s)|(?P<plain>@)",
    re.IGNORECASE,
)
#: One of these is in every text with a disguised address.
_MAY_HIDE = re.compile(
    rf"[\[({{<]\s*(?:{_alternatives((*AT_WORDS, *DOT_WORDS))}|[@.])\s*[\])}}>]|\s@|@\s"
    rf"|\s(?:(?:{_alternatives(DOT_WORDS)})\s|(?:{_alternatives(AT_WORDS)})\s+[A-Za-z0-9-]+\.[A-Za-z0-9-])",
    re.IGNORECASE,
)
_CLOSES = {"[": "]", "(": ")", "{": "}", "<": ">"}
_HOST_CHARS = _LOCAL_CHARS - frozenset("._%+")
_PIECE_CHARS = _LOCAL_CHARS - frozenset(".")


def lookalikes(mapped: Mapped) -> Mapped:
    """Transducer of look-alike, wide and invisible characters."""
    if mapped.text.isascii():
        return mapped
    strange = [c for c in set(mapped.text) if c > "\x7e" and _looks_like(c) is not None]
    if not strange:
        return mapped
    found = re.finditer("[" + "".join(map(re.escape, strange)) + "]", mapped.text)
    return mapped.rewritten([(m.start(), m.end(), _looks_like(m[0])) for m in found])


_SIGN_WORDS = frozenset((*DOT_WORDS, *PLUS_WORDS))
_LONGEST_SIGN = max(map(len, _SIGN_WORDS))
_DIGIT_AND_GAP = re.compile(r"[0-9][\x20,.-]{1,2}$|\+\s?\(?$")
_SIGN_AFTER = re.compile(
    rf"\s*(?:[\[({{]\s*)?(?:{_alternatives(DOT_WORDS)})(?![^\W_])|\s*[\[({{]\s*\.\s*[\])}}]|[\x20,.-]{{1,2}}[0-9]", re.IGNORECASE
)


def _sign_before(text: str, at: int) -> bool:
    """Whether a sign of numbers ends at `at`: a digit with a gap, a plus sign, a word for dot or plus, or a dot in brackets."""
    if _DIGIT_AND_GAP.search(text[max(0, at - 3) : at]):
        return True
    while at and (text[at - 1].isspace() or text[at - 1] in "])}"):
        at -= 1
    if at and text[at - 1] == ".":
        at -= 1
        while at and text[at - 1].isspace():
            at -= 1
        return at > 0 and text[at - 1] in "[({"
    start = at
    while start and at - start <= _LONGEST_SIGN and text[start - 1].isalnum():
        start -= 1
    return text[start:at].lower() in _SIGN_WORDS


def spelled_digits(mapped: Mapped, dots: bool = False) -> Mapped:
    """Transducer of spelled digits beside another digit, spelled or not, or a dot or plus sign or word; single spaces, commas, hyphens and dots between single digits go, the dots only without `dots`."""
    text, edits = mapped.text, []
    tokens = [(m.start(), m.end(), SPELLED.get(m[0].lower())) for m in _DIGIT_TOKEN.finditer(text)]
    at = 0
    while at < len(tokens):
        end = at + 1
        while end < len(tokens) and _DIGIT_GAP.fullmatch(text, tokens[end - 1][1], tokens[end][0]):
            end += 1
        run, at = tokens[at:end], end
        if all(digit is None for *_, digit in run):
            continue
        first, last = run[0][0], run[-1][1]
        if len(run) == 1 and not _sign_before(text, first) and not _SIGN_AFTER.match(text, last):
            continue
        for k, (a, b, digit) in enumerate(run):
            if k:
                gap = text[run[k - 1][1] : a]
                edits.append((run[k - 1][1], a, "." if dots and "." in gap else ""))
            if digit is not None:
                edits.append((a, b, digit))
    return mapped.rewritten(edits)


def signs_in_numbers(mapped: Mapped) -> Mapped:
    """Transducer of disguised dots and plus signs beside digits, and of letters for digits within numbers."""
    low = mapped.text.lower()
    if any(w in low for w in DOT_WORDS) or "[" in low or "(" in low or "{" in low:
        mapped = mapped.rewritten([(m.start(), m.end(), ".") for m in _BETWEEN_DIGITS.finditer(mapped.text)])
    if any(w in low for w in PLUS_WORDS):
        mapped = mapped.rewritten([(m.start(), m.end(), "+") for m in _PLUS.finditer(mapped.text)])
    return mapped.rewritten([(m.start(), m.end(), "0" if m[0] in "Oo" else "1") for m in _LETTER_DIGIT.finditer(mapped.text)])


class _Sign:
    """A sign for at or dot, with the white space around it: where it is, whether it is a word on its own, and whether it is a plain @."""

    __slots__ = ("start", "end", "at", "word", "plain")

    def __init__(self, start: int, end: int, at: bool, word: bool, plain: bool):
        self.start, self.end, self.at, self.word, self.plain = start, end, at, word, plain


def _signs(text: str) -> list[_Sign]:
    """The signs of a text. White space between two of them belongs to both, so that each run of it is read twice at most."""
    out = []
    for m in _SIGNS.finditer(text):
        kind, start, end = m.lastgroup, m.start(), m.end()
        if kind in ("at", "dot") and _CLOSES[text[start]] != text[end - 1]:
            continue
        while start and text[start - 1].isspace():
            start -= 1
        while end < len(text) and text[end].isspace():
            end += 1
        out.append(_Sign(start, end, kind not in ("dot", "dot_word"), kind.endswith("word"), end - start == 1))
    return out


def _host(text: str, at: int, dots: dict[int, _Sign], barred: set[int]) -> tuple[list[str], list[int], bool]:
    """Labels of a host that begins at `at`, where each ends, and whether a dot between them is disguised."""
    labels, ends, hidden, by_sign = [], [], False, False
    while True:
        end = at
        while end < len(text) and text[end] in _HOST_CHARS:
            end += 1
        if end == at or at in barred and not by_sign:
            break
        labels.append(text[at:end])
        ends.append(end)
        hidden |= by_sign
        if at in barred:
            break  # a last label that is a word for a sign, such as that of Austria
        by_sign = end in dots
        if not by_sign and text[end : end + 1] != ".":
            break
        at = dots[end].end if by_sign else end + 1
    return labels, ends, hidden


def _local(text: str, end: int, free: int, dots: dict[int, _Sign], barred: set[int]) -> tuple[int, bool]:
    """Where a local part that ends at `end` begins, and whether a dot within is disguised; `end` itself: there is none."""
    first, hidden, by_sign = end, False, False
    while True:
        start = end
        while start > free and text[start - 1] in _PIECE_CHARS:
            start -= 1
        if start == end or start in barred:
            break
        first = start
        hidden |= by_sign
        by_sign = start in dots and dots[start].start > free
        if not by_sign and (start <= free or text[start - 1] != "."):
            break
        end = dots[start].start if by_sign else start - 1
    return first, hidden


def disguised_emails(text: str, mapped: Mapped | None = None) -> list[tuple[int, int]]:
    """Source spans of addresses whose at sign or dots are disguised, in a text or in what `mapped` reads in it.

    Each address is read from its at sign outwards, to both sides as far as its characters and signs reach and no further than
    the next at sign, so that a text is read a bounded number of times whatever it holds.
    """
    text, out, free = mapped.text if mapped else text, [], 0
    signs = _signs(text)
    if not any(s.at for s in signs):
        return out
    before = {s.end: s for s in signs if not s.at}
    after = {s.start: s for s in signs if not s.at}
    barred = set()
    for s in signs:
        if s.word:
            at = s.start
            while text[at].isspace():
                at += 1
            barred.add(at)
    for sign in signs:
        if not sign.at or sign.start < free:
            continue
        labels, ends, hidden = _host(text, sign.end, after, barred)
        if len(labels) < 2 or ends[-1] < len(text) and text[ends[-1]] == "@":
            continue
        while sign.word and not hidden and labels and labels[-1].lower() not in LAST_LABELS:
            labels.pop()  # a sentence may go on behind the address without a space
        if len(labels) < 2 or not labels[-1].isalpha() or len(labels[-1]) < 2:
            continue
        start, dotted = _local(text, sign.start, free, before, barred)
        end = ends[len(labels) - 1]
        if start == sign.start or sign.plain and not hidden and not dotted and not (mapped and any(mapped.new[start:end])):
            continue  # nothing, or plain
        out.append(mapped.source(start, end) if mapped else (start, end))
        free = end
    return out


def _free_of(span: Span, base: list[Span]) -> bool:
    """Whether a span touches none of the spans of its kind, which are in order and apart, or holds those that it touches."""
    k = bisect_left(base, span[0], key=lambda s: s[1])
    while k < len(base) and base[k][0] < span[1]:
        if base[k][1] > span[0] and not (span[0] <= base[k][0] and base[k][1] <= span[1] and base[k][:2] != span[:2]):
            return False
        k += 1
    return True


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """What the method finds beyond the base spans: identifiers with at least one rewritten character; one that meets a base span of its kind holds it whole."""
    mapped = lookalikes(Mapped.of(text)) if not text.isascii() and any(c > "\x7e" and _looks_like(c) is not None for c in set(text)) else None
    read = mapped.text if mapped else text
    low = read.lower()
    readings = [mapped] if mapped else []
    if not SPELLED.keys().isdisjoint(_WORDS.findall(low)):
        whole = mapped or Mapped.of(text)
        spelled = [spelled_digits(whole), spelled_digits(whole, dots=True)]
        if spelled[0] is not whole:
            readings = spelled[: 1 + (spelled[0].text != spelled[1].text)]
    signs = any(w in low for w in _SIGN_WORDS)
    if signs or any(_BETWEEN_DIGITS.search(r) or _LETTER_DIGIT.search(r) for r in ([r.text for r in readings] or [read])):
        readings = [signs_in_numbers(r) for r in readings or [Mapped.of(text)]]
    found: list[Span] = []
    for numbers in readings:
        for a, b, kind in plain_spans(numbers.text):
            if any(numbers.new[a:b]):
                found.append((*numbers.source(a, b), kind))
    if _MAY_HIDE.search(read):
        found += [(a, b, "email") for a, b in disguised_emails(text, mapped)]
    by = {kind: sorted(s for s in base if s[2] == kind) for kind in KINDS}
    out: list[Span] = []
    ends = dict.fromkeys(KINDS, 0)
    for span in sorted(set(found), key=lambda s: (s[0], -s[1])):
        if span[0] >= ends[span[2]] and _free_of(span, by[span[2]]):
            out.append(span)
            ends[span[2]] = span[1]
    return out


def in_order(spans: list[Span]) -> list[Span]:
    """By start, then kind as listed."""
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
FOUND = pa.schema([("id", pa.int64()), ("base", _SPANS), ("added", _SPANS)])


def _structs(spans: list[Span]) -> list[dict]:
    return [{"start": a, "end": b, "kind": k} for a, b, k in spans]


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, base and added (arrays of start, end, kind; code points of the source, end exclusive), one row for each row of `df`.

    A null text is empty and has no spans; repeated rows give repeated results; a null id stays null; an empty table gives no
    rows; other columns are not carried. One pass without a shuffle; time is linear in a text's length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for key, body in rows_of(batches):
                text = body.decode("utf-8", "replace")
                base = in_order(plain_spans(text))
                yield key, _structs(base), _structs(in_order(added_spans(text, base)))

        return batches_of(rows(), FOUND)

    return id_and_bytes(df, id_col, text_col).mapInArrow(run, "id long, base array<struct<start:int,end:int,kind:string>>, added array<struct<start:int,end:int,kind:string>>")


#: What stands for an identifier in a redacted text.
MARKS = {kind: f"[{kind.upper()}]" for kind in KINDS}


def redact_text(text: str) -> str:
    """The text with each identifier, plain or disguised, replaced by its mark; overlapping spans take the mark of the first."""
    base = plain_spans(text)
    spans = in_order(base + added_spans(text, base))
    if not spans:
        return text
    parts, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            parts += (text[at:a], MARKS[kind])
            at = b
        elif b > at:
            at = b
    parts.append(text[at:])
    return "".join(parts)


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """`df` with identifiers in `text_col` replaced by marks; every row and every other column stays; a null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = [None if t is None else redact_text(t) for t in batch.column(at).to_pylist()]
            yield pa.record_batch([pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    return df.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(run, df.withColumn(text_col, F.col(text_col).cast("string")).schema)
