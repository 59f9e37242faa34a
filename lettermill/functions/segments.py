"""Threads, headers, greetings and signatures of a message.

Every line is described once; the operators then work on positions in the list of descriptions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from lettermill.functions import vocab as V
from lettermill.functions.people import fold

_I = re.IGNORECASE
_KEY = re.compile("(" + "|".join(sorted(V.HEADER_KEYS, key=len, reverse=True)) + r")\s*(?::|$)")
_HEADER_TEXT, _SUBJECT, _BANNER, _FORWARD = (re.compile(p, _I) for p in (V.HEADER_TEXT, V.SUBJECT_PREFIX, V.FORWARD_BANNER, V.FORWARD_TEXT))
_HISTORY, _REPLY = re.compile(V.HISTORY_BANNER, _I), re.compile(V.REPLY_INTRO, _I)
_WROTE = re.compile(r"(?:am\s+.+\s+schrieb|on\s+.+\s+wrote)\b")
_QUOTE, _INLINE, _ARTIFACT = re.compile(V.QUOTE_PREFIX), re.compile(V.INLINE_CONTENT, _I), re.compile(V.HEADER_ARTIFACT)
_GREETING = re.compile("(?:" + "|".join(V.GREETINGS) + "),?")
_EMAIL, _BARE_ADDRESS = re.compile(V.EMAIL), re.compile(r"[\w.+\-]+@[\w.\-]+")
_HINT = re.compile(V.CONTACT_HINT, _I)
_TWO_NAMES = re.compile(r"[A-ZÄÖÜ][A-Za-zÄÖÜäöüß'`\-.]+\s+[A-ZÄÖÜ][A-Za-zÄÖÜäöüß'`\-.]+")
_RULE = re.compile(r"\s*-{5,}\s*")
#: Lines that the preamble may take, lines of a header cluster, lines of a tail that may be a signature, names after a sign-off.
PREAMBLE, CLUSTER, TAIL, NAMES = 20, 8, 14, 3


def ratio(a: str, b: str) -> float:
    """Similarity 0 .. 100: twice the longest common subsequence over both lengths. Bit-parallel over the letters of `a`."""
    if not a and not b:
        return 100.0
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    row = full = (1 << len(a)) - 1
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def normal(line: str) -> str:
    """Folded, white space collapsed, without marks at the ends."""
    return " ".join(fold(line).split()).strip(" \t,.;:!?")


def header_key(line: str) -> str:
    m = _KEY.match(re.sub(r"^plain\s+", "", normal(line)))
    return m[1] if m else ""


def is_greeting(line: str) -> bool:
    """A line that only greets, small typos forgiven."""
    text = normal(line)
    if not text or _INLINE.search(text):
        return False
    if text.startswith(("sehr geehrte", "dear ")):
        return True
    if 0 <= text.find(",") < len(text) - 1 or len(text) > 120 or len(text.split()) > 9:
        return False
    return bool(_GREETING.fullmatch(text)) or any(ratio(text, g) >= V.FUZZY_LEAST for g in V.FUZZY_GREETINGS)


def is_sign_off(line: str) -> bool:
    text = line.strip()
    return text in V.SIGNATURE_RULES or bool(text) and fold(text).startswith(V.SIGN_OFFS)


def is_artifact(line: str) -> bool:
    """What a broken header leaves behind: brackets, or an address alone."""
    text = line.strip()
    if not text:
        return False
    alone = _EMAIL.search(text) and not _INLINE.search(text) and not _EMAIL.sub("", text).strip(" <>\"';")
    return bool(_ARTIFACT.fullmatch(text) or alone or _BARE_ADDRESS.fullmatch(text))


@dataclass(frozen=True, slots=True)
class Line:
    text: str
    blank: bool
    key: str
    header: bool
    intro: bool
    start: bool
    plain: bool


@lru_cache(maxsize=20_000)
def described(text: str) -> Line:
    n = normal(text)
    key = header_key(text)
    banner = bool(_BANNER.match(n) or _FORWARD.match(n))
    return Line(
        text=text,
        blank=not text.strip(),
        key=key,
        header=bool(n) and bool(key or banner or _SUBJECT.match(n) or _HEADER_TEXT.match(n)),
        intro=bool(n) and (banner or bool(_WROTE.match(n))),
        start=bool(key or _HISTORY.match(n) or _REPLY.match(n)),
        plain=n in ("plain", "text", "plaintext"),
    )


def split_lines(mail: str | None) -> list[Line]:
    return [described(t) for t in (mail or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")]


def join(lines: list[Line]) -> str:
    return "\n".join(x.text for x in lines).strip()


def is_cluster(lines: list[Line], at: int) -> bool:
    """Whether quoted headers begin here."""
    keys = [x.key for x in lines[at : at + CLUSTER] if x.key]
    return bool(lines[at].key) and len(set(keys)) > 1 and not {"von", "from"}.isdisjoint(keys)


def thread_parts(mail: str | None) -> list[str]:
    """The messages of a thread, newest first, without their quote marks."""
    lines = split_lines(mail)
    parts: list[list[str]] = [[]]
    content = quoted = False

    def cut() -> None:
        nonlocal content
        parts.append([])
        content = False

    for at, line in enumerate(lines):
        if line.intro and content:
            cut()
            quoted = False
            continue
        mark = _QUOTE.match(line.text)
        is_quote = bool(mark) and (quoted or bool(line.text[mark.end() :].strip()))
        if is_quote and content and not quoted:
            cut()
            quoted = True
        if content and is_cluster(lines, at):
            cut()
            quoted = False
        if not is_quote and not line.blank:
            quoted = False
        text = re.sub(r"^\s*>+\s?", "", line.text) if is_quote else line.text
        parts[-1].append(text)
        content = content or bool(text.strip()) and normal(text) not in ("plain", "text", "plaintext")
    return [p for part in parts if (p := "\n".join(part).strip())]


def without_headers(mail: str | None) -> str:
    """Without header lines and what belongs to them, wherever they are; never more than one blank line together."""
    lines = split_lines(mail)
    kept: list[str] = []
    at = 0
    while at < len(lines):
        line = lines[at]
        at += 1
        if not line.start or line.blank:
            if line.blank:
                kept.append("")
            elif not (kept and not kept[-1].strip() and is_artifact(line.text)):
                kept.append(line.text)
            continue
        while at < len(lines) and not lines[at].blank and not _ends_header(lines[at]) and _continues_header(lines[at].text):
            at += 1
        at += at < len(lines) and lines[at].blank
    return re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip()


def _ends_header(line: Line) -> bool:
    return bool(line.key) or line.intro or is_sign_off(line.text) or is_greeting(line.text)


def _continues_header(text: str) -> bool:
    return text[:1].isspace() or text.strip().startswith((",", ";")) or is_artifact(text) or _EMAIL.search(text) is not None


def without_preamble(mail: str | None) -> str:
    """Without what stands before the message itself: headers, markers, greetings."""
    lines = split_lines(mail)
    at = next((k for k, x in enumerate(lines) if not x.blank), len(lines))
    for _ in range(PREAMBLE):
        if at >= len(lines):
            break
        line = lines[at]
        if line.key and not line.plain and not is_artifact(line.text):
            at = _after_field(lines, at)
        elif line.blank or line.plain or line.header or is_artifact(line.text) or is_greeting(line.text):
            at += 1
        else:
            break
    return join(lines[at:])


def _after_field(lines: list[Line], at: int) -> int:
    """Where a header field ends: after its line if that has its value, except for subjects; else before the next field or message line."""
    line = lines[at]
    value = line.text.partition(":")[2].strip()
    at += 1
    if value and not _ARTIFACT.fullmatch(value) and line.key not in ("betreff", "subject"):
        return at
    while at < len(lines) and not lines[at].blank and not _ends_header(lines[at]):
        at += 1
    return at + (at < len(lines) and lines[at].blank)


def signature_start(lines: list[Line]) -> int | None:
    """The first sign-off, else the first of the last lines from which on the text reads like a signature."""
    for k, line in enumerate(lines):
        if is_sign_off(line.text):
            return k
    if len(lines) < 4:
        return None
    for k in range(max(0, len(lines) - TAIL), len(lines)):
        tail = [x.text.strip() for x in lines[k:] if not x.blank]
        hints = sum(1 for t in tail if _HINT.search(t))
        if len(tail) >= 3 and (hints >= 3 or hints == 2 and any(_TWO_NAMES.search(t) for t in tail[:4])):
            return k
    return None


def _before_history(lines: list[Line]) -> list[Line]:
    end = next((k for k, x in enumerate(lines) if x.intro or x.key), len(lines))
    while end and _RULE.fullmatch(lines[end - 1].text):
        end -= 1
    return lines[:end]


_PREFIXES = re.compile(r"^(i\.?\s*a\.?|i\.?\s*v\.?|im\s+auftrag|ppa\.?|pp\.?|herr|frau|hr|fr|dr\.?|prof\.?|dipl\.?(?:-|\s*)ing\.?)\s+")


def _is_name_line(text: str) -> bool:
    bare = _PREFIXES.sub("", fold(text.strip())).strip(" ,;:-")
    return bool(bare) and not _HINT.search(text) and bool(_TWO_NAMES.search(text))


def signature_prompt(signature: str) -> str:
    """A signature without its sign-off and the names under it."""
    lines = [x for x in split_lines(signature)]
    skip = lambda k: next((j for j in range(k, len(lines)) if not lines[j].blank), len(lines))
    at = skip(0)
    if at < len(lines) and is_sign_off(lines[at].text):
        at = skip(at + 1)
        for _ in range(NAMES):
            if at < len(lines) and _is_name_line(lines[at].text):
                at = skip(at + 1)
    return join(_before_history(lines[at:]))


def context_and_signature(mail: str | None) -> tuple[str, str, str]:
    """(context, signature as prompted, signature as extracted from)."""
    lines = split_lines(mail)
    start = signature_start(lines) if (mail or "").strip() else None
    if start is not None:
        raw = join(lines[start:])
        prompt, source = signature_prompt(raw), join(_before_history(split_lines(raw)))
        if prompt or source:
            return without_preamble(join(lines[:start])), prompt, source
    return without_preamble(mail), "", ""


def segments(mail: str | None) -> list[tuple[str, str, str]]:
    """(query_type, segment, source) of a message: for each part of its thread its context and its signature; a message without any is its own context."""
    out = []
    for part in thread_parts(mail):
        context, prompt, source = context_and_signature(without_headers(part))
        whole = "\n\n".join(p.strip() for p in (context, source) if p.strip())
        out += [("context", context, whole), ("signature", prompt, whole)]
    kept = [s for s in out if s[1].strip()]
    text = (mail or "").strip()
    return kept or ([("context", text, text)] if text else [])
