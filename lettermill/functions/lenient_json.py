"""JSON as classifiers write it: fenced, quoted, with Python words, single quotes and trailing commas."""

from __future__ import annotations

import ast
import json
import re

_FENCE = re.compile(r"^```[a-z]*\s*|\s*```$", re.IGNORECASE)
_STRAIGHT = str.maketrans({"“": '"', "”": '"', "‘": "'", "’": "'"})
_PIECES = re.compile(r""""(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|\b(?:True|False|None|true|false|null)\b""", re.DOTALL)
_TO_JSON = {"True": "true", "False": "false", "None": "null"}
_TO_PYTHON = {b: a for a, b in _TO_JSON.items()}


def strip_fences(text: str) -> str:
    return _FENCE.sub("", text.strip()).strip()


def objects(text: str) -> list[str]:
    """Balanced top-level {...} of a text. Quotes of either kind open a string, within prose too, so an apostrophe can hide what follows."""
    found, depth, start, quote, skip = [], 0, 0, "", False
    for at, c in enumerate(text):
        if skip:
            skip = False
        elif quote:
            skip = c == "\\"
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "{":
            start = at if depth == 0 else start
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                found.append(text[start : at + 1])
    return found


def swap_words(text: str, words: dict[str, str]) -> str:
    """Replaces words outside strings."""
    return _PIECES.sub(lambda m: m[0] if m[0][0] in "\"'" else words.get(m[0], m[0]), text)


def load(text: str) -> dict | None:
    """One object, or None: strict JSON after repairs, else a Python literal; nothing is ever evaluated."""
    repaired = re.sub(r",\s*([}\]])", r"\1", swap_words(text.strip().translate(_STRAIGHT), _TO_JSON))
    value = None
    try:
        value = json.loads(repaired)
    except ValueError:
        try:
            value = json.loads(json.dumps(ast.literal_eval(swap_words(repaired, _TO_PYTHON))))
        except (SyntaxError, ValueError, TypeError, MemoryError, RecursionError):
            return None
    return with_flag(value) if isinstance(value, dict) else None


def with_flag(value: dict) -> dict:
    """`is_allowed` as a boolean where a string says so."""
    flag = value.get("is_allowed")
    if isinstance(flag, str) and (word := flag.strip().casefold()) in ("true", "1", "yes", "false", "0", "no"):
        value["is_allowed"] = word in ("true", "1", "yes")
    return value


def candidates(raw: str | None) -> list[dict]:
    """All objects that load, of the text and of what it says if it is a JSON string."""
    text = strip_fences(raw or "")
    texts = [text]
    try:
        inner = json.loads(text)
        if isinstance(inner, str):
            texts.append(strip_fences(inner))
    except ValueError:
        pass
    return [value for t in texts for part in (objects(t) or [t]) if (value := load(part)) is not None]


def first_object(raw: str | None) -> dict | None:
    return next(iter(candidates(raw)), None)


def first_allowed(raw: str | None) -> dict:
    """The first object that is allowed; an error if there is none."""
    for value in candidates(raw):
        if value.get("is_allowed") is True:
            return value
    raise ValueError("no allowed object in the response")
