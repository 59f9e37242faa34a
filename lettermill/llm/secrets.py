"""Operator 8: secrets by patterns and by token efficiency.

Three base patterns find assignments, access keys and hexadecimal strings. The method then looks at every other unbroken run of
key characters: random strings cost a byte-pair vocabulary many tokens, so a run with few characters a token, mixed from
letters and digits, is a secret, unless it has the shape of a known digest or identifier or a base span has it already.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from lettermill.llm.common import batches_of, id_and_bytes, rows_of

#: The base patterns and the order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")
ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
#: Least characters of an assigned value, an access key and a hexadecimal string.
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32

#: A run of this many key characters is tested; runs are tested in slices so that time stays linear in their length.
LEAST_RUN, SLICE = 20, 2_000
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}")
#: Runs with fewer characters a token than this are random. English words have about 4, invented words about 3, keys under 2.
CHARS_A_TOKEN = 2.4
#: Shapes that are no secrets: digests of usual lengths, UUIDs, numbers, dates and times.
KNOWN = re.compile(
    r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}"
    r"|(?:sha1|sha256|sha384|sha512|md5)[-=:][0-9A-Za-z+/=]+"
    r"|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
    r"|[0-9+/_=-]+)"
)
_RUN_BYTES = bytes(b"x"[0] if chr(b).isascii() and (chr(b).isalnum() or chr(b) in "+/_=-") else 32 for b in range(256))
_HEX_BYTES = bytes(b"x"[0] if chr(b) in "0123456789abcdef" else 32 for b in range(256))


@functools.lru_cache(maxsize=2)
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str, body: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, leftmost and non-overlapping for each kind, in code points."""
    spans = []
    low = text.lower()
    if any(hint in low for hint in ASSIGN_HINTS):
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if b"x" * LEAST_HEX in body.translate(_HEX_BYTES):
        spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return spans


def efficiency(run: str, by: tiktoken.Encoding) -> float:
    """Characters a token."""
    return len(run) / sum(len(by.encode_ordinary(run[at : at + SLICE])) for at in range(0, len(run), SLICE))


def is_random(run: str, by: tiktoken.Encoding, chars_a_token: float = CHARS_A_TOKEN) -> bool:
    if KNOWN.fullmatch(run) or not any(c.isdigit() for c in run) or not any(c.isalpha() for c in run):
        return False
    return efficiency(run, by) < chars_a_token


def random_spans(text: str, body: bytes, taken: list[tuple[int, int, str]], by: tiktoken.Encoding, chars_a_token: float = CHARS_A_TOKEN) -> list[tuple[int, int, str]]:
    """The method's spans; none overlaps a base span."""
    if b"x" * LEAST_RUN not in body.translate(_RUN_BYTES):
        return []
    taken, at, out = sorted(taken), 0, []
    for m in RUN.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        near, overlaps = at, False
        while near < len(taken) and taken[near][0] < m.end():
            overlaps |= taken[near][1] > m.start()
            near += 1
        if not overlaps and is_random(m[0], by, chars_a_token):
            out.append((m.start(), m.end(), "random"))
    return out


def in_order(spans: list[tuple[int, int, str]], kinds: tuple[str, ...] = KINDS) -> list[tuple[int, int, str]]:
    """By start, then kind as listed."""
    return sorted(spans, key=lambda s: (s[0], kinds.index(s[2]), s[1]))


FOUND = pa.schema([("id", pa.int64()), ("base", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))), ("added", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])))])
FOUND_DDL = "id long, base array<struct<start:int,end:int,kind:string>>, added array<struct<start:int,end:int,kind:string>>"


def structs(spans: list[tuple[int, int, str]]) -> list[dict]:
    return [{"start": a, "end": b, "kind": k} for a, b, k in spans]


def find_secrets(df: DataFrame, ranks_path: str, pattern: str, chars_a_token: float = CHARS_A_TOKEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, base and added (arrays of start, end, kind; code points, end exclusive), one row for each row of `df`.

    A null text is empty and has no spans; repeated rows give repeated results; a null id stays null; an empty table gives no
    rows; other columns are not carried. Base spans keep to their patterns; added ones are of kind `random` and overlap none
    of them. One pass without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = encoding(ranks_path, pattern)

        def rows() -> Iterator[tuple]:
            for key, body in rows_of(batches):
                text = body.decode("utf-8", "replace")
                base = in_order(base_spans(text, body))
                yield key, structs(base), structs(random_spans(text, body, base, by, chars_a_token))

        return batches_of(rows(), FOUND)

    return id_and_bytes(df, id_col, text_col).mapInArrow(run, FOUND_DDL)
