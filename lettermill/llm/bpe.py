"""Operator 1: BPE encoding and decoding with a public vocabulary file.

Encoding: a text is cut into pieces (added tokens, then white-space chunks, then the file's split pattern); each piece is a
doubly linked list of symbols, and a priority queue of (merge rank, position) joins neighbours, skipping entries that earlier
merges made stale. Decoding joins the vocabulary strings of the ids; without a decoder in the file that is by one space.
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lettermill.llm.common import batches_of, id_and_bytes, rows_of

#: Distinct chunks whose ids a worker remembers; beyond it the memory starts afresh, which only costs time.
REMEMBERED = 400_000
#: White space of the normaliser: Unicode's White_Space property.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters that str.split() takes for white space but the normaliser does not.
NOT_SPACES = "\x1c\x1d\x1e\x1f"
#: Letters and numbers that Unicode assigned after version 16, which the tokenizers library goes by; its split pattern takes them for neither.
NEWER = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011df1"
    "\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff3\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    "\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24"
    "\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5"
    "\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead"
    "\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
#: Capitals of Unicode 16 and 17, each with its small letter, which Python's tables may not have yet.
NEW_CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B}
NEW_CAPITALS |= {0x10D50 + k: 0x10D70 + k for k in range(22)} | {0x16EA0 + k: 0x16EBB + k for k in range(25)}
#: A code point that is not assigned and stands for NEWER ones.
UNASSIGNED = "\u0378"


_NEWER = regex.compile(f"[{NEWER}]")
_NEW_CAPITALS = regex.compile("[" + "".join(map(chr, NEW_CAPITALS)) + "]")


def byte_letters() -> dict[int, str]:
    """The printable letter of each byte in byte-level vocabularies: itself where printable, else one from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class BpeTokenizer:
    """Ids and texts by a tokenizer file whose normaliser is NFC, one space for white space, lower case."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        added = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.strings: dict[int, str] = {i: s for s, i in chain(self.vocab.items(), added.items())}
        self.added = added
        self.cut_added = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.merges[self.vocab[left], self.vocab[right]] = (rank, self.vocab[left + right])
        split = next(x["pattern"]["Regex"] for x in data["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.piece = regex.compile(split.replace(r"\s", SPACES), regex.V0)
        self.space = regex.compile(f"[{SPACES}]+")
        letters = byte_letters()
        self.first = [self.vocab[letters[b]] for b in range(256)]
        self.last = [self.vocab[letters[b] + self.end] for b in range(256)]
        self.known = _Chunks(self)

    def merge(self, piece: str) -> list[int]:
        """Ids of one piece."""
        raw = piece.encode("utf-8", "surrogatepass")
        ids = [self.first[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        size = len(ids)
        if size == 1:
            return ids
        merges = self.merges
        before, after = list(range(-1, size - 1)), list(range(1, size + 1))
        queue = []
        for at in range(size - 1):
            if (found := merges.get((ids[at], ids[at + 1]))) is not None:
                queue.append((found[0], at, found[1], ids[at], ids[at + 1]))
        heapq.heapify(queue)
        while queue:
            _, at, joined, left, right = heapq.heappop(queue)
            behind = after[at]
            if ids[at] != left or behind >= size or ids[behind] != right:
                continue  # stale: one of the two symbols has been merged since
            ids[at], ids[behind] = joined, -1
            after[at] = nxt = after[behind]
            if nxt < size:
                before[nxt] = at
                if (found := merges.get((joined, ids[nxt]))) is not None:
                    heapq.heappush(queue, (found[0], at, found[1], joined, ids[nxt]))
            if (prev := before[at]) >= 0 and (found := merges.get((ids[prev], joined))) is not None:
                heapq.heappush(queue, (found[0], prev, found[1], ids[prev], joined))
        return [i for i in ids if i >= 0]

    def pieces(self, chunk: str) -> list[str]:
        """Cuts a text by the split pattern, whose tables here may be newer than the library's."""
        if not chunk.isascii() and _NEWER.search(chunk):
            return [chunk[m.start() : m.end()] for m in self.piece.finditer(_NEWER.sub(UNASSIGNED, chunk))]
        return self.piece.findall(chunk)

    def chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of a normalised text without white space."""
        return tuple(chain.from_iterable(map(self.merge, self.pieces(chunk))))

    def plain(self, text: str) -> list[int]:
        """Ids of a text without added tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower-cased letter by letter, so without a final sigma
            if _NEW_CAPITALS.search(text):
                text = text.translate(NEW_CAPITALS)
        text = text.lower()
        chunks = self.space.split(text) if any(c in text for c in NOT_SPACES) else text.split()
        return list(chain.from_iterable(map(self.known.__getitem__, chunks)))

    def encode(self, text: str) -> list[int]:
        if self.cut_added is None or "<|" not in text and not any(s in text for s in self.added):
            return self.plain(text)
        out: list[int] = []
        for part in self.cut_added.split(text):
            if part in self.added:
                out.append(self.added[part])
            elif part:
                out += self.plain(part)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join([s for i in ids if (s := self.strings.get(i)) is not None])


class _Chunks(dict):
    def __init__(self, of: BpeTokenizer):
        self.of = of

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        ids = self.of.chunk(chunk)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(chunk) <= 64:
            self[chunk] = ids
        return ids


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> BpeTokenizer:
    """One tokenizer for each worker process and file."""
    return BpeTokenizer(path)


ENCODED = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


def encode_decode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, ids (array<int>), decoded (string), one row for each row of `df`.

    A null or empty text has no ids and decodes to the empty string; repeated rows give repeated results; a null id stays
    null; an empty table gives no rows; other columns of `df`, whatever their names, are not carried. Bytes that are not
    UTF-8 count as U+FFFD. One pass without a shuffle: each text is independent of the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = tokenizer(tokenizer_path)

        def rows() -> Iterator[tuple]:
            for key, body in rows_of(batches):
                ids = by.encode(body.decode("utf-8", "replace"))
                yield key, ids, by.decode(ids)

        return batches_of(rows(), ENCODED)

    return id_and_bytes(df, id_col, text_col).mapInArrow(run, "id long, ids array<int>, decoded string")
