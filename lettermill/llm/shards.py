"""Operator 9: materialises token sequences in training order.

Texts are encoded with a public vocabulary, joined by an end token and cut into sequences of one length. Sequences are numbered in
the order of the input's partitions; a keyed Feistel permutation over the next power of four, walked until it falls below
the number of sequences, gives each number its global slot. Slots are dealt by range into shards, files in which each sequence has
the same number of bytes, so that a reader can begin at any slot and go on in order.

Two passes over the texts: the first counts each partition's sequences, the second encodes again and deals out. Keeping the tokens
in between would cost more disk than encoding twice costs time.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.common import batches_of, id_and_bytes, rows_of

#: Tokens of a sequence, sequences of a shard, rounds of the permutation.
LENGTH, SHARD, ROUNDS = 1_024, 8_192, 6
#: Most tasks that write; beyond it a task writes several shards, one after the other.
WRITERS = 10_000
#: Two bytes a token, least significant first.
TOKEN = np.dtype("<u2")


class Feistel:
    """A permutation of 0 .. n - 1 by a key."""

    def __init__(self, n: int, key: str, rounds: int = ROUNDS):
        self.n = n
        self.half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = [np.uint64(int.from_bytes(hashlib.blake2b(f"{key}/{k}".encode(), digest_size=8).digest(), "little")) for k in range(rounds)]

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x ^ key) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(29))) & self.mask

    def _once(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for key in self.keys:
            left, right = right, left ^ self._mix(right, key)
        return left << np.uint64(self.half) | right

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        """The slot of each number; cycle-walking: what falls outside goes round again."""
        out = self._once(numbers.astype(np.uint64))
        while (outside := out >= np.uint64(self.n)).any():
            out[outside] = self._once(out[outside])
        return out.astype(np.int64)


class Encoder:
    """Ids of texts by a vocabulary of at most 65,535 ranks; the first free id ends a text.

    The pattern's look-ahead only matters for white space that comes in runs or ends a text. Other texts are split by the
    pattern without it, which the library matches about twice as fast.
    """

    runs = r"\s+(?!\S)|\s+"
    #: Pairs of the usual white space, and all other white space, which makes a text odd by being there.
    pairs = ("  ", " \n", "\n ", "\n\n")
    others = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.by = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.single = tiktoken.Encoding("single", pat_str=pattern.removesuffix(self.runs) + r"\s", mergeable_ranks=ranks, special_tokens={}) if pattern.endswith(self.runs) else self.by
        self.end = len(ranks)

    def is_odd(self, text: str) -> bool:
        return text[-1:].isspace() or any(p in text for p in self.pairs) or any(c in text for c in self.others)

    def encode(self, text: str) -> list[int]:
        return (self.by if self.is_odd(text) else self.single).encode_ordinary(text)


@functools.lru_cache(maxsize=2)
def encoder(ranks_path: str, pattern: str) -> Encoder:
    return Encoder(ranks_path, pattern)


PLACED = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("number", pa.int64()), ("place", pa.int32())])
_SEGMENTS = pa.list_(pa.struct(list(PLACED)[:3] + [PLACED.field("place")]))
_DEALT = pa.schema([("shard", pa.int64()), ("slot", pa.int64()), ("number", pa.int64()), ("body", pa.binary()), ("segments", _SEGMENTS)])
MANIFEST = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("place", pa.int32()), ("number", pa.int64()), ("slot", pa.int64()), ("shard", pa.int64()), ("offset", pa.int64())])


def sequences(rows: Iterator[tuple], by: Encoder, length: int) -> Iterator[tuple[np.ndarray, list[dict]]]:
    """(tokens, segments) of each sequence of a stream of texts; the last is filled up with end tokens. A text's own end token is its last."""
    held, segments, size = [], [], 0
    for key, body in rows:
        ids = array("H", by.encode(body.decode("utf-8", "replace")))
        ids.append(by.end)
        ids = np.frombuffer(ids, np.uint16).astype(TOKEN, copy=False)
        at = 0
        while at < len(ids):
            take = min(length - size, len(ids) - at)
            held.append(ids[at : at + take])
            segments.append({"id": key, "start": at, "n": take, "place": size})
            at, size = at + take, size + take
            if size == length:
                yield np.concatenate(held), segments
                held, segments, size = [], [], 0
    if size:
        yield np.concatenate([*held, np.full(length - size, by.end, TOKEN)]), segments


def write_in_order(df: DataFrame, folder: str, ranks_path: str, pattern: str, key: str, length: int = LENGTH, per_shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards below `folder` and returns the manifest: one row for each part of each text in a sequence.

    Columns id, start and n (the part's tokens within the text), place (within the sequence), number and slot of the sequence,
    shard, and offset, the byte at which the sequence begins in its shard. A null text is empty and has its end token only; a
    null id stays null; repeated rows are separate texts; an empty table writes nothing and gives no rows; other columns are not
    carried. `df` must give the same partitions each time it is read, as files do; if it does not, the second pass says so. `folder` is a URI
    that all tasks reach. A shard is written under a hidden name and then moved to one of its own, so nothing is ever deleted or
    written over: a task that runs twice leaves two whole files of equal bytes, and a reader takes either.
    """
    source = id_and_bytes(df, id_col, text_col)
    width = length * TOKEN.itemsize
    folder = folder.rstrip("/")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = encoder(ranks_path, pattern)
        tokens = sum(len(by.encode(body.decode("utf-8", "replace"))) + 1 for _, body in rows_of(batches))
        yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([-(-tokens // length)], pa.int64())], names=["part", "n"])

    counted = source.mapInArrow(count, "part int, n long").toArrow()
    sizes = np.zeros(1 + max(counted.column("part").to_pylist(), default=0), np.int64)  # eight bytes a partition, for all tasks
    sizes[counted.column("part").to_numpy()] = counted.column("n").to_numpy()
    total = int(sizes.sum())
    held = df.sparkSession.sparkContext.broadcast(sizes)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, part = encoder(ranks_path, pattern), TaskContext.get().partitionId()
        size = int(held.value[part]) if part < len(held.value) else 0
        first = int(held.value[:part].sum())
        slots = Feistel(total, key).slots(np.arange(first, first + size)).tolist()

        def rows() -> Iterator[tuple]:
            made = 0
            for tokens, segments in sequences(rows_of(batches), by, length):
                if made < size:
                    slot = slots[made]
                    yield slot // per_shard, slot, first + made, tokens.tobytes(), segments
                made += 1
            if made != size:
                raise RuntimeError(f"partition {part} had {size} sequences when counted and has {made} now")

        return batches_of(rows(), _DEALT)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            shard, out = None, None
            for at, slot, number, body, segments in rows_of(batches):
                if at != shard:
                    if out is not None:
                        out.close()
                    shard, out = at, ShardFile(folder, at)
                out.put(body)
                for s in segments:
                    yield s["id"], s["start"], s["n"], s["place"], number, slot, shard, (slot - shard * per_shard) * width
            if out is not None:
                out.close()

        return batches_of(rows(), MANIFEST, 5000)

    shards = max(1, -(-total // per_shard))
    dealt = source.mapInArrow(deal, "shard long, slot long, number long, body binary, segments array<struct<id:long,start:long,n:int,place:int>>")
    writers = min(shards, WRITERS)
    writer = F.floor(F.col("shard") * writers / shards).cast("int")  # a range of shards
    return dealt.repartitionById(writers, writer).sortWithinPartitions("shard", "slot").mapInArrow(write, "id long, start long, n int, place int, number long, slot long, shard long, offset long")


class ShardFile:
    """A shard being written."""

    def __init__(self, folder: str, shard: int):
        self.fs, base = pa.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(base, recursive=True)
        name = f"{shard_name(shard)}-{uuid.uuid4().hex}.bin"
        self.name, self.draft = f"{base}/{name}", f"{base}/.{name}"
        self.file = self.fs.open_output_stream(self.draft)

    def put(self, body: bytes) -> None:
        self.file.write(body)

    def close(self) -> None:
        self.file.close()
        self.fs.move(self.draft, self.name)


def shard_name(shard: int) -> str:
    """How the names of a shard's files begin."""
    return f"shard-{shard:08d}"


def read_slots(folder: str, first: int, last: int, length: int = LENGTH, per_shard: int = SHARD) -> Iterator[np.ndarray]:
    """The sequences of slots first .. last - 1 in order; each read begins where the last one ended."""
    fs, base = pa.fs.FileSystem.from_uri(folder.rstrip("/"))
    there = {info.base_name.rpartition("-")[0]: info.path for info in fs.get_file_info(pa.fs.FileSelector(base)) if not info.base_name.startswith(".")}
    width = length * TOKEN.itemsize
    while first < last:
        shard = first // per_shard
        upto = min(last, (shard + 1) * per_shard)
        with fs.open_input_file(there[shard_name(shard)]) as file:
            file.seek((first - shard * per_shard) * width)
            for _ in range(first, upto):
                yield np.frombuffer(file.read(width), TOKEN)
        first = upto
