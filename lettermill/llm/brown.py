"""Operator 6: language-model scores by class-based n-grams.

Words fall into classes; the chance of a token is that of its class after the class before it, times that of the word within
its class. Classes come from exchange clustering in two tiers. The SEEDS most frequent words are moved one at a time to the
class that raises the likelihood of the class bigrams most, until no move helps, on one table whose side is fixed. Then every
word of the training corpus, however rare, is offered every class: a sweep over the corpus gives each word its counts of classes
before and after it, and rounds over these counts take all words to the class in which their neighbours are likeliest and work
out the classes' tables anew, as long as the likelihood rises. The next sweep counts by the classes found; it is kept only if the
class bigrams of the corpus get likelier.

Transitions back off to class frequencies. Each word gives up a discount of its class for the one type that stands for all words
never seen; it may come from any class, so that a text with such words is scored by a forward pass over classes.

All counts of words, and the classes of words, stay distributed. Only the words above a count that at most HOT words reach go to
every task, with their classes; the classes of others are looked up by a join. Texts are read twice, to count words and to write
them as numbers; all else reads the numbers.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.common import OUT_ROWS, Folder, batches_of, release, rows_of

#: Words that every task may hold, words clustered one by one, and classes.
HOT, SEEDS, CLASSES = 200_000, 600, 48
#: Most sweeps over the corpus and most rounds over one sweep's counts, and the least rise of the likelihood, as a part of it, for another sweep and round.
SWEEPS, ROUNDS, RISE, RISE_OF_ROUND = 4, 30, 0.003, 0.0005
#: The token that ends a text; no word is empty.
END = b""
#: Words, tokens and cells that a task counts before it hands counts on.
FLUSH, SLICE, CELLS = 300_000, 1_000_000, 3_000_000
#: The low bits of a key hold a cell: a class after the word, or CLASSES more for one before it.
CELL_BITS = 7


def held_out(id_col: str = "id"):
    """Texts the model does not learn from: crc32 of the id as text is 2 modulo 7; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def tokens(body: bytes) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, then the end."""
    words = body.lower().split()
    words.append(END)
    return words


def key_of(word: bytes) -> int:
    """The number of a word in clustering; words of the same number, of which there are hardly any, share a class."""
    return xxhash.xxh64_intdigest(word) >> CELL_BITS + 1


def count_words(texts: DataFrame) -> DataFrame:
    """Columns word (binary) and n: how often each token occurs in the column body."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for (body,) in rows_of(batches):
            seen.update(tokens(body))
            if len(seen) >= FLUSH:
                yield from batches_of(seen.items(), schema, 10_000)
                seen.clear()
        yield from batches_of(seen.items(), schema, 10_000)

    return texts.select("body").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _step():
    return F.floor(F.log2("n") * 16)


def hot_words(counts: DataFrame, most: int = HOT) -> tuple[list[tuple[bytes, int]], int | None]:
    """The end, then all words of at least some count, that count as low as leaves at most `most` of them, by falling count, then word; and the step of that count."""
    steps = counts.where(F.length("word") > 0).groupBy(_step().alias("step")).count().orderBy(F.desc("step")).collect()
    total, least = 0, None
    for r in steps:
        total += r["count"]
        if total > most:
            break
        least = r["step"]
    rows = counts.where((F.length("word") == 0) | F.lit(False if least is None else None) | (_step() >= F.lit(least if least is not None else 10**6))).toArrow()
    found = dict(zip(rows.column("word").to_pylist(), rows.column("n").to_pylist(), strict=True))
    ends = found.pop(END, 0)
    return [(END, ends), *sorted(found.items(), key=lambda x: (-x[1], x[0]))], least


class Shared:
    """A broadcast that names itself, so that a worker process builds an index of it once."""

    def __init__(self, df: DataFrame, value):
        self.broadcast, self.bid = df.sparkSession.sparkContext.broadcast(value), uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value


_INDEX: dict[str, dict[bytes, int]] = {}


def _index(shared: Shared) -> dict[bytes, int]:
    if shared.bid not in _INDEX:
        _INDEX.clear()
        _INDEX[shared.bid] = {w: k for k, w in enumerate(shared.value)}
    return _INDEX[shared.bid]


ENCODED = pa.schema([("uid", pa.int64()), ("id", pa.int64()), ("codes", pa.binary()), ("cold", pa.binary())])


def encode(docs: DataFrame, hot: list[bytes]) -> DataFrame:
    """Columns uid, id, codes (int32 of each token: its place among the hot words, or -1) and cold (the other words, joined by spaces) of each row.

    A uid names a row once these are written down; it says which task wrote it.
    """
    shared = Shared(docs, hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, base = _index(shared), TaskContext.get().partitionId() << 36

        def rows() -> Iterator[tuple]:
            for at, (key, body) in enumerate(rows_of(batches)):
                words = tokens(body)
                codes = np.fromiter(map(index.get, words, repeat(-1)), np.int32, len(words))
                cold = np.flatnonzero(codes < 0).tolist()
                yield base + at, key, codes.tobytes(), b" ".join([words[k] for k in cold])

        return batches_of(rows(), ENCODED)

    return docs.select("id", "body").mapInArrow(run, "uid long, id long, codes binary, cold binary")


def _numbers(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Codes of about `size` tokens of texts put together, each text's after an end's, and their cold words."""
    held, cold, total = [], [], 0
    for codes, words in rows_of(batches):
        held.append(np.frombuffer(codes, np.int32))
        if words:
            cold += words.split(b" ")
        total += len(held[-1])
        if total >= size:
            yield np.concatenate([np.zeros(1, np.int32), *held]), cold
            held, cold, total = [], [], 0
    if held:
        yield np.concatenate([np.zeros(1, np.int32), *held]), cold


def _table(df: DataFrame, side: int, run) -> np.ndarray:
    """The sums of the cells that `run` yields for codes, as a table of `side` by `side`."""
    schema = pa.schema([("cell", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(side * side, np.int64)
        for codes, _ in _numbers(batches):
            table += run(codes)
        cells = np.flatnonzero(table)
        for at in range(0, len(cells), 100_000):
            yield pa.record_batch([pa.array(cells[at : at + 100_000]), pa.array(table[cells[at : at + 100_000]])], schema=schema)

    got = df.select("codes", "cold").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(side * side, np.int64)
    table[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return table.reshape(side, side)


def count_pairs(encoded: DataFrame, of: np.ndarray, side: int) -> np.ndarray:
    """How often a group follows another one in texts, where both words are of a group: `of` has each hot word's group, or -1."""
    of = of.astype(np.int32)

    def run(codes: np.ndarray) -> np.ndarray:
        mine = np.where(codes >= 0, of[codes], -1)
        a, b = mine[:-1], mine[1:]
        both = (a >= 0) & (b >= 0)
        return np.bincount(a[both].astype(np.int64) * side + b[both], minlength=side * side)

    return _table(encoded, side, run)


def _merged(cells: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums by cell, in order."""
    order = np.argsort(cells, kind="stable")
    cells, n = cells[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])) if len(cells) else np.zeros(0, np.int64)
    return cells[first], np.add.reduceat(n, first) if len(first) else n


PROFILES = pa.schema([("key", pa.int64()), ("profile", pa.binary())])
#: A profile is a run of these, in order of cells.
CELL = np.dtype([("cell", "u1"), ("n", "<i8")])


def packed_profiles(packed: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Batches of PROFILES from sums by packed key and cell, in order; a cell beyond the classes' marks a word and is no cell."""
    keys, some = packed >> CELL_BITS, packed & (2**CELL_BITS - 1) < 2 * CLASSES
    words, first = np.unique(keys, return_index=True)
    cells = np.empty(int(some.sum()), CELL)
    cells["cell"], cells["n"] = packed[some] & (2**CELL_BITS - 1), n[some]
    ends = np.concatenate([[0], np.cumsum(np.add.reduceat(some.astype(np.int64), first))]).astype(np.int32) * CELL.itemsize
    for at in range(0, len(words), 20_000):
        part = ends[at : at + 20_001]
        body = pa.py_buffer(cells.view(np.uint8)[part[0] : part[-1]])
        binary = pa.BinaryArray.from_buffers(pa.binary(), len(part) - 1, [None, pa.py_buffer((part - part[0]).astype(np.int32)), body])
        yield pa.record_batch([pa.array(words[at : at + 20_000]), binary], schema=PROFILES)


def unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of PROFILES: keys; and cell by cell the row, the cell and the count."""
    bodies = batch.column(1).cast(pa.binary())
    sizes = pc.binary_length(bodies).to_numpy(zero_copy_only=False).astype(np.int64) // CELL.itemsize
    _, offsets, body = bodies.buffers()
    total, cells = int(sizes.sum()), np.zeros(0, CELL)
    if total:
        cells = np.frombuffer(body, CELL, total, int(np.frombuffer(offsets, np.int32)[bodies.offset]))
    return batch.column(0).to_numpy(), np.repeat(np.arange(len(sizes)), sizes), cells["cell"].astype(np.int64), cells["n"]


def beside(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Packed key and cell of every known neighbour (`of` has each token's class, or -1) of tokens in order, and a mark for each token without one, so that its word has a row too."""
    keys = keys << CELL_BITS
    after, before = of[1:] >= 0, of[:-1] >= 0
    alone = np.ones(len(keys), bool)
    alone[:-1] &= ~after
    alone[1:] &= ~before
    return np.concatenate([(keys[:-1] | of[1:])[after], (keys[1:] | (CLASSES + of[:-1]))[before], keys[alone] | 2 * CLASSES])


def profiles(encoded: DataFrame, hot_keys: np.ndarray, hot_class: np.ndarray) -> DataFrame:
    """Columns key and profile: for each word the counts of classes after and before it, of the neighbours whose class is known (not -1).

    Every word of the texts has a row, one without such neighbours an empty one. Tasks add up before the one shuffle, which brings
    of each word, even the most frequent one, one row of a few hundred bytes from each task.
    """
    hot_keys, hot_class = hot_keys.astype(np.int64), hot_class.astype(np.int64)
    no_cell = 2 * CLASSES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def merge() -> None:
            parts[:] = [_merged(*(np.concatenate(x) for x in zip(*parts, strict=True)))]

        for codes, cold in _numbers(batches):
            known = codes >= 0
            keys, of = hot_keys[codes], np.where(known, hot_class[codes], -1)
            keys[~known] = np.fromiter(map(key_of, cold), np.int64, len(cold))
            parts.append(np.unique(beside(keys, of), return_counts=True))
            if sum(len(c) for c, _ in parts) > CELLS:
                merge()
                if len(parts[0][0]) > CELLS // 2:
                    yield from packed_profiles(*parts[0])
                    parts.clear()
        if parts:
            merge()
            yield from packed_profiles(*parts[0])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            keys, rows, cells, n = unpacked(batch)
            empty = keys[np.bincount(rows, minlength=len(keys)) == 0] << CELL_BITS | no_cell
            held += [(keys[rows] << CELL_BITS | cells, n), (empty, np.zeros(len(empty), np.int64))]
            if sum(len(c) for c, _ in held) < CELLS // 4:
                continue
            packed, n = _merged(*(np.concatenate(x) for x in zip(*held, strict=True)))
            cut = np.searchsorted(packed, packed[-1] >> CELL_BITS << CELL_BITS)  # the last word may go on in the next batch
            if cut:
                yield from packed_profiles(packed[:cut], n[:cut])
            held = [(packed[cut:], n[cut:])]
        if sum(len(c) for c, _ in held):
            yield from packed_profiles(*_merged(*(np.concatenate(x) for x in zip(*held, strict=True))))

    found = encoded.select("codes", "cold").mapInArrow(count, "key long, profile binary")
    return found.repartition("key").sortWithinPartitions("key").mapInArrow(gather, "key long, profile binary")


def _logs(table: np.ndarray) -> np.ndarray:
    """log chance of each cell in each class, from counts of CLASSES by 2 * CLASSES cells. A class without words says nothing and draws none."""
    out = np.empty(table.shape)
    for part in (slice(0, CLASSES), slice(CLASSES, 2 * CLASSES)):
        half = table[:, part] + 0.01
        out[:, part] = np.log(half / half.sum(1, keepdims=True))
    out[table.sum(1) == 0] = -1e6
    return out


def _best(batch: pa.RecordBatch, logs: np.ndarray, default: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of profiles: keys, each word's best class, and its cells one by one with their words' classes and counts."""
    keys, rows, cells, n = unpacked(batch)
    dense = np.zeros((len(keys), 2 * CLASSES))
    dense[rows, cells] = n
    best = np.where(np.bincount(rows, minlength=len(keys)) > 0, (dense @ logs.T).argmax(1), default)
    return keys, best, cells, best[rows], n


def _find(among: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of `keys` are in the ordered `among`, and where."""
    if not len(among):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return among[at] == keys, at


def assign(found: DataFrame, logs: np.ndarray, default: int, fixed: tuple[np.ndarray, np.ndarray], only: np.ndarray | None = None) -> DataFrame:
    """Columns key and cls of the words of profiles, or of those with one of the keys `only`. `fixed` has keys, in order, with classes that they keep."""
    schema = pa.schema([("key", pa.int64()), ("cls", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, best, *_ = _best(batch, logs, default)
            mine, at = _find(fixed[0], keys)
            best[mine] = fixed[1][at[mine]]
            if only is not None:
                mine, _ = _find(only, keys)
                keys, best = keys[mine], best[mine]
            yield pa.record_batch([pa.array(keys), pa.array(best.astype(np.int32))], schema=schema)

    return found.mapInArrow(run, "key long, cls int")


def retable(found: DataFrame, logs: np.ndarray, default: int) -> np.ndarray:
    """Counts of CLASSES by 2 * CLASSES cells with every word in its best class."""
    schema = pa.schema([("cell", pa.int32()), ("n", pa.int64())])
    side = 2 * CLASSES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(CLASSES * side, np.int64)
        for batch in batches:
            _, _, cells, of, n = _best(batch, logs, default)
            table += np.bincount(of * side + cells, n, CLASSES * side).astype(np.int64)
        cells = np.flatnonzero(table)
        yield pa.record_batch([pa.array(cells.astype(np.int32)), pa.array(table[cells])], schema=schema)

    got = found.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(CLASSES * side, np.int64)
    table[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return table.reshape(CLASSES, side)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


def fit(table: np.ndarray) -> float:
    """Log likelihood of the cells of all words given their classes."""
    return float(_xlogx(table).sum() - sum(_xlogx(table[:, part].sum(1)).sum() for part in (slice(0, CLASSES), slice(CLASSES, None))))


def settle_classes(found: DataFrame, table: np.ndarray) -> tuple[np.ndarray, int]:
    """The tables' logs, and the class of words without known neighbours, after rounds over profiles: all words go to their best class, and the tables are worked out anew.

    Neither step can lower the likelihood but for the smoothing; a round that lowers it is given up, and one that hardly raises it is the last.
    """
    logs, default, best = _logs(table), int(table.sum(1).argmax()), None
    kept = logs, default
    for _ in range(ROUNDS):
        moved = retable(found, logs, default)
        now = fit(moved)
        if best is not None and now <= best:
            break
        kept, last = (logs, default), best is not None and now - best <= RISE_OF_ROUND * abs(best)
        if last:
            break
        best, logs, default = now, _logs(moved), int(moved.sum(1).argmax())
    return kept


def likelihood(table: np.ndarray) -> float:
    """Log likelihood of class bigrams, without what no classes change."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(0)).sum() - _xlogx(table.sum(1)).sum())


def exchange(pairs: np.ndarray, classes: int = CLASSES, rounds: int = 1_000) -> np.ndarray:
    """Class of each item: each item in turn goes where the likelihood of the class bigrams is greatest, until none moves. A rise below what such sums are exact to is none."""
    side = len(pairs)
    least = 1e-11 * float(_xlogx(pairs.sum() + 1.0)) + 1e-9
    own = np.diag(pairs).astype(float)
    weight = pairs.sum(0) + pairs.sum(1)
    order = np.argsort(-weight, kind="stable")
    order = order[weight[order] > 0]
    of = np.zeros(side, np.int64)
    of[order] = np.arange(len(order)) % classes
    member = np.zeros((side, classes))
    member[np.arange(side), of] = 1
    member[weight == 0] = 0
    out_of, into = pairs @ member, pairs.T @ member  # to and from each class, by item
    table = member.T @ out_of
    for _ in range(rounds):
        moved = 0
        for w in order:
            was, to, back = of[w], out_of[w].copy(), into[w].copy()
            to[was] -= own[w]
            back[was] -= own[w]
            table[was, :] -= to
            table[:, was] -= back
            table[was, was] -= own[w]
            leaving, coming = table.sum(1) + back, table.sum(0) + to  # how often each class is left and entered by other items
            row, column = table + to, table.T + back  # class c with the item in it: its row and its column
            gain = (_xlogx(row) - _xlogx(table)).sum(1) + (_xlogx(column) - _xlogx(table.T)).sum(1)
            d = np.arange(classes)
            gain += _xlogx(table[d, d] + to + back + own[w]) - _xlogx(row[d, d]) - _xlogx(column[d, d]) + _xlogx(table[d, d])
            gain -= _xlogx(leaving + pairs[w].sum()) - _xlogx(leaving) + _xlogx(coming + pairs[:, w].sum()) - _xlogx(coming)
            best = int(gain.argmax())
            if gain[best] <= gain[was] + least:
                best = int(was)
            table[best, :] += to
            table[:, best] += back
            table[best, best] += own[w]
            if best != was:
                of[w], moved = best, moved + 1
                out_of[:, was] -= pairs[:, w]
                out_of[:, best] += pairs[:, w]
                into[:, was] -= pairs[w]
                into[:, best] += pairs[w]
        if not moved:
            break
    return of


def begin_empty(found: DataFrame, table: np.ndarray, keys: np.ndarray) -> None:
    """Gives each class that has no seed the profile of one of the most frequent other words to begin with."""
    empty = np.flatnonzero(table.sum(1) == 0).tolist()
    at = dict(zip(keys[: len(empty)].tolist(), empty, strict=False))
    if at:
        for r in found.where(F.col("key").isin(*at)).collect():
            cells = np.frombuffer(r["profile"], CELL)
            table[at[r["key"]], cells["cell"]] += cells["n"]


class Clusters:
    """Where a corpus's words are: profiles with what places every word by them, and the classes of the hot words."""

    def __init__(self, found: DataFrame, logs: np.ndarray, default: int, fixed: tuple[np.ndarray, np.ndarray], hot_class: np.ndarray):
        self.found, self.logs, self.default, self.fixed, self.hot_class = found, logs, default, fixed, hot_class

    def words(self) -> DataFrame:
        """Columns key and cls of every word of the training corpus."""
        return assign(self.found, self.logs, self.default, self.fixed)


def cluster(train: DataFrame, hot: list[tuple[bytes, int]], seeds: int, folder: Folder) -> Clusters:
    """Classes of all words of the encoded training texts. In the first sweep the seeds stay where the exchange put them, since only they have classes yet."""
    spark = train.sparkSession
    keys = np.array([key_of(w) for w, _ in hot], np.int64)
    ordered = np.unique(keys)
    seeds = min(seeds, len(hot))
    item = np.where(np.arange(len(hot)) < seeds, np.arange(len(hot)), -1)
    pairs = count_pairs(train, item, seeds)
    seed_class = exchange(pairs)
    member = np.zeros((seeds, CLASSES))
    member[np.arange(seeds), seed_class] = 1
    table = np.concatenate([member.T @ pairs @ member, member.T @ pairs.T @ member], axis=1)
    hot_class = np.where(item >= 0, seed_class[np.maximum(item, 0)], -1)
    seed_keys, place = np.unique(keys[:seeds], return_index=True)
    fixed = seed_keys, seed_class[place]
    kept = best = None
    for sweep in range(SWEEPS):
        found = folder.keep(profiles(train, keys, hot_class), f"profiles-{sweep}")
        release(spark)
        if not sweep:
            begin_empty(found, table, keys[seeds:])
        logs, default = settle_classes(found, table)
        got = assign(found, logs, default, fixed, ordered).toArrow()
        by_key = dict(zip(got.column("key").to_pylist(), got.column("cls").to_pylist(), strict=True))
        moved = np.array([by_key.get(k, default) for k in keys.tolist()], np.int64)
        now = count_pairs(train, moved, CLASSES)
        risen = likelihood(now)
        if best is not None and risen <= best:
            folder.drop(f"profiles-{sweep}")
            break
        if sweep:
            folder.drop(f"profiles-{sweep - 1}")
        enough = best is not None and risen - best <= RISE * abs(best)
        kept, best, hot_class = Clusters(found, logs, default, fixed, moved), risen, moved
        table = np.concatenate([now, now.T], axis=1)
        fixed = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if enough:
            break
    return kept


def transitions(table: np.ndarray) -> np.ndarray:
    """log10 chance of a class after another one, smoothed with the classes' frequencies by how many classes were seen to follow."""
    alone = (table.sum(0) + 1) / (table.sum() + len(table))
    follow = np.maximum(1, (table > 0).sum(1, keepdims=True))
    return np.log10((table + follow * alone) / (table.sum(1, keepdims=True) + follow))


class Emissions:
    """For each class: its tokens, its distinct words, and the discount that each word gives up for unseen ones."""

    def __init__(self, n: np.ndarray, distinct: np.ndarray, once: np.ndarray, twice: np.ndarray):
        self.n, self.distinct = n.astype(float), distinct.astype(float)
        self.discount = np.clip(np.where(once > 0, once / np.maximum(1, once + 2 * twice), 0.5), 0.05, 0.95)

    def seen(self, count: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.log10((count - self.discount[of]) / np.maximum(1, self.n[of]))

    def unseen(self) -> np.ndarray:
        """Chance of the type that stands for words never seen, by class; in a class without words it is certain."""
        return np.where(self.n > 0, self.discount * self.distinct / np.maximum(1, self.n), 1.0)


def path(seq: np.ndarray, start: int, moves: np.ndarray, unseen: np.ndarray) -> tuple[float, float]:
    """log10 chance of a text's classes, where -1 is a token never seen, which any class may have put there; and the part of it up to known tokens.

    `moves` are log10 chances. Known tokens need their class's move only; from a token never seen to the next known one the
    chance is summed over all classes in between.
    """
    before = np.concatenate([[start], seq[:-1]])
    plain = (seq >= 0) & (before >= 0)
    known = whole = float(moves[before[plain], seq[plain]].sum())
    if plain.all():
        return whole, known
    chance, state = 10.0**moves, None
    for at in np.flatnonzero(~plain).tolist():
        here = chance[before[at]] if before[at] >= 0 else state @ chance
        if seq[at] >= 0:
            one = float(np.log10(here[seq[at]]))
            known += one
        else:
            state = here * unseen
            total = state.sum()
            one = float(np.log10(total))
            state = state / total
        whole += one
    return whole, known


FILLED = pa.schema(
    [("id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("known_base", pa.float64()), ("emitted", pa.float64()), ("seq", pa.binary())]
)
FILLED_DDL = "id long, n_tokens long, n_known long, base double, known_base double, emitted double, seq binary"
SCORED = pa.schema(
    [("id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("base_known", pa.float64()), ("score_known", pa.float64())]
)
SCORED_DDL = "id long, n_tokens long, n_known long, base_score double, score double, base_known double, score_known double"
_PARTS = pa.schema([("uid", pa.int64()), ("place", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("cls", pa.int32()), ("codes", pa.binary())])
_COLD = pa.schema([("uid", pa.int64()), ("place", pa.int32()), ("word", pa.binary())])


def fill(encoded: DataFrame, words: DataFrame, hot: list[tuple[bytes, int]], hot_class: np.ndarray, emit: Emissions, unit: float) -> DataFrame:
    """FILLED: each text's classes (int8; -1 for words never seen), and its sums of what needs no transitions.

    `words` has word, n and cls of all words that are not hot. A cold word's count bounds how often it is joined; one shuffle by
    text brings what the join found back to its text, in order.
    """
    n_hot = np.array([n for _, n in hot], np.int64)
    class_hot = np.where(n_hot > 0, hot_class, -1).astype(np.int8)
    base_hot = np.log10((n_hot + 1) / unit)
    emit_hot = np.where(n_hot > 0, emit.seen(np.maximum(n_hot, 1), hot_class), 0.0)

    def cold_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, OUT_ROWS):
                uids, codes, colds = batch.slice(at, OUT_ROWS).columns
                sizes, places, words = [], [], []
                for one, cold in zip(codes.to_pylist(), colds.to_pylist(), strict=True):
                    if cold:
                        places.append(np.flatnonzero(np.frombuffer(one, np.int32) < 0))
                        words += cold.split(b" ")
                    sizes.append(len(places[-1]) if cold else 0)
                if words:
                    uid = np.repeat(uids.to_numpy(), sizes)
                    yield pa.record_batch([pa.array(uid), pa.array(np.concatenate(places).astype(np.int32)), pa.array(words, pa.binary())], schema=_COLD)

    def put(key, codes: bytes, places: list[np.ndarray], counts: list[np.ndarray], classes: list[np.ndarray]) -> tuple:
        codes = np.frombuffer(codes, np.int32)
        warm = codes >= 0
        seq = np.where(warm, class_hot[codes], -1).astype(np.int8)
        at, n, cls = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (places, counts, classes))
        seen = n > 0
        seq[at[seen]] = cls[seen]
        known_base = base_hot[codes[warm & (seq >= 0)]].sum() + np.log10((n[seen] + 1) / unit).sum()
        emitted = emit_hot[codes[warm]].sum() + (emit.seen(n[seen], cls[seen]).sum() if seen.any() else 0.0)
        known = int((seq >= 0).sum())
        return key, len(seq), known, float(known_base + (len(seq) - known) * np.log10(1 / unit)), float(known_base), float(emitted), seq.tobytes()

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            now, lists = None, ([], [], [])
            for batch in batches:
                place, n, cls = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 3, 4))
                heads = np.flatnonzero(place < 0).tolist()
                at = 0
                for head in [*heads, len(place)]:
                    if head > at:
                        for held, x in zip(lists, (place, n, cls), strict=True):
                            held.append(x[at:head])
                    if head < len(place):
                        if now is not None:
                            yield put(*now, *lists)
                        now, lists = (batch.column(2)[head].as_py(), batch.column(5)[head].as_py()), ([], [], [])
                    at = head + 1
            if now is not None:
                yield put(*now, *lists)

        return batches_of(rows(), FILLED)

    cold = encoded.select("uid", "codes", "cold").mapInArrow(cold_words, "uid long, place int, word binary").join(words, "word", "left")
    none = F.lit(None)
    heads = encoded.select("uid", F.lit(-1).alias("place"), "id", F.lit(0).cast("long").alias("n"), F.lit(0).alias("cls"), "codes")
    looked = cold.select("uid", "place", none.cast("long").alias("id"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("cls", F.lit(0)).cast("int").alias("cls"), none.cast("binary").alias("codes"))
    return heads.union(looked).repartition("uid").sortWithinPartitions("uid", "place").mapInArrow(assemble, FILLED_DDL)


def count_moves(filled: DataFrame, start: int) -> np.ndarray:
    """How often each class follows each other one in the texts, all of whose words are known; a text begins after the end's class."""
    as_codes = filled.select(F.col("seq").alias("codes"), F.lit(b"").alias("cold"))
    side = CLASSES
    schema = pa.schema([("cell", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(side * side, np.int64)
        first = np.array([start], np.int8).tobytes()
        for batch in batches:
            joined = np.frombuffer(first + b"".join(batch.column(0).to_pylist()), np.int8).astype(np.int64)
            table += np.bincount(joined[:-1] * side + joined[1:], minlength=side * side)
        cells = np.flatnonzero(table)
        yield pa.record_batch([pa.array(cells), pa.array(table[cells])], schema=schema)

    got = as_codes.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(side * side, np.int64)
    table[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return table.reshape(side, side)


def _keyed(counts: DataFrame) -> DataFrame:
    schema = pa.schema([("key", pa.int64()), ("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(list(map(key_of, batch.column(0).to_pylist())), pa.int64()), batch.column(0), batch.column(1)], schema=schema)

    return counts.select("word", "n").mapInArrow(run, "key long, word binary, n long")


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, seeds: int = SEEDS) -> DataFrame:
    """Columns id, held_out, n_tokens, n_known, train_tokens, base_score, score, base_known, score_known, one row for each row of `df`.

    base_score sums log10((c + 1) / (N + V + 1)) over a text's tokens; score is the class model's log10 chance of the text; the last two are the
    parts of both that known tokens have. A null text is empty and consists of its end; a null id is learned from; repeated rows are learned from
    and scored as often as they occur; without training texts every word is unseen; an empty table gives no rows; other columns are not carried.
    """
    spark = df.sparkSession
    folder = Folder(spark, "classes")
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("body"))
    counts = folder.keep(count_words(docs.where(~held_out())), "counts")
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = int(sums["n"]), int(sums["v"])
    warm, least = hot_words(counts, hot)
    encoded = folder.keep(encode(docs, [w for w, _ in warm]), "encoded")
    release(spark)
    train = encoded.where(~held_out())
    clusters = cluster(train, warm, seeds, folder)
    placed = folder.keep(_keyed(counts).join(clusters.words(), "key", "left").select("word", "n", F.coalesce("cls", F.lit(clusters.default)).alias("cls")), "words")
    release(spark)
    table = np.zeros((4, CLASSES), np.int64)
    for r in placed.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 2).alias("two")).collect():
        table[:, r["cls"]] = r["n"], r["v"], r["one"], r["two"]
    emit, unit = Emissions(*table), float(total + distinct + 1)
    cold = placed.where(F.length("word") > 0)
    if least is not None:
        cold = cold.where(_step() < least)
    filled = folder.keep(fill(encoded, cold, warm, clusters.hot_class, emit, unit), "filled")
    for name in ("counts", "words", "encoded", *(f"profiles-{k}" for k in range(SWEEPS))):
        folder.drop(name)
    release(spark)
    start = int(clusters.hot_class[0])
    moves, unseen = transitions(count_moves(filled.where(~held_out()), start)), emit.unseen()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for key, size, known, base, known_base, emitted, seq in rows_of(batches):
                whole, part = path(np.frombuffer(seq, np.int8).astype(np.int64), start, moves, unseen)
                yield key, size, known, base, emitted + whole, known_base, emitted + part

        return batches_of(rows(), SCORED)

    scored = filled.mapInArrow(run, SCORED_DDL)
    return scored.select("id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "base_known", "score_known")
