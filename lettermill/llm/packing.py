"""Operator 4: variable-capacity best-fit packing of texts into training sequences.

Several sequence lengths are permitted at once, each with a cost. A text longer than the longest is cut: its full parts are
sequences by themselves, its rest is packed like a short text. Items are dealt at random, but repeatably, into packs of bounded
size; each pack is planned as a whole: items by falling length go to the open bin with the least room that still takes them, in
bins of all lengths alike, or else open a bin of the length that costs least for what it is expected to hold; at the end each
bin shrinks to the shortest permitted length for its contents. A pack is planned under several ways to open bins, and the
cheapest plan is kept.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.common import batches_of, rows_of, settle

#: Permitted lengths in tokens, and what attention adds to the cost: a sequence of this length costs twice its tokens.
LENGTHS = (256, 512, 1024, 2048, 4096)
TWICE = 32_768
#: Items a pack holds on average.
PACK = 4_096


def cost_of(length: int) -> float:
    """What a sequence of `length` tokens costs in training: linear layers, and attention that grows with the square."""
    return length * (1 + length / TWICE)


def _opener(lengths: Sequence[int], cost: Callable[[int], float], least: int) -> Callable[[int, int], int]:
    """Chooses a new bin's length for an item: at least `least`; the least cost for each token that it will hold, counting on the items still to come."""

    def choose(item: int, to_come: int) -> int:
        fits = [x for x in lengths if x >= item]
        wide = [x for x in fits if x >= least] or fits[-1:]
        return min(wide, key=lambda x: (cost(x) / min(x, item + to_come), x))

    return choose


def plan(sizes: list[int], lengths: Sequence[int], cost: Callable[[int], float], least: int) -> tuple[float, list[tuple[int, int]], list[int]]:
    """(cost, (bin, place in it) of each item, each bin's final length) of best fit over items in the given order, none longer than the longest length."""
    choose, to_come = _opener(lengths, cost, least), sum(sizes)
    room: list[tuple[int, int]] = []  # (room left, bin) of open bins, in order
    held: list[int] = []
    open_at: list[int] = []
    where: list[tuple[int, int]] = []
    for size in sizes:
        to_come -= size
        k = bisect_left(room, (size, -1))
        if k < len(room):
            left, b = room.pop(k)
        else:
            b = len(held)
            held.append(0)
            open_at.append(choose(size, to_come))
            left = open_at[b]
        where.append((b, held[b]))
        held[b] += size
        if left > size:
            insort(room, (left - size, b))
    final = [next(x for x in lengths if x >= h) for h in held]
    return sum(map(cost, final)), where, final


def best_plan(sizes: list[int], lengths: Sequence[int] = LENGTHS, cost: Callable[[int], float] = cost_of) -> tuple[float, list[tuple[int, int]], list[int]]:
    """The cheapest of the plans with bins of at least each of the permitted lengths; items must fall in size."""
    lengths = sorted(set(lengths))
    return min((plan(sizes, lengths, cost, least) for least in lengths), key=lambda p: p[0])


def word_count(text_col: str):
    """Words `[^\\x20\\x09-\\x0D]+` of a text, counted in the JVM; a null text has none."""
    return F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


PLACED = pa.schema([("id", pa.int64()), ("part", pa.int32()), ("start", pa.int64()), ("n", pa.int32()), ("sequence", pa.string()), ("length", pa.int32()), ("place", pa.int32())])
PLACED_DDL = "id long, part int, start long, n int, sequence string, length int, place int"


def pack(sized: DataFrame, lengths: Sequence[int] = LENGTHS, pack_items: int = PACK, id_col: str = "id", size_col: str = "size") -> DataFrame:
    """Columns id, part, start, n, sequence, length, place: one row for each part of each row of `sized`.

    Part `part` of a text holds its tokens start .. start + n - 1 and lies at `place` of the sequence named `sequence`, which is
    `length` tokens long. A text of no tokens, or of null size, gives one row of n = 0 and no sequence, so that no row is lost;
    equal ids, whole equal rows among them, are separate texts and spread over the packs like others; a null id is packed like any other; an
    empty table gives no rows. Full parts of long texts never meet a shuffle; every pack is about `pack_items` items whatever the
    size of the table, and the number of packs grows with it.
    """
    longest = max(lengths)
    size = F.greatest(F.coalesce(F.col(size_col).cast("long"), F.lit(0)), F.lit(0))
    sized = settle(sized.select(F.col(id_col).cast("long").alias("id"), size.alias("size"), F.monotonically_increasing_id().alias("row")))  # rows are numbered once and for all
    count = sized.where("size > 0").count()
    packs = max(1, -(-count // pack_items))
    whole = F.floor(F.col("size") / longest)
    rest = F.col("size") - whole * longest
    full = sized.where(F.col("size") >= longest).select("id", "row", F.explode(F.sequence(F.lit(0).cast("long"), whole - 1)).alias("part")).select(
        "id", F.col("part").cast("int").alias("part"), (F.col("part") * longest).alias("start"), F.lit(longest).alias("n"), F.concat_ws("-", F.lit("full"), "row", "part").alias("sequence"), F.lit(longest).alias("length"), F.lit(0).alias("place")
    )
    none = sized.where("size = 0").select("id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("start"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("sequence"), F.lit(0).alias("length"), F.lit(0).alias("place"))
    items = sized.select("id", "row", whole.cast("int").alias("part"), (whole * longest).alias("start"), rest.cast("int").alias("n")).where("n > 0")
    items = items.select(F.pmod(F.xxhash64("row"), F.lit(packs)).alias("pack"), "id", "part", "start", "n", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def placed() -> Iterator[tuple]:
            now, held = None, []
            for row in rows_of(batches):
                if row[0] != now:
                    yield from _packed(now, held, lengths)
                    now, held = row[0], []
                held.append(row[1:-1])
            yield from _packed(now, held, lengths)

        return batches_of(placed(), PLACED, 5000)

    packed = items.repartition("pack").sortWithinPartitions("pack", F.desc("n"), "row").mapInArrow(run, PLACED_DDL)
    return full.union(none).union(packed)


def _packed(name: int | None, held: list[tuple], lengths: Sequence[int]) -> Iterator[tuple]:
    if not held:
        return
    _, where, final = best_plan([n for *_, n in held], lengths)
    for (key, part, start, n), (b, place) in zip(held, where, strict=True):
        yield key, part, start, n, f"{name}-{b}", final[b], place
