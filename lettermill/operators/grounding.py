"""Which values occur in which texts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most characters of values that every task holds at once, as an automaton.
BLOCK = 1_000_000

_AUTOMATA: dict[str, ahocorasick.Automaton] = {}


def _automaton(name: str, values: list[str]) -> ahocorasick.Automaton:
    """An automaton of all values, each with its place among them; one for each worker process."""
    if name not in _AUTOMATA:
        _AUTOMATA.clear()
        made = _AUTOMATA[name] = ahocorasick.Automaton()
        for k, value in enumerate(values):
            made.add_word(value, k)
        made.make_automaton()
    return _AUTOMATA[name]


def occurrences(docs: DataFrame, values: DataFrame, doc: str, text: str, item: str, value: str, block: int = BLOCK) -> DataFrame:
    """Columns doc and item: each value, blank ones aside, with each text that has it, whatever the case.

    Texts are read once for all values, by an automaton, so the work grows with the texts and the hits and not with texts times values. The values' size is looked
    up first, and they go to all tasks in blocks of about `block` characters, so what is sent has a bound however many values there are; each
    further block reads the texts again. Equal values of several items are looked for once, and joined to their items afterwards.
    """
    wanted = values.select(F.col(item).alias("_item"), F.lower(F.col(value)).alias("_value")).where("length(trim(_value)) > 0")
    distinct = wanted.select("_value").distinct()
    size = distinct.agg(F.coalesce(F.sum(F.length("_value")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // block))
    lowered = docs.select(F.col(doc), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_low"))
    key_type = docs.schema[doc].dataType.simpleString()
    context = docs.sparkSession.sparkContext

    def of(b: int) -> DataFrame:
        mine = distinct.where(F.pmod(F.xxhash64("_value"), F.lit(blocks)) == b) if blocks > 1 else distinct
        held, name = context.broadcast([r["_value"] for r in mine.collect()]), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not held.value:
                return
            find = _automaton(name, held.value)
            for batch in batches:
                hits = [sorted({k for _, k in find.iter(low)}) for low in batch.column(1).to_pylist()]
                rows = pa.array([k for k, found in enumerate(hits) for _ in found], pa.int64())
                found = pa.array([held.value[k] for some in hits for k in some], pa.string())
                yield pa.record_batch([batch.column(0).take(rows), found], names=[doc, "_value"])

        return lowered.mapInArrow(run, f"`{doc}` {key_type}, _value string")

    return reduce(DataFrame.union, map(of, range(blocks))).join(wanted, "_value").select(doc, F.col("_item").alias(item))
