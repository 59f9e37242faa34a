"""Operators over the numbered lines of a text: neighbourhoods, nearest lines, runs.

A text's lines stay in one array column and neighbourhoods are slices of it, so nothing is shuffled and a long text is as
local as a short one; the exploded forms take windows over a text's own lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.functions import columns as C


def lines_of(text: Column) -> Column:
    """Lines between line feeds, as an array."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def universal_lines(text: Column) -> Column:
    """Lines by any line boundary, without an empty last one."""
    parts = F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Columns key, line_no (from 0), line."""
    return docs.select(key, F.posexplode(lines_of(F.col(text))).alias("line_no", "line"))


def window_of(values: Column, at: Column, before: int, after: int) -> Column:
    """Elements at-before .. at+after of an array, as far as it goes; `at` counts from 0."""
    first = F.greatest(at - before, F.lit(0))
    return F.slice(values, first + 1, F.greatest(F.least(at + after + 1, F.size(values)) - first, F.lit(0)))


def scope(docs: DataFrame, key: str, lines: str, marker: Callable[[Column], Column], identity: Callable[[Column], Column]) -> DataFrame:
    """Line numbers near a marker: two lines either way, after a header line three on; none without an identity marker."""
    from lettermill.functions.vocab import SCOPE_HEADERS

    header = lambda x: F.lower(x).rlike("^(" + "|".join(SCOPE_HEADERS) + ")")
    flags = docs.select(key, F.col(lines).alias("_l")).select(key, F.transform("_l", lambda x: F.struct(marker(x).alias("m"), header(x).alias("h"))).alias("_f"), F.exists("_l", identity).alias("_any")).where("_any")
    spread = F.transform("_f", lambda x, i: F.when(x["m"] & x["h"], F.sequence(i, F.least(i + 3, F.size("_f") - 1))).when(x["m"], F.sequence(F.greatest(i - 2, F.lit(0)), F.least(i + 2, F.size("_f") - 1))).otherwise(F.array().cast("array<int>")))
    return flags.select(key, F.explode(F.array_sort(F.array_distinct(F.flatten(spread)))).alias("line_no"))


def nearest_above(docs: DataFrame, key: str, lines: str, target: Callable[[Column], Column], candidate: Callable[[Column], Column], reach: int = 10) -> DataFrame:
    """For each target line the nearest candidate line above it within reach: key, line_no, line, above_no, above."""
    marked = docs.select(key, F.col(lines).alias("_l")).select(key, "_l", F.transform("_l", candidate).alias("_c"))
    return _nearest(marked.select(key, "_l", "_c", F.posexplode("_l").alias("line_no", "line")).where(target(F.col("line"))), key, reach)


def _nearest(rows: DataFrame, key: str, reach: int) -> DataFrame:
    first = F.greatest(F.col("line_no") - reach, F.lit(0))
    flags = F.slice("_c", first + 1, F.col("line_no") - first)
    back = F.array_position(F.reverse(flags), F.lit(True))
    found = rows.withColumn("above_no", F.when(back > 0, F.col("line_no") - back.cast("int")))
    return found.select(key, "line_no", "line", "above_no", F.when(F.col("above_no").isNotNull(), F.get("_l", F.col("above_no"))).alias("above"))


def header_clusters(docs: DataFrame, key: str, lines: str, span: int = 8) -> DataFrame:
    """Lines at which quoted headers begin: a header line with two header lines and two keys within `span` lines, a sender among them."""
    keyed = docs.select(key, F.transform(lines, C.header_key).alias("_k"))
    rows = keyed.select(key, F.posexplode("_k").alias("line_no", "key"), "_k").where("key <> ''")
    near = F.filter(window_of(F.col("_k"), F.col("line_no"), 0, span - 1), lambda k: k != "")
    return rows.select(key, "line_no", F.size(near).alias("n_headers"), F.size(F.array_distinct(near)).alias("n_keys"), F.exists(near, lambda k: k.isin("von", "from")).alias("has_sender")).where("n_headers >= 2 and n_keys >= 2 and has_sender").select(key, "line_no", "n_headers", "n_keys")


def run_after(lines: Column, at: Column, goes_on: Callable[[Column], Column], most: int = 5) -> Column:
    """The lines after `at`, `most` at furthest, until the first that is neither blank nor goes on; blanks are left out."""
    after = window_of(lines, at + 1, 0, most - 1)
    stops = F.transform(after, lambda x: (C.strip(x) != "") & ~goes_on(x))
    stop = F.array_position(stops, F.lit(True)).cast("int")
    kept = F.when(stop > 0, F.slice(after, F.lit(1), stop - 1)).otherwise(after)
    return F.filter(kept, lambda x: C.strip(x) != "")


def block_bounds(lines: Column, at: Column, stops: Callable[[Column], Column], reach: int = 8) -> Column:
    """struct(first, last): the block around line `at`, up to `reach` lines either way, ending before lines that stop it."""
    first = F.greatest(at - reach, F.lit(0))
    above = F.reverse(F.transform(F.slice(lines, first + 1, at - first), stops))
    up = F.array_position(above, F.lit(True)).cast("int")
    below = F.transform(window_of(lines, at + 1, 0, reach - 1), stops)
    down = F.array_position(below, F.lit(True)).cast("int")
    return F.struct(F.when(up > 0, at - up + 1).otherwise(first).alias("first"), F.when(down > 0, at + down - 1).otherwise(at + F.size(below)).alias("last"))


def nearest_either_way(positions: Column, at: Column, reach: int) -> Column:
    """The position nearest to `at` within reach; of two as near the one not after it."""
    near = F.filter(positions, lambda p: F.abs(p - at) <= reach)
    return F.get(F.array_sort(F.transform(near, lambda p: F.struct(F.abs(p - at).alias("d"), (p > at).alias("after"), p.alias("p")))), F.lit(0))["p"]


def hint_counts(lines: Column, pattern: str, tail: int = 14) -> Column:
    """How many of the last `tail` lines match."""
    last = F.slice(lines, F.greatest(F.size(lines) - tail, F.lit(0)) + 1, F.lit(tail))
    return F.size(F.filter(last, lambda x: C.ascii_fold(x).rlike(pattern)))


def signature_start(lines: Column, tail: int = 14) -> Column:
    """Number of the first sign-off line, else of the tail if it reads like a signature, else null."""
    from lettermill.functions import vocab as V

    marks = F.array_position(F.transform(lines, C.is_signature_marker), F.lit(True)).cast("int")
    inferred = (F.size(F.filter(lines, lambda x: C.strip(x) != "")) >= 3) & (hint_counts(lines, V.CONTACT_HINT, tail) >= 2)
    return F.when(marks > 0, marks - 1).when(inferred, F.greatest(F.size(lines) - tail, F.lit(0)))
