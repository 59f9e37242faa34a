"""Operator 2: SimHash near-duplicates with BK-trees over shards.

A text's fingerprint has the majority bits of its shingles' hashes. Fingerprints within the radius are found in BK-trees, whose
children are keyed by their Hamming distance to the parent, so that a search follows only edges within the radius of its own
distance. A tree holds one shard. Shards come from the pigeonhole rule: two fingerprints at `radius` or fewer differing bits
agree in one of radius + 1 blocks of bits, so each fingerprint goes to radius + 1 shards, one for each block's value, and no link
is missed. The trees go to where their shard's fingerprints are, by one shuffle, instead of to everyone by broadcast: together
they grow with the corpus, so no bound for a broadcast holds. A shard larger than a tree may be is cut again by the same rule
over the bits that its members do not share, until it fits; since fingerprints are distinct, it does after a few cuts.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.llm.common import Folder, batches_of, id_and_bytes, release, rows_of, settle, sift
from lettermill.llm.components import Forest, components

#: Seed of the shingles' hashes, bits of a fingerprint, and most fingerprints in one tree.
SEED, BITS, TREE = 42, 64, 1024
#: Shingles whose bits are counted at once.
_SLICE = 16_384


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """All runs of `size` words, joined by spaces; of fewer words the whole sequence; of none nothing."""
    if len(words) < size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False)))


def hashes(grams: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(g, SEED) for g in grams), np.uint64, len(grams))


def majority(values: np.ndarray) -> int:
    """The number whose bits are set in over half the values; signed, as Spark keeps it."""
    if not len(values):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(values), _SLICE):
        part = values[at : at + _SLICE]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view(np.int64)[0])


def fingerprint(body: bytes, size: int = 3) -> int:
    """Of a text in UTF-8: A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`, shingles of `size` words, repeats included."""
    return majority(hashes(shingles(body.lower().split(), size)))


def fingerprints(df: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id and fp for each row of `df`; a null text has no words and so fingerprint zero."""
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(((key, fingerprint(body, size)) for key, body in rows_of(batches)), schema, 5000)

    return id_and_bytes(df, id_col, text_col).mapInArrow(run, "id long, fp long")


class BkTree:
    """Values under integer Hamming distance."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """Puts a value in and returns its node."""
        node = len(self.values)
        self.values.append(value)
        self.children.append({})
        if node:
            at = 0
            while True:
                d = (self.values[at] ^ value).bit_count()
                nxt = self.children[at].setdefault(d, node)
                if nxt == node:
                    break
                at = nxt
        return node

    def within(self, value: int, radius: int) -> list[tuple[int, int]]:
        """(distance, node) of the values within the radius."""
        if not self.values:
            return []
        found, todo = [], [0]
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append((d, at))
            children = self.children[at]
            if len(children) > 2 * radius:
                todo += [children[e] for e in range(d - radius, d + radius + 1) if e in children]
            else:
                todo += [node for e, node in children.items() if -radius <= e - d <= radius]
        return found


_FOREST = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def shard_links(members: list[tuple[int, int]], radius: int) -> list[tuple[int, int]]:
    """Links that connect what is linked within a shard of (id, fingerprint): each member with the smallest one it can reach."""
    if len(members) == 1:
        return []
    tree, forest = BkTree(), Forest()
    for key, value in members:
        for _, node in tree.within(value & (2**BITS - 1), radius):
            forest.union(key, members[node][0])
        tree.add(value & (2**BITS - 1))
    return [(x, r) for x in forest.up if (r := forest.root(x)) != x]


def by_group(batches: Iterator[pa.RecordBatch], count: int) -> Iterator[Iterator[tuple]]:
    """The rest of the rows of each run of rows that agree in their first `count` columns."""
    for _, rows in itertools.groupby(rows_of(batches), key=lambda row: row[:count]):
        yield (row[count:] for row in rows)


def links_by_shard(rows: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Columns u and v: links of every shard. `rows` has the shard's `keys` (longs), id and fp; one shuffle by key brings a shard together, in order, and a task holds one shard at a time.

    The shuffle is by a hash of the keys. By the keys themselves it would fall together with that of a join by them before it, which adaptive execution reads in
    other parts once it broadcasts the join's other side or splits a skewed part: shards would be torn, and links lost.
    """
    count = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of((link for members in by_group(batches, count) for link in shard_links(list(members), radius)), _FOREST, 5000)

    return rows.select(*keys, "id", "fp").repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, "id").mapInArrow(run, "u long, v long")


def blocks(free: int, parts: int) -> list[int]:
    """Cuts the set bits of `free` into `parts` masks of even width."""
    bits = [b for b in range(BITS) if free >> b & 1]
    ends = [len(bits) * k // parts for k in range(parts + 1)]
    return [sum(1 << b for b in bits[a:z]) for a, z in zip(ends, ends[1:], strict=False)]


def signed(value: int) -> int:
    return value - 2**64 if value >> 63 else value


def links_within(fps: DataFrame, radius: int, tree: int = TREE) -> DataFrame:
    """Columns u and v: links that connect all of the distinct fingerprints `fp` that are within `radius` of each other, step by step."""
    everything = 2**BITS - 1
    masks = blocks(everything, radius + 1)
    rows = fps.select("fp", F.explode(F.array(*(F.lit(signed(m)) for m in masks))).alias("mask"))
    found = None
    while True:
        rows = settle(rows.select(F.col("mask"), F.col("fp").bitwiseAND(F.col("mask")).alias("part"), F.col("fp").alias("id"), "fp"))
        large = settle(rows.groupBy("mask", "part").count().where(F.col("count") > tree).select("mask", "part"))
        some = large.limit(1).count() > 0
        fits = rows.join(large, ["mask", "part"], "left_anti") if some else rows
        links = links_by_shard(fits, ["mask", "part"], radius)
        found = links if found is None else found.union(links)
        if not some:
            return found
        cuts = {m: [signed(m | b) for b in blocks(everything & ~m, radius + 1) if b] for m in masks}
        masks = sorted({c & everything for cut in cuts.values() for c in cut})
        table = F.create_map(*(x for m, cut in cuts.items() for x in (F.lit(signed(m)), F.array(*map(F.lit, cut)))))
        rows = rows.join(large, ["mask", "part"]).select("fp", F.explode(table[F.col("mask")]).alias("mask"))


def near_duplicates(df: DataFrame, size: int = 3, radius: int = 2, tree: int = TREE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, fp (signed) and component: the smallest id that links of `radius` or fewer differing bits reach, itself included.

    One row for each row of `df`. Texts without words, null ones among them, have fingerprint zero and are linked by it like
    any other; repeated rows are linked to each other; a null id takes part with its fingerprint but is never the smallest,
    and a component of null ids only has a null id; an empty table gives no rows; other columns are not carried.
    """
    prints = settle(fingerprints(df, size, id_col, text_col))
    distinct = settle(prints.groupBy("fp").agg(F.min("id").alias("least")))
    roots = settle(components(settle(links_within(distinct, radius, tree))))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = settle(rooted)
    least = settle(rooted.groupBy("root").agg(F.min("least").alias("component")))
    named = settle(rooted.join(least, "root").select("fp", "component"))
    return prints.join(named, "fp").select("id", "fp", "component")


def _factors(count: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.Generator(np.random.PCG64(SEED))
    return draw.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 2**63, count, dtype=np.uint64)


def least_values(values: np.ndarray, count: int) -> np.ndarray:
    """The least value under each of `count` mixings of the shingles' hashes. Two texts agree in one with the chance of their Jaccard similarity; without shingles all are zero."""
    if not len(values):
        return np.zeros(count, np.int64)
    times, plus = _factors(count)
    least = np.full(count, 2**64 - 1, np.uint64)
    for at in range(0, len(values), 4096):
        part = values[at : at + 4096]
        mixed = (part[None, :] ^ plus[:, None]) * times[:, None]
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        np.minimum(least, mixed.min(1), out=least)
    return least.view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


#: Near-duplicate search: bands of least values, values of a band, values that cut a large shard again, and how often such a cut is made.
BANDS, ROWS, CUTS, LEVELS = 12, 4, 8, 2
#: Most texts of one tree, and the widest fingerprint distance of texts that are compared.
SHARD, RADIUS = 512, 18
LIGHT = pa.schema(
    [("id", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("fp", pa.int64()), ("least", pa.list_(pa.int64())), ("grams", pa.binary())]
)


def light_rows(source: DataFrame, size: int) -> DataFrame:
    """LIGHT of each text: a digest of its words, fingerprint and least values of its distinct shingles, and these shingles as sorted numbers of 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for key, body in rows_of(batches):
                words = body.lower().split()
                values = np.unique(hashes(shingles(words, size)))
                whole = xxhash.xxh3_128_intdigest(b" ".join(words))
                grams = np.unique((values >> np.uint64(32)).astype(np.uint32))
                yield key, signed(whole & (2**64 - 1)), signed(whole >> 64), majority(values), least_values(values, BANDS * ROWS).tolist(), grams.tobytes()

        return batches_of(out(), LIGHT)

    return source.mapInArrow(run, "id long, d1 long, d2 long, fp long, least array<long>, grams binary")


def band_keys() -> Column:
    """A key for each band of the column least."""
    return F.array(*(F.xxhash64(F.lit(b), F.slice("least", ROWS * b + 1, ROWS)) for b in range(BANDS)))


def shared_members(texts: DataFrame, folder: Folder, most: int) -> DataFrame:
    """Columns id, fp, band, shard, tiles: each text (id, fp, keys) in all shards where others are, which have the texts that agree in a band of least values; a tile for every `most` texts."""
    rows = folder.keep(texts.select("id", "fp", F.posexplode("keys").alias("band", "shard")), "rows")
    sizes = folder.keep(rows.groupBy("shard").count().where("count > 1"), "sizes")
    shared = sift(rows, "shard", sizes).join(sizes, "shard")
    return folder.keep(shared.select("id", "fp", "band", "shard", F.ceil(F.col("count") / most).alias("tiles")), "shared")


def shard_members(texts: DataFrame, least: DataFrame, folder: Folder, most: int, roots: DataFrame | None = None) -> DataFrame:
    """`shared_members`, but large shards are cut where that is less work. `least` has id and least values, which only texts of shards to be cut are asked for.

    `roots` (node, root) has the groups that are known from within tiles; then only shards of several tiles and several groups are given, which are what that leaves open.
    Texts outside of a shard's largest group visit its other tiles. Where that makes more than CUTS rows a text, the shard is cut by CUTS further values, one way for
    each, so that two texts that agree in any of these stay together. What should be cut still after LEVELS cuts is a family of texts that agree nearly everywhere.
    """
    rows = texts.select("id", "fp", F.posexplode("keys").alias("band", "shard"))
    done = []
    for level in range(LEVELS + 1):
        rows = folder.keep(rows, f"rows-{level}")
        if roots is None:
            sizes = rows.groupBy("shard").count().withColumn("outside", F.col("count") - 1)
        else:
            groups = with_roots(rows, roots).groupBy("shard", "root").agg(F.count("*").alias("n"))
            sizes = groups.groupBy("shard").agg(F.sum("n").alias("count"), (F.sum("n") - F.max("n")).alias("outside"))
        sizes = sizes.where("outside > 0").withColumn("tiles", F.ceil(F.col("count") / most))
        if roots is not None and level == 0:
            sizes = sizes.where("tiles > 1")
        cut = (F.col("tiles") - 1) * F.col("outside") > CUTS * F.col("count")
        sizes = folder.keep(sizes.select("shard", "tiles", cut.alias("cut") if level < LEVELS else F.lit(False).alias("cut")), f"sizes-{level}")
        done.append(rows.join(sizes.where("not cut").drop("cut"), "shard").select("id", "fp", "band", "shard", "tiles"))
        large = sizes.where("cut").select("shard")
        if large.limit(1).count() == 0:
            break
        place = ROWS * (F.col("band") + 1) + CUTS * level  # of the first value after those that the shard agrees in
        further = F.array(*(F.xxhash64("shard", F.lit(i), F.get("least", (place + i) % (BANDS * ROWS))) for i in range(CUTS)))
        inside = folder.keep(rows.join(large, "shard", "left_semi"), f"inside-{level}")
        rows = inside.join(sift(least, "id", inside), "id").select("id", "fp", "band", F.explode(further).alias("shard"))
    return folder.keep(reduce(DataFrame.union, done), "members")


def with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """`rows` with root, the group of each id: `roots` has node and root of texts in groups, others are their own."""
    return rows.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))


def open_members(members: DataFrame, roots: DataFrame) -> DataFrame:
    """`members` with root, the group of each text, and largest, that of most of its shard's texts; of shards of more than one group only, since a shard of one group stays so.

    `roots` has node and root of texts in groups.
    """
    of = with_roots(members, roots)
    groups = of.groupBy("shard", "root").agg(F.count("*").alias("n"))
    several = groups.groupBy("shard").agg(F.max_by("root", F.struct("n", "root")).alias("largest"), F.count("*").alias("groups")).where("groups > 1")
    return of.join(several.drop("groups"), "shard").select(*members.columns, "root", "largest")


def similar(a: bytes, b: bytes, similarity: float) -> bool:
    """Whether two sets of shingles have at least the similarity."""
    return min(len(a), len(b)) >= similarity * max(len(a), len(b)) and jaccard(np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)) >= similarity


def candidates(live: DataFrame, radius: int, width: int | None, grams: DataFrame | None = None, similarity: float = 0.0) -> DataFrame:
    """Columns u and v: of each of `open_members` the `width` nearest (None: all) of the texts in its shards within the radius that are not of its group yet.

    With `grams` (id and shingles of each text), links instead that connect the groups of all of these pairs that have the similarity: a pair is decided where it is
    named, so that no row is made for it, and one whose groups an earlier pair of the tile has brought together is left out.
    A task holds the tree of one tile, and its shingles; in a shard of
    several tiles the texts outside of its largest group visit the other tiles, one after the other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[int, int]]:
            for rows in by_group(batches, 2):
                tree, held, forest = BkTree(), [], Forest()
                for visit, key, value, root, *own in rows:
                    value &= 2**BITS - 1
                    near = ((d, held[node][0], node) for d, node in tree.within(value, radius) if held[node][1] != root)
                    for _, other, node in sorted(near) if width is None else heapq.nsmallest(width, near):
                        if not own:
                            yield (key, other) if key < other else (other, key)
                        elif forest.root(root) != forest.root(held[node][1]) and similar(own[0], held[node][2], similarity):
                            forest.union(root, held[node][1])
                    if not visit:
                        tree.add(value)
                        held.append((key, root, *own))
                yield from ((x, r) for x in forest.up if (r := forest.root(x)) != x)

        return batches_of(found(), _FOREST, 5000)

    home = F.pmod(F.xxhash64("id", "shard"), F.col("tiles"))
    alone = F.array(F.struct(home.alias("tile"), F.lit(0).alias("visit")))
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda t: F.struct(t.alias("tile"), (t != home).cast("int").alias("visit")))
    rows = live.select("shard", F.explode(F.when(F.expr("tiles > 1 and root <> largest"), every).otherwise(alone)).alias("at"), "id", "fp", "root")
    rows = rows.select("shard", "at.tile", "at.visit", "id", "fp", "root")
    if grams is not None:
        rows = rows.join(sift(grams, "id", live), "id").select(*rows.columns, "grams")
    return rows.repartition("shard", "tile").sortWithinPartitions("shard", "tile", "visit", "id").mapInArrow(run, "u long, v long").distinct()


def similar_groups(df: DataFrame, size: int = 5, similarity: float = 0.8, radius: int = RADIUS, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns node and root for each id of `df` that has a smaller one, root, in its group: groups link texts whose sets of `size`-word shingles have a Jaccard similarity of at least `similarity`.

    Fingerprints are of the distinct shingles, as the similarity is. At 0.8 they differ by 10 bits or so, too many for the pigeonhole rule, so shards come from
    least values of the shingles: two texts at 0.8 meet in one of BANDS shards with a chance of 0.998, and differ by at most `radius` bits with one over 0.99. BK-trees
    over a shard's fingerprints name candidates; the shingles of each candidate pair then decide, in the same task. A first pass looks within tiles, which is all of
    most shards; a second one takes the texts outside of the largest group of a larger shard to its other tiles: no candidate goes undecided unless its two
    texts are in one group already. Equal texts are one text from the start. Null ids take no part; rows with the same id count as one document; texts
    without words are equal; an empty table gives no rows.
    """
    spark = df.sparkSession
    folder = Folder(spark, "near")
    light = folder.keep(light_rows(id_and_bytes(df, id_col, text_col).where("id is not null"), size), "light")
    ids = light.groupBy("id").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()["most"]
    found = light.select("id", "d1", "d2", "fp", band_keys().alias("keys"))
    firsts = folder.keep(found.groupBy("d1", "d2").agg(F.min("id").alias("first"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "firsts")
    copies = light.select("id", "d1", "d2").join(firsts.select("d1", "d2", "first"), ["d1", "d2"]).where("id <> first").select(F.col("id").alias("u"), F.col("first").alias("v"))
    texts, values, grams = firsts.select(F.col("first").alias("id"), "fp", "keys"), light.select("id", "least"), light.select("id", "grams")
    if ids > 1:  # of several texts of one id the one of the least digest stands for it
        one = folder.keep(light.groupBy("id").agg(F.min(F.struct("d1", "d2", "fp", "least", "grams")).alias("row")).select("id", "row.*"), "one")
        texts = folder.keep(firsts.select(F.col("first").alias("id")).distinct().join(one.select("id", "fp", band_keys().alias("keys")), "id"), "texts")
        values, grams = one.select("id", "least"), one.select("id", "grams")
    members = shared_members(texts, folder, shard)
    folder.drop("rows")
    release(spark)
    found = candidates(members.withColumns({"root": F.col("id"), "largest": F.col("id")}), radius, None, grams, similarity)
    roots = settle(components(settle(copies.union(found))))
    release(spark)
    large = members.where("tiles > 1").select("id")
    if large.limit(1).count():
        inside = sift(texts, "id", large).join(large.distinct(), "id", "left_semi")
        live = folder.keep(open_members(shard_members(inside, values, folder, shard, roots), roots), "live")
        links = roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(candidates(live, radius, None, grams, similarity))
        roots = settle(components(settle(links)))
        release(spark)
    folder.drop("")
    return roots


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """`df` with one document, that of the smallest id, of each of `similar_groups`; all columns stay. Repeated rows of one id come down to the one of the least text, then of the least other values; rows with a null id stay."""
    roots = similar_groups(df, id_col=id_col, text_col=text_col, **params)
    again = settle(df.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col))
    left = df.join(roots.select(F.col("node").alias(id_col)), id_col, "left_anti").select(*df.columns)
    if again.limit(1).count() == 0:
        return left
    order = F.struct(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.to_json(F.struct(*df.columns)))
    repeated = left.join(again, id_col, "left_semi").select(*df.columns).groupBy(id_col).agg(F.min_by(F.struct(*df.columns), order).alias("row")).select("row.*")
    return left.join(again, id_col, "left_anti").select(*df.columns).union(repeated)
