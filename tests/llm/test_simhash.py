import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lettermill.llm import simhash
from lettermill.llm.common import Folder, settle
from lettermill.llm.components import components


def brute_print(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    grams = [" ".join(words[k : k + size]) for k in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(pairs_of, items):
    group = {x: x for x in items}
    changed = True
    while changed:
        changed = False
        for a, b in pairs_of:
            m = min(group[a], group[b])
            if group[a] != m or group[b] != m:
                group[a] = group[b] = m
                changed = True
    return group


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "é", "É", "b b", "c\x0bd", "\x1c", "\n"]), max_size=30).map(" ".join))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) & (2**64 - 1) == brute_print(text)


def test_tree_finds_all_within():
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(20)]
    values = list({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (2**64 - 1) for b in base for _ in range(20)})
    tree = simhash.BkTree()
    for v in values:
        tree.add(v)
    for q in values[:80]:
        for radius in (0, 2, 9):
            assert sorted(tree.within(q, radius)) == sorted(((v ^ q).bit_count(), k) for k, v in enumerate(values) if (v ^ q).bit_count() <= radius)


def test_components(spark):
    rng = random.Random(2)
    pairs = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(80)] + [(5000, 5000 + k) for k in range(1, 200)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(pairs, "a long, b long").repartition(5)
    real = [p for p in pairs if None not in p and p[0] != p[1]]
    want = brute_groups(real, {x for p in real for x in p})
    got = {r["node"]: r["root"] for r in components(df).collect()}
    assert got == {k: v for k, v in want.items() if k != v}
    assert components(df.limit(0)).count() == 0


@pytest.mark.parametrize("tree", [1024, 8])
def test_links_within_misses_none(spark, tree):
    rng = random.Random(3)
    values = {0, 2**63 - 1}
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(25):
            values.add(base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(8)))
    values = sorted(simhash.signed(v) for v in values)
    pairs = [(a, b) for k, a in enumerate(values) for b in values[k + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    want = brute_groups(pairs, values)
    got = {r["node"]: r["root"] for r in components(simhash.links_within(spark.createDataFrame([(v,) for v in values], "fp long"), 2, tree)).collect()}
    assert {v: got.get(v, v) for v in values} == want


def test_joins_that_turn_into_broadcasts_tear_no_shard(spark):
    """Planned as a join of two shuffles and broadcast once the sizes are known, as with large tables."""
    rng = random.Random(6)
    family, apart = rng.getrandbits(64), [rng.getrandbits(64) for _ in range(200)]
    values = {family ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(100)}
    values |= {*apart, *(v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in apart)}
    values = [simhash.signed(v) for v in values]
    rng.shuffle(values)
    pairs = [(a, b) for k, a in enumerate(values) for b in values[k + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    want = brute_groups(pairs, values)
    df = spark.createDataFrame([(v,) for v in values], "fp long").repartition(4)
    limits = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in limits}
    try:
        for k, v in limits.items():
            spark.conf.set(k, v)
        links = [tuple(r) for r in simhash.links_within(df, 2, 40).collect()]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert brute_groups(links, values) == want


def test_near_duplicates_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    docs += [(-1, None), (-2, ""), (-3, " \n"), (-1, None), (100_001, docs[5][1].upper())]
    got = simhash.near_duplicates(spark.createDataFrame([(*d, 9) for d in docs], "doc_id long, text string, fp int")).collect()
    assert len(got) == len(docs)
    prints = [(d, brute_print(t or "")) for d, t in docs]
    by = {}
    for d, p in prints:
        by.setdefault(p, d)
        by[p] = min(by[p], d)
    values = sorted(by)
    pairs = [(by[a], by[b]) for k, a in enumerate(values) for b in values[k + 1 :] if (a ^ b).bit_count() <= 2]
    group = brute_groups(pairs, set(by.values()))
    want = sorted((d, p, group[by[p]]) for d, p in prints)
    assert sorted((r["id"], r["fp"] & (2**64 - 1), r["component"]) for r in got) == want
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("shard", [512, 5])
def test_one_of_each_against_brute_force(spark, shard):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    docs, k = [], 0
    for _ in range(40):
        words = [word() for _ in range(rng.randrange(3, 200))]
        for _ in range(rng.choice([1, 1, 2, 30])):
            copy = list(words)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = word()
            docs.append((k, " ".join(copy)))
            k += 1
    rng.shuffle(docs)
    docs += [(None, "x"), (None, "x"), (docs[0][0], docs[0][1]), (90_000, None), (90_001, " ")]
    rng.shuffle(docs)
    sets = {}
    for d, t in docs:
        if d is not None:
            w = (t or "").split()
            sets[d] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or {tuple(w)} - {()}
    ids = sorted(sets)
    share = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    group = brute_groups([(a, b) for j, a in enumerate(ids) for b in ids[j + 1 :] if share(sets[a], sets[b]) >= 0.8], ids)
    df = spark.createDataFrame([(d, t, "en", 1) for d, t in docs], "doc_id long, text string, id string, root int")
    kept = simhash.one_of_each(df, shard=shard)
    assert kept.columns == df.columns
    rows = kept.collect()
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == sorted(set(group.values()))
    assert sum(r["doc_id"] is None for r in rows) == 2
    assert simhash.one_of_each(df.limit(0)).count() == 0


def test_repeats_hide_no_near_duplicate(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    texts = []
    for _ in range(12):
        words = [word() for _ in range(1000)]
        line, phrase = word(), [word() for _ in range(12)]
        texts += [words, words + [line] * 53, words + phrase * 15, words[:500] + phrase * 12 + words[500:]]
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in texts]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    group = brute_groups(pairs, range(len(texts)))
    kept = simhash.one_of_each(spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(group.values()))


def test_repeated_ids_come_down_to_one_row_always_the_same(spark):
    rows = [(1, "a b c", "en", k) for k in (3, 1, 2)] + [(1, "a b", "de", 9), (2, "x y z", None, 1), (2, "x y z", "en", 1)]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, lang string, n int").repartition(3)).collect()
        assert sorted(tuple(r) for r in got)[0] == (1, "a b", "de", 9) and len(got) == 2


def texts_of(spark, least):
    rng = random.Random(1)
    rows = [(k, simhash.signed(rng.getrandbits(64)), [simhash.signed(v) for v in values]) for k, values in enumerate(least)]
    least = spark.createDataFrame(rows, "id long, fp long, least array<long>")
    return least.select("id", "fp", simhash.band_keys().alias("keys")), least.select("id", "least"), rows


def test_large_shards_are_cut_by_further_values(spark):
    """20,000 unlike texts that share one band: no task gets more than SHARD of them."""
    rng = random.Random(3)
    count = simhash.BANDS * simhash.ROWS
    least = [[7, 7, 7, 7] + [rng.randrange(60) + 100 * j if j < 12 else rng.getrandbits(60) for j in range(4, count)] for _ in range(20_000)]
    texts, values, _ = texts_of(spark, least)
    members = simhash.shard_members(texts, values, Folder(spark, "test"), simhash.SHARD)
    sizes = [r["count"] for r in members.groupBy("shard").count().collect()]
    assert max(sizes) <= simhash.SHARD and members.agg({"tiles": "max"}).first()[0] == 1
    # Two texts stay together where they agree in any of the further values.
    together = {(r["u"], r["v"]) for r in members.alias("a").join(members.alias("b"), "shard").where("a.id < b.id and a.id < 40 and b.id < 40").selectExpr("a.id u", "b.id v").collect()}
    further = range(4, 4 + simhash.CUTS)
    assert together == {(u, v) for u in range(40) for v in range(u + 1, 40) if any(least[u][j] == least[v][j] for j in further)}


def test_families_are_dealt_into_tiles_and_no_pair_is_lost(spark):
    texts, values, rows = texts_of(spark, [[5] * (simhash.BANDS * simhash.ROWS)] * 300)
    members = simhash.shard_members(texts, values, Folder(spark, "test"), 40)
    named = lambda roots, width: {tuple(r) for r in simhash.candidates(settle(simhash.open_members(members, roots)), 26, width).collect()}
    assert {r["tiles"] for r in members.collect()} == {8}
    near = {(a[0], b[0]) for k, a in enumerate(rows) for b in rows[k + 1 :] if ((a[1] ^ b[1]) & (2**64 - 1)).bit_count() <= 26}
    none = spark.createDataFrame([], "node long, root long")
    assert named(none, None) == near
    half = spark.createDataFrame([(k, 0) for k in range(1, 150)], "node long, root long")
    apart = {(u, v) for u, v in near if v >= 150}
    assert named(half, None) == apart
    few = named(half, 1)
    assert few <= apart and (few or not apart)


def test_families_make_no_more_rows_than_they_have_texts_in_shards(spark):
    """Texts that agree in all values are not spread over cuts that cannot part them."""
    texts, values, rows = texts_of(spark, [[5] * (simhash.BANDS * simhash.ROWS)] * 300)
    members = simhash.shard_members(texts, values, Folder(spark, "test"), 40)
    assert members.count() == simhash.BANDS * len(rows)
    one = spark.createDataFrame([(k, 0) for k in range(1, 300)], "node long, root long")
    assert simhash.shard_members(texts, values, Folder(spark, "test"), 40, one).count() == 0


def test_links_are_decided_in_tiles_and_equal_brute_force(spark):
    """A family in tiles of 40, half of it in one group: each pair within the radius and at the similarity is linked, across tiles too."""
    rng = random.Random(8)
    sets = [rng.sample(range(60), 40) for _ in range(200)]
    texts, values, rows = texts_of(spark, [[5] * (simhash.BANDS * simhash.ROWS)] * 200)
    roots = spark.createDataFrame([(k, 0) for k in range(1, 100)], "node long, root long")
    grams = spark.createDataFrame([(k, np.array(sorted(s), np.uint32).tobytes()) for k, s in enumerate(sets)], "id long, grams binary")
    live = settle(simhash.open_members(simhash.shard_members(texts, values, Folder(spark, "test"), 40, roots), roots))
    got = [tuple(r) for r in simhash.candidates(live, 30, None, grams, 0.6).collect()]
    known = [(0, k) for k in range(1, 100)]
    alike = [(a[0], b[0]) for k, a in enumerate(rows) for b in rows[k + 1 :] if ((a[1] ^ b[1]) & (2**64 - 1)).bit_count() <= 30 and len({*sets[a[0]]} & {*sets[b[0]]}) >= 0.6 * len({*sets[a[0]]} | {*sets[b[0]]})]
    assert any(a < 100 <= b for a, b in alike)
    assert brute_groups(known + got, range(200)) == brute_groups(known + alike, range(200))
