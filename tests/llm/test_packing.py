import random
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lettermill.llm import packing


def holds(sizes, where, final):
    """No bin overflows, places do not overlap, and every bin has the shortest permitted length."""
    bins = {}
    for size, (b, place) in zip(sizes, where, strict=True):
        bins.setdefault(b, []).append((place, size))
    assert sorted(bins) == list(range(len(final)))
    for b, parts in bins.items():
        at = 0
        for place, size in sorted(parts):
            assert place == at
            at += size
        assert at <= final[b]
        yield at, final[b]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4096), max_size=80))
def test_plans_hold(sizes):
    sizes = sorted(sizes, reverse=True)
    _, where, final = packing.best_plan(sizes)
    for used, length in holds(sizes, where, final):
        assert length == min(x for x in packing.LENGTHS if x >= used)


def best_possible(sizes, lengths, cost):
    return min(sum(cost(min(x for x in lengths if x >= sum(s for s, b in zip(sizes, way, strict=True) if b == k))) for k in set(way)) for way in product(range(len(sizes)), repeat=len(sizes)) if all(sum(s for s, b in zip(sizes, way, strict=True) if b == k) <= max(lengths) for k in set(way)))


def test_near_the_best_on_small_packs():
    rng, ours, best = random.Random(4), 0, 0
    for _ in range(60):
        sizes = sorted((rng.randrange(1, 17) for _ in range(rng.randrange(1, 7))), reverse=True)
        cost = lambda x: x * (1 + x / 64)
        ours += packing.best_plan(sizes, (4, 8, 16), cost)[0]
        best += best_possible(sizes, (4, 8, 16), cost)
    assert best <= ours <= 1.05 * best


def test_several_lengths_beat_one():
    rng = random.Random(9)
    sizes = sorted((min(4096, int(rng.lognormvariate(5.5, 1.2)) + 1) for _ in range(4000)), reverse=True)
    joint = packing.best_plan(sizes)[0]
    assert joint < packing.plan(sizes, (4096,), packing.cost_of, 4096)[0]
    assert joint < 1.12 * packing.cost_of(256) / 256 * sum(sizes)


@pytest.mark.parametrize("pack_items", [4096, 10])
def test_rows(spark, pack_items):
    rng = random.Random(1)
    docs = [(k, rng.choice([0, 1, 5, 300, 4096, 4097, 9000, rng.randrange(1, 3000)])) for k in range(500)] + [(None, 7), (3, 7), (3, 7), (600, None), (601, 1_000_000)]
    got = packing.pack(spark.createDataFrame([(*d, 0) for d in docs], "id long, size long, part int"), pack_items=pack_items).collect()
    total, bins = {}, {}
    for r in got:
        total[r["id"]] = total.get(r["id"], 0) + r["n"]
        if r["n"]:
            bins.setdefault(r["sequence"], []).append((r["place"], r["n"], r["length"]))
    want = {}
    for d, n in docs:
        want[d] = want.get(d, 0) + (n or 0)
    assert total == want
    for parts in bins.values():
        at = 0
        for place, n, length in sorted(parts):
            assert place == at
            at += n
            assert at <= length
    assert packing.pack(spark.createDataFrame([], "id long, size long")).count() == 0


def test_words(spark):
    df = spark.createDataFrame([(" a\tb\x0bc\nd é\x85f ",), (None,), ("",)], "text string")
    assert [r[0] for r in df.select(packing.word_count("text")).collect()] == [5, 0, 0]


def test_equal_rows_spread_over_the_packs(spark):
    """200,000 equal rows and as many with a null id: no pack holds much more than its share."""
    rows = spark.range(400_000).selectExpr("if(id % 2 = 0, 7, null) AS id", "100L AS size")
    got = packing.pack(rows, pack_items=4096).selectExpr("split(sequence, '-')[0] AS pack", "sequence", "n", "length")
    sizes = [r["count"] for r in got.groupBy("pack").count().collect()]
    assert sum(sizes) == 400_000 and max(sizes) < 1.3 * 4096
    assert got.groupBy("sequence").agg({"n": "sum", "length": "max"}).where("`sum(n)` > `max(length)`").count() == 0
    whole = packing.pack(spark.createDataFrame([(1, 8192), (1, 8192), (None, 4096)], "id long, size long")).collect()
    assert len({r["sequence"] for r in whole}) == len(whole) == 5
