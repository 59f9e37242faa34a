import math
import random

import pytest

from lettermill.llm import topk


def brute(rows, k):
    vecs = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in vecs:
        if q % 20 == 0:
            ranked = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in vecs if i != q)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(ranked[:k], 1)]
    return sorted(out)


def ours(spark, rows, k, **more):
    vectors = topk.scaled(spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, id int").repartition(3))
    got = topk.search(vectors, vectors.where("id % 20 = 0"), k, **more)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("block", [4096, 7])
def test_against_brute_force(spark, block):
    rng = random.Random(3)
    grid = lambda: [rng.randrange(-40, 40) / 64 for _ in range(6)]
    rows = [(i, grid()) for i in range(400)]
    rows += [(i, [0.5] * 6) for i in range(400, 700)]  # many ties
    rows += [(801, None), (802, [0.1, None, 0.2, 0.1, 0.1, 0.1]), (803, [float("nan")] * 6), (820, [float("inf")] * 6), (None, grid()), (840, [0.25, 0.5]), (841, [])]
    assert ours(spark, rows, 20, block=block) == brute(rows, 20)


def test_few_and_none(spark):
    rows = [(20, [1.0, 2.0]), (21, [0.5, -0.25]), (40, [-1.0, 0.0])]
    assert ours(spark, rows, 20) == brute(rows, 20)
    assert ours(spark, rows[:1], 20) == []
    assert ours(spark, rows[1:2], 20) == []
    huge = [(20, [3e8, 2e8]), (40, [1e8, -5e8]), (61, [7e8, 1.0])]
    assert ours(spark, huge, 1) == [(q, r, v, max(-(2**63) + 1, min(2**63 - 1, s))) for q, r, v, s in brute(huge, 1)]
