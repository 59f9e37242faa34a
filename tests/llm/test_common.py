import random

from lettermill.llm import common


def test_bounded_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    for given, want in (("64m", str(8 << 20)), ("67108864b", str(8 << 20)), ("1m", "1m"), ("4096", "4096"), (str(8 << 20), str(8 << 20))):
        spark.conf.set(key, given)
        common.bounded_batches(spark)
        assert int(spark.conf.get(key).rstrip("b")) == (int(want[:-1]) << 20 if want.endswith("m") else int(want)) if spark.conf.get(key).rstrip("b").isdigit() else spark.conf.get(key) == want
    spark.conf.unset(key)


def test_sift_keeps_all_that_are_among(spark):
    rng = random.Random(6)
    values = [rng.getrandbits(64) - 2**63 for _ in range(20_000)]
    df = spark.createDataFrame([(v, str(k)) for k, v in enumerate(values)], "id long, name string")
    some = spark.createDataFrame([(v,) for v in values[::20] * 2], "id long")
    kept = common.sift(df, "id", some)
    got = {r["id"] for r in kept.collect()}
    assert kept.columns == df.columns and set(values[::20]) <= got and len(got) < 3_000
    assert common.sift(df, "id", some.limit(0)).count() == 0
