import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lettermill.llm import shards

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000, 4097])
def test_permutation(n):
    slots = shards.Feistel(n, "k").slots(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n))
    if n > 50:
        assert slots.tolist() != list(range(n)) and slots.tolist() != shards.Feistel(n, "other").slots(np.arange(n)).tolist()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(["a", "don't", " ", "  ", "\n", " \n", "\t", "é!", "42", " ", "x,y"]), max_size=12).map("".join)))
def test_encoder(text):
    by = shards.encoder(RANKS, P.PATTERN)
    assert by.encode(text) == by.by.encode_ordinary(text)


def test_round_trip(spark, tmp_path, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(4, "doc_id")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (None, "a b"), (-3, "c"), (-3, "c")], "doc_id long, text string")
    all_docs = docs.select("doc_id", "text").union(extra)
    all_docs.write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    folder = (tmp_path / "out").as_uri()
    rows = shards.write_in_order(df, folder, RANKS, P.PATTERN, "seed", length=64, per_shard=500).collect()
    by = shards.encoder(RANKS, P.PATTERN)
    total = max(r["slot"] for r in rows) + 1
    assert {r["slot"] for r in rows} == set(range(total)) == {r["number"] for r in rows}
    assert len(list((tmp_path / "out").iterdir())) == -(-total // 500)
    read = list(shards.read_slots(folder, 0, total, 64, 500))
    assert [x.tolist() for x in shards.read_slots(folder, 733, 1203, 64, 500)] == [x.tolist() for x in read[733:1203]]
    texts, taken = {}, np.zeros(total, int)
    for r in rows:
        assert r["shard"] == r["slot"] // 500 and r["offset"] == r["slot"] % 500 * 128
        part = read[r["slot"]][r["place"] : r["place"] + r["n"]]
        taken[r["slot"]] += r["n"]
        texts.setdefault(r["id"], []).append((r["start"], part.tolist()))
    assert taken.max() == 64 and (taken < 64).sum() <= df.rdd.getNumPartitions()
    want = {}
    for r in all_docs.collect():
        want.setdefault(r["doc_id"], []).append([*by.by.encode_ordinary(r["text"] or ""), by.end])
    for key, ids in want.items():
        if len(ids) == 1:
            assert [t for _, p in sorted(texts[key]) for t in p] == ids[0]
        else:
            assert sorted(t for _, p in texts[key] for t in p) == sorted(t for x in ids for t in x)
    assert shards.write_in_order(df, folder, RANKS, P.PATTERN, "seed", length=64, per_shard=500).count() == len(rows)
    assert [x.tolist() for x in shards.read_slots(folder, 0, total, 64, 500)] == [x.tolist() for x in read]  # a second run leaves equal files
    assert not [x for x in (tmp_path / "out").iterdir() if x.name.startswith(".")]
    monkeypatch.setattr(shards, "WRITERS", 2)
    again = (tmp_path / "few").as_uri()
    assert {tuple(r) for r in shards.write_in_order(df, again, RANKS, P.PATTERN, "seed", length=64, per_shard=500).collect()} == {tuple(r) for r in rows}
    assert [x.tolist() for x in shards.read_slots(again, 0, total, 64, 500)] == [x.tolist() for x in read]
    assert shards.write_in_order(df.limit(0), folder + "2", RANKS, P.PATTERN, "seed").count() == 0
