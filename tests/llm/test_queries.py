"""The queries' digest columns, worked out again in plain Python from whole tables."""

import hashlib
import re

import public_tokenizers as P
import pytest

from lettermill.llm import html, pii, queries, secrets

SF = "/root/testdata/sf0.001"
sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name, key="doc_id"):
    got = queries.QUERIES[name](spark, SF).collect()
    by = {r[key]: r.asDict() for r in got}
    assert len(by) == len(got)
    return by


def test_op1(spark, docs):
    from tokenizers import Tokenizer

    by, got = Tokenizer.from_file(P.path("word_bpe_49k.json")), rows(spark, "op1_bpe")
    assert set(got) == set(docs)
    for k, text in docs.items():
        ids = by.encode(text, add_special_tokens=False).ids
        assert got[k] == {"doc_id": k, "n_tokens": len(ids), "ids_sha256": sha(" ".join(map(str, ids))), "decoded_sha256": sha(by.decode(ids, skip_special_tokens=False))}


def test_op2(spark, docs):
    got = rows(spark, "op2_simhash")
    assert set(got) == set(docs) and all(re.fullmatch("[0-9a-f]{16}", r["fingerprint"]) for r in got.values())
    assert all(r["component_id"] <= k and got[r["component_id"]]["component_id"] == r["component_id"] for k, r in got.items())


@pytest.mark.parametrize("name, kinds, find", [("op3_pii", pii.KINDS, pii.plain_spans), ("op8_secrets", secrets.KINDS[:3], lambda t: secrets.base_spans(t, t.encode()))])
def test_spans(spark, docs, name, kinds, find):
    got = rows(spark, name)
    assert set(got) == set(docs)
    for k, text in docs.items():
        spans = sorted(find(text), key=lambda s: (s[0], kinds.index(s[2])))
        joined = ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)
        assert got[k]["base_sha256"] == sha(joined)
        assert set(joined.split(",")) <= set(got[k]["spans"].split(",")) or not joined
        assert [got[k][f"n_{kind}"] for kind in kinds] == [sum(s[2] == kind for s in spans) for kind in kinds]
        starts = [int(s.split(":")[1]) for s in got[k]["spans"].split(",") if s]
        assert starts == sorted(starts)


def test_op7(spark):
    got = rows(spark, "op7_html", "page_id")
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        text = html.main_text(r["html"])
        assert got[r["page_id"]] == {"page_id": r["page_id"], "url": r["url"], "text": text, "n_chars": len(text)}


def test_op4_and_op9_cover_all_documents(spark, docs):
    words = {}
    for r in queries.QUERIES["op4_packing"](spark, SF).collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + r["n"]
    assert words == {k: len(t.encode().split()) for k, t in docs.items()}
    assert {r["doc_id"] for r in queries.QUERIES["op9_shards"](spark, SF).collect()} == set(docs)


def test_op10(spark, docs):
    got = rows(spark, "op10_quality")
    assert set(got) == set(docs)
    assert all(r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in got.values())
