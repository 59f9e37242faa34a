import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lettermill.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "\n\t", "a", "Hello, World's 42!!", "ΣΑΣ ΟΔΟΣ", "İstanbul", "éÉ é", "a\x1cb\x1d c", "x　y\x85z", "<|endoftext|>a<|startoftext|>", "<|endof", "日本語テキスト", "🙂🙂 👩‍👩‍👧", "don't we'll I'VE", "½ ² Ⅷ ٣", "a" * 3000, "word " * 500]


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    return bpe.tokenizer(PATH), Tokenizer.from_file(PATH)


def same(both, text):
    ours, theirs = both
    ids = theirs.encode(text, add_special_tokens=False).ids
    assert ours.encode(text) == ids, text
    assert ours.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(both, text):
    same(both, text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=("Cn", "Co", "Cs")), max_size=60))
def test_any_text(both, text):
    same(both, text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(categories=("Cn", "Co", "Lo", "Lu", "No")), max_size=40))
def test_unassigned_and_private_code_points(both, text):
    same(both, f"a{text}1")


def test_every_code_point_beside_letters_and_digits(both):
    """All code points but surrogates, assigned or not: each between letters and between digits."""
    ours, theirs = both
    for first in range(0x80, 0x110000, 32_768):
        texts = [f"a{chr(c)}b 1{chr(c)}2" for c in range(first, min(first + 32_768, 0x110000)) if not 0xD800 <= c < 0xE000]
        for text, e in zip(texts, theirs.encode_batch(texts, add_special_tokens=False), strict=True):
            assert ours.encode(text) == e.ids, ascii(text)


def test_documents(both, spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (None, "a b")], "doc_id long, text string")
    rows = bpe.encode_decode(docs.select("doc_id", "text", F.lit(1).alias("id"), F.lit("x").alias("ids")).unionByName(extra, allowMissingColumns=True), PATH).collect()
    got = {r["id"]: r for r in rows}
    assert len(rows) == docs.count() + 3
    assert got[-1]["ids"] == [] and got[-2]["decoded"] == ""
    for r in docs.collect():
        ids = both[1].encode(r["text"], add_special_tokens=False).ids
        assert got[r["doc_id"]]["ids"] == ids
        assert got[r["doc_id"]]["decoded"] == both[1].decode(ids, skip_special_tokens=False)


def test_empty_table(spark):
    assert bpe.encode_decode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
