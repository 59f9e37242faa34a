import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lettermill.llm import brown
from lettermill.llm.common import Folder, settle


def brute(docs):
    toks = [(i, re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [""]) for i, t in docs]
    out = lambda i: zlib.crc32((str(i) if i is not None else "").encode()) % 7 == 2
    c = Counter(w for i, t in toks if not out(i) for w in t)
    n, v = sum(c.values()), len(c)
    return sorted(((i, out(i), len(t), sum(w in c for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for i, t in toks), key=str)


@pytest.mark.parametrize("hot, seeds", [(200_000, 600), (300, 50), (3, 600)])
def test_documents(spark, hot, seeds):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs += [(None, "The end"), (7001, None), (7002, ""), (docs[3][0], docs[3][1]), (docs[3][0], docs[3][1]), (docs[3][0], "other text"), (7003, "zz9 " * 3000)]
    got = brown.score(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n int"), hot=hot, seeds=seeds).collect()
    assert sorted(((r["id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=str) == brute(docs)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) and r["base_known"] >= r["base_score"] - 1e-9 for r in got)
    same = {(r["base_score"], r["score"]) for r in got if r["id"] == docs[3][0] and r["n_tokens"] > 3}
    assert len({round(s, 6) for _, s in same}) == 1  # equal rows, equal scores


def test_known_tokens_of_held_out_texts_gain(spark):
    """The model beats single words on tokens that both know, so the gain is not that of the mass of unseen words."""
    got = brown.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    held = got.where("held_out").selectExpr("sum(score_known - base_known) / sum(n_known)", "sum(score - base_score) / sum(n_tokens)").first()
    assert held[0] > 0.2 and held[1] > held[0]
    whole = got.where("held_out and n_known = n_tokens").selectExpr("sum(score - base_score) / sum(n_tokens)", "max(abs(score - score_known))").first()
    assert whole[0] > 0.3 and whole[1] < 1e-9


def test_chances_sum_to_one():
    rng = np.random.default_rng(3)
    table = rng.integers(0, 6, (5, 5))
    assert np.allclose((10 ** brown.transitions(table)).sum(1), 1)
    emit = brown.Emissions(np.array([10, 4, 0]), np.array([3, 4, 0]), np.array([1, 4, 0]), np.array([1, 0, 0]))
    counts = np.array([7, 2, 1])
    assert math.isclose((10 ** emit.seen(counts, np.zeros(3, int))).sum() + emit.unseen()[0], 1)
    assert math.isclose(4 * 10 ** emit.seen(np.array([1]), np.array([1]))[0] + emit.unseen()[1], 1)


def test_path_sums_over_the_classes_of_unseen_words():
    rng = np.random.default_rng(4)
    moves, unseen = np.log10(rng.dirichlet(np.ones(3), 3)), np.array([0.2, 0.05, 0.4])
    for seq in ([0, 1, 2], [-1, 1], [0, -1, -1, 2, -1], [-1], []):
        free = [k for k, c in enumerate(seq) if c < 0]
        total = 0.0
        for classes in itertools.product(range(3), repeat=len(free)):
            full = list(seq)
            for k, c in zip(free, classes, strict=True):
                full[k] = c
            one = 1.0
            for a, b in zip([1, *full], full):  # noqa: B905
                one *= 10 ** moves[a, b]
            total += one * math.prod(unseen[c] for c in classes)
        whole, known = brown.path(np.array(seq, np.int64), 1, moves, unseen)
        assert math.isclose(whole, math.log10(total), abs_tol=1e-9)
        assert known >= whole - 1e-12 and (free or known == whole)


def likelihood(pairs, of, classes):
    t = np.zeros((classes, classes))
    for a in range(len(of)):
        for b in range(len(of)):
            t[of[a], of[b]] += pairs[a, b]
    f = lambda x: sum(v * math.log(v) for v in np.ravel(x) if v > 0)
    return f(t) - f(t.sum(0)) - f(t.sum(1))


def test_exchange_ends_where_no_move_helps():
    rng = np.random.default_rng(1)
    pairs = rng.poisson(1 + 6 * (np.arange(12)[:, None] % 3 == (np.arange(12)[None, :] + 1) % 3))
    of = brown.exchange(pairs, 3, 50)
    best = likelihood(pairs, of, 3)
    for w in range(12):
        for c in range(3):
            other = of.copy()
            other[w] = c
            assert likelihood(pairs, other, 3) <= best + 1e-6


def test_every_round_of_exchange_raises_the_likelihood():
    rng = np.random.default_rng(2)
    pairs = rng.poisson(np.outer(1 / np.arange(1, 61), 1 / np.arange(1, 61)) * 4000 * rng.random((60, 60)))
    seen = [likelihood(pairs, brown.exchange(pairs, 8, rounds), 8) for rounds in range(1, 8)]
    assert all(b >= a - 1e-6 for a, b in zip(seen, seen[1:], strict=False)) and seen[-1] > seen[0]


def test_empty_and_untrained(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert brown.score(df).count() == 0
    only = [i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2][:1]
    r = brown.score(spark.createDataFrame([(only[0], "a b")], "doc_id long, text string")).first()
    assert r["held_out"] and r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == 0 and math.isfinite(r["score"])


def kinds(rng, count, texts, length):
    """Texts in which two kinds of rare words follow two kinds of common ones; their letters say nothing."""
    common = [f"{'xy'[k % 2]}{k}" for k in range(20)]
    rare = [f"r{k}{rng.integers(100, 999)}" for k in range(count)]
    out = []
    for _ in range(texts):
        words = []
        for _ in range(length):
            k = int(rng.integers(0, count))
            words += [common[2 * int(rng.integers(0, 10)) + k % 2], rare[k]]
        out.append(" ".join(words))
    return out, rare


@pytest.mark.parametrize("most", [100_000, 100])
def test_every_word_is_offered_every_class(spark, most):
    """All words, those that no task holds among them, end in the class that fits their own neighbours best."""
    texts, rare = kinds(np.random.default_rng(5), 300, 400, 30)
    docs = spark.createDataFrame([(k, t.encode()) for k, t in enumerate(texts)], "id long, body binary").repartition(3)
    counts = brown.count_words(docs)
    hot, least = brown.hot_words(counts, most)
    assert hot[0][0] == brown.END and (len(hot) > 300 if most > 1000 else len(hot) < 101)
    train = settle(brown.encode(docs, [w for w, _ in hot]))
    found = brown.cluster(train, hot, 21, Folder(spark, "test"))
    of = {r["key"]: r["cls"] for r in found.words().collect()}
    words = {r["word"] for r in counts.collect()}
    assert set(of) == {brown.key_of(w) for w in words}
    assert [of[brown.key_of(w)] for w, _ in hot] == found.hot_class.tolist()
    for r in found.found.collect():
        profile = np.zeros(2 * brown.CLASSES)
        cells = np.frombuffer(r["profile"], brown.CELL)
        profile[cells["cell"]] = cells["n"]
        gain = found.logs @ profile
        assert gain[of[r["key"]]] >= gain.max() - 1e-6 if profile.any() else of[r["key"]] == found.default
    split = [Counter(of[brown.key_of(w.encode())] for k, w in enumerate(rare) if k % 2 == kind and w.encode() in words) for kind in (0, 1)]
    assert (split[0] & split[1]).total() <= 0.03 * len(rare), split


def test_only_words_without_known_neighbours_are_marked():
    rng = np.random.default_rng(5)
    keys, of = rng.integers(0, 40, 400), np.where(rng.random(400) < 0.5, rng.integers(0, brown.CLASSES, 400), -1)
    got = brown.beside(keys, of).tolist()
    want = []
    for k, key in enumerate(keys.tolist()):
        cells = [c for c in of[k + 1 : k + 2].tolist() if c >= 0] + [brown.CLASSES + c for c in of[max(k, 1) - 1 : k].tolist() if c >= 0]
        want += [key << brown.CELL_BITS | cell for cell in cells or [2 * brown.CLASSES]]
    assert sorted(got) == sorted(want)


def test_profiles_are_read_where_a_slice_begins():
    packed = np.array([1 << 7 | 3, 1 << 7 | 90, 2 << 7 | 96, 5 << 7 | 0, 9 << 7 | 95])
    (batch,) = brown.packed_profiles(packed, np.array([4, 2**40, 0, 7, 1]))
    for at in range(4):
        keys, rows, cells, n = brown.unpacked(batch.slice(at))
        assert keys.tolist() == [1, 2, 5, 9][at:]
        assert [(keys[r], c, x) for r, c, x in zip(rows, cells, n, strict=True)] == [y for y in [(1, 3, 4), (1, 90, 2**40), (5, 0, 7), (9, 95, 1)] if y[0] in keys]


def test_profiles_count_what_is_beside_a_word(spark):
    rng = np.random.default_rng(6)
    texts = [[f"w{int(rng.zipf(1.3)) % 90}".encode() for _ in range(int(rng.integers(0, 40)))] for _ in range(60)]
    hot = [brown.END, *(f"w{k}".encode() for k in range(30))]
    of = np.where(np.arange(31) % 5 == 4, -1, np.arange(31) % 7)
    docs = spark.createDataFrame([(k, b" ".join(t)) for k, t in enumerate(texts)], "id long, body binary").repartition(4)
    got = {r["key"]: dict(np.frombuffer(r["profile"], brown.CELL).tolist()) for r in brown.profiles(settle(brown.encode(docs, hot)), np.array([brown.key_of(w) for w in hot]), of).collect()}
    want = {}
    place = {w: int(c) for w, c in zip(hot, of, strict=True)}
    for t in texts:
        line = [brown.END, *t, brown.END]
        for a, b in zip(line, line[1:], strict=False):
            for word, other, plus in ((a, b, 0), (b, a, brown.CLASSES)):
                mine = want.setdefault(brown.key_of(word), Counter())
                if place.get(other, -1) >= 0:
                    mine[place[other] + plus] += 1
    assert got == {k: dict(v) for k, v in want.items()}


def test_rounds_never_lower_the_likelihood(spark):
    texts, _ = kinds(np.random.default_rng(8), 60, 100, 20)
    docs = spark.createDataFrame([(k, t.encode()) for k, t in enumerate(texts)], "id long, body binary")
    hot, _ = brown.hot_words(brown.count_words(docs))
    keys = np.array([brown.key_of(w) for w, _ in hot])
    found = settle(brown.profiles(settle(brown.encode(docs, [w for w, _ in hot])), keys, np.arange(len(hot)) % brown.CLASSES))
    start = np.random.default_rng(9).integers(0, 5, (brown.CLASSES, 2 * brown.CLASSES))
    first = brown.fit(brown.retable(found, brown._logs(start), 0))
    logs, default = brown.settle_classes(found, start)
    assert brown.fit(brown.retable(found, logs, default)) > first
