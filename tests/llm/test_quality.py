import math
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lettermill.llm import quality


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    covered = {j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(k, k + 5)}
    lines = text.split("\n")
    dup = sum(1 for k, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:k])
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é", "a b c", "#", "\n", " ", "\t", "\x0b", "\x1c", "\x85", "b b b", "日本"]), max_size=60).map(" ".join))
def test_counts(text):
    assert quality.counts(text.encode())[:5] == brute(text)


def test_exact_tail():
    assert abs(quality.tail_below(0, 100, 0.05) - 0.95**100) < 1e-12
    assert abs(quality.tail_below(1, 10, 0.5) - 11 / 1024) < 1e-12
    assert quality.tail_below(5, 5, 0.1) == 1.0


def test_guarantee_holds_over_all_strata():
    """Over many draws of labels, the chance that the strictest set called safe costs any stratum more than the risk stays below the level."""
    rng, broken, learned, draws, risk, level = random.Random(7), 0, 0, 300, 0.1, 0.2
    steps, rules = quality.STEPS, ["a", "b", "c"]
    power = {"a": 8, "b": 12, "c": 20}

    def document(bad):
        return {r: min(steps - 1, int((rng.random() ** (1.5 if bad else power[r])) * steps)) for r in rules}

    for _ in range(draws):
        wrong = False
        holdouts = []
        for _ in range(3):
            hists = [{r: [0] * steps for r in rules} for _ in range(2)]
            for bad, n in ((0, 150), (1, 60)):
                for _ in range(n):
                    for r, at in document(bad).items():
                        hists[bad][r][at] += 1
            path = quality.lay_path(*hists)
            assert all(path[k][r] >= path[k + 1][r] for k in range(len(path) - 1) for r in path[k])
            good = [0] * (len(path) + 1)
            for _ in range(150):
                at = document(0)
                good[next((k for k, c in enumerate(path) if any(at[r] >= x for r, x in c.items())), len(path))] += 1
            holdouts.append((path, good))
        share = quality.shares([sum(good) for _, good in holdouts], risk, level)
        for path, good in holdouts:
            safe = quality.safe_sets(good, risk, share)
            learned += safe > 0
            if safe:
                kept = 1.0
                for r, at in path[safe - 1].items():
                    kept *= (at / steps) ** (1 / power[r])
                wrong |= 1 - kept > risk
        broken += wrong
    assert learned > draws
    assert broken <= draws * level + 2.5 * (draws * level) ** 0.5


def test_share_goes_to_strata_that_can_pass():
    assert quality.least_good(0.05, 0.05) == 59
    assert quality.shares([1000, 58, 3], 0.05, 0.05) == 0.05
    assert quality.shares([1000, 500, 3], 0.05, 0.05) == 0.025
    assert quality.shares([], 0.05, 0.05) == 0.05
    assert quality.safe_sets([0, 0, 58], 0.05, 0.05) == 0
    assert quality.safe_sets([0, 0, 59], 0.05, 0.05) == 2


def by_hand(docs, marks):
    """The kept ids, from single documents instead of histograms."""
    seen = {}
    for key, text, lang in docs:
        n = dict(zip(quality.COUNTS, quality.counts(text.encode()), strict=True))
        failed = n["n_words"] < 10 or 100 * n["n_repeat_words"] > 20 * n["n_words"]
        seen[key] = lang, failed, {r: math.floor((n[x] / n[y] if n[y] else 0) * 200) for r, (x, y) in quality.RULES.items()}
    parts = {}
    for key, y in marks.items():
        lang, failed, at = seen[key]
        if not failed:
            parts.setdefault(lang, {}).setdefault((zlib.crc32(str(key).encode()) % 3 == 0, y), []).append(at)
    paths = {}
    for lang, part in parts.items():
        good, bad, path, used = part.get((True, 1), []), part.get((True, 0), []), [], []
        for allowed in quality.ALLOWED:
            cut = {r: min(c for c in range(1, 201) if sum(d[r] >= c for d in good) <= allowed * max(1, len(good))) for r in quality.RULES}
            hits = {r: sum(d[r] >= cut[r] for d in bad) for r in cut}
            for r in sorted(cut, key=lambda r: -hits[r]):
                if r not in used and hits[r] > 0.01 * max(1, len(bad)) and max(1, len(bad)) - max((hits[x] for x in used), default=0) > 0.01 * max(1, len(bad)):
                    used.append(r)
            if used and not path:
                path = [{r: cut[r] + (200 - cut[r]) * k // 4 for r in used} for k in (3, 2, 1)]
            if used:
                path.append({r: cut[r] for r in used})
        if path:
            paths[lang] = [c for k, c in enumerate(path) if not k or c != path[k - 1]]
    enough = lambda k: sum(0.95 ** len(parts[x].get((False, 1), [])) <= 0.05 / k for x in paths)
    k = next((k for k in range(len(paths), 0, -1) if enough(k) == k), 1)
    cutoffs = {}
    for lang, path in paths.items():
        good, bad, best = parts[lang].get((False, 1), []), parts[lang].get((False, 0), []), 0.01
        for c in path:
            lost, caught = (sum(any(d[r] >= x for r, x in c.items()) for d in group) for group in (good, bad))
            if sum(math.comb(len(good), i) * 0.05**i * 0.95 ** (len(good) - i) for i in range(lost + 1)) > 0.05 / k:
                break
            if (worth := caught / max(1, len(bad)) - 10 * lost / max(1, len(good))) > best:
                best, cutoffs[lang] = worth, c
    return {key for key, (lang, failed, at) in seen.items() if not failed and not any(at[r] >= x for r, x in cutoffs.get(lang, {}).items())}, cutoffs


@pytest.mark.parametrize("folder, strata", [("sf0.001", set()), ("sf0.01", {"en"}), ("sf0.1", {"de", "en", "es", "fr"})])
def test_kept_is_what_single_documents_give(spark, folder, strata):
    docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet")
    labels = spark.read.parquet(f"/root/testdata/{folder}/labels.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    want, cutoffs = by_hand(rows, {r["doc_id"]: r["quality"] for r in labels.collect()})
    assert set(cutoffs) == strata
    assert {r["id"] for r in quality.judge(docs, labels).where("kept").collect()} == want


def test_judge_keeps_good_and_rejects_junk(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    docs, labels = [], []
    for k in range(1600):
        words = [word() for _ in range(40)]
        if k % 4 == 0:
            words = [w.upper() + "!!" for w in words]
        docs.append((k, " ".join(words), "en", 0))
        if k % 5:
            labels.append((k, int(k % 4 != 0), 0))
    docs += [(9001, None, "en", 0), (9002, "", None, 0), (9003, "x " * 30, "en", 0), (9003, "x " * 30, "en", 0), (None, " ".join(word() for _ in range(40)), None, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, kept int")
    marks = spark.createDataFrame([*labels, (None, None, None), (1, 0, 0)], "doc_id long, quality int, toxic int")
    got = {(r["id"]): r for r in quality.judge(df, marks).collect()}
    assert len(got) == 1600 + 4
    assert [r["kept"] for k, r in got.items() if k is not None and k < 9000] == [k % 4 != 0 for k in got if k is not None and k < 9000]
    assert not got[9001]["kept"] and not got[9002]["kept"] and got[9003]["base_failed"] and got[None]["kept"]
    left = quality.keep_good(df, marks)
    assert left.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(k) for k, r in got.items() if r["kept"])
    nothing = quality.judge(df, marks.limit(0)).where("base_failed = kept").count()
    assert nothing == 0
    assert quality.judge(df.limit(0), marks).count() == 0
