"""Operator 10: quality rules with risk-controlled thresholds.

Each text gets counts; rules compare a rate with a cutoff. Cutoffs are learned for each stratum on labelled documents, in two
parts that the id's hash draws. One part lays a path: joint cutoffs of all rules, from lenient to strict, each set rejecting all
that the one before it rejects. The other part, the holdout, tests the path: walking along it, a set of cutoffs is safe while
the exact binomial test rejects "more than `risk` of the stratum's good documents would fall to any of its rules". A walk along a
path that the holdout had no say in spends its level once (fixed-sequence testing), and the level is shared out over the strata
that have enough good documents to pass at all (Bonferroni), so with probability 1 - `level` no stratum loses more than `risk` of its
good documents to the learned rules. Among a stratum's safe sets the one of most worth is taken, bad documents caught against
good ones lost.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.llm.common import batches_of, id_and_bytes, rows_of, settle

#: Base rule: fewer words than this, or more than this part of the words in repeated windows of so many words.
LEAST_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = b"#*$%&|<>"
_CONTINUED = bytes(range(0x80, 0xC0))
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Learned rules: a name, and the count that is divided by another one; all of them reject above their cutoff.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "upper": ("n_upper", "word_chars"),
    "exclaims": ("n_exclaims", "word_chars"),
    "echoes": ("n_echoes", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
}
#: Cutoffs are tried at these many steps from 1 down to 0.
STEPS = 200
#: Most good documents, as a part, that all learned rules together may reject in a stratum; and the chance that this fails somewhere.
RISK, LEVEL = 0.05, 0.05
#: One labelled id in so many lays the paths, and what parts of the good documents a rule may cost at the points of a path.
PATH_PART = 3
ALLOWED = (0.0, 0.001, 0.002, 0.005, 0.01, 0.015, 0.02, 0.03, 0.04)
#: Among safe sets of cutoffs a good document lost weighs as much as so many bad ones; a rule must gain more than this part of the bad ones.
DEAR, LEAST_CAUGHT = 10.0, 0.01

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_exclaims", "n_echoes", "n_lines")


def repeat_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words in windows of `size` words that are found twice or more."""
    windows = list(zip(*(words[k:] for k in range(size)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    times, covered, upto = Counter(windows), 0, 0
    for at, window in enumerate(windows):
        if times[window] > 1:
            covered += at + size - max(at, upto)
            upto = at + size
    return covered


def counts(body: bytes) -> tuple[int, ...]:
    """COUNTS of a text in UTF-8. Words are `[^\\x20\\x09-\\x0D]+`, which is how bytes split."""
    words = body.split()
    joined = b"".join(words)
    lines = [line for line in body.split(b"\n") if line.strip()]
    echoes = sum(map(bytes.__eq__, words, words[1:])) if len(words) > 1 else 0
    return (
        len(words),
        len(joined.translate(None, _CONTINUED)),
        len(joined) - len(joined.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(joined) - len(joined.translate(None, _UPPER)),
        joined.count(b"!"),
        echoes,
        len(lines),
    )


MEASURED = pa.schema([("id", pa.int64()), ("stratum", pa.string()), *((name, pa.int64()) for name in COUNTS)])


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Columns id, stratum and COUNTS for each row of `df`; a null text has no words, a null stratum is the empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(((key, stratum, *counts(body)) for key, body, stratum in rows_of(batches)), MEASURED)

    source = id_and_bytes(df, id_col, text_col) if stratum_col not in df.columns else df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("body"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"))
    if "stratum" not in source.columns:
        source = source.withColumn("stratum", F.lit(""))
    return source.mapInArrow(run, "id long, stratum string, " + ", ".join(f"{name} long" for name in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def rate(rule: str) -> Column:
    above, below = RULES[rule]
    return F.when(F.col(below) > 0, F.col(above) / F.col(below)).otherwise(F.lit(0.0))


def tail_below(k: int, n: int, p: float) -> float:
    """Exact chance of at most k of n at probability p."""
    if p <= 0 or k >= n:
        return 1.0
    if p >= 1:
        return 0.0
    log = math.lgamma(n + 1)
    return min(1.0, math.fsum(math.exp(log - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1)))


def least_good(risk: float, level: float) -> int:
    """Good documents below which not even a loss of none passes the test."""
    return math.ceil(math.log(level) / math.log1p(-risk))


def lay_path(good: dict[str, list[int]], bad: dict[str, list[int]]) -> list[dict[str, int]]:
    """Joint cutoffs (rule to step; a rule without one rejects nothing) from lenient to strict, from histograms of each rule's steps.

    A rule's cutoff at an allowance is the strictest step at which no larger part of the good documents falls to that rule; before
    the first such set come some between it and 1. A rule joins, for good, where it catches more than LEAST_CAUGHT of the bad documents and
    the best of those already there leaves as many.
    """
    junk = max(1, max((sum(h) for h in bad.values()), default=0))

    def step(rule: str, allowed: float) -> int:
        most, lost, at = allowed * max(1, sum(good[rule])), 0, STEPS
        while at > 1 and (lost := lost + good[rule][at - 1]) <= most:
            at -= 1
        return at

    def caught(rule: str, at: int) -> int:
        return sum(bad[rule][at:])

    path: list[dict[str, int]] = []
    chosen: list[str] = []
    for allowed in ALLOWED:
        at = {r: step(r, allowed) for r in good}
        for rule in sorted(good, key=lambda r: -caught(r, at[r])):
            left = junk - max((caught(r, at[r]) for r in chosen), default=0)
            if rule not in chosen and left > LEAST_CAUGHT * junk < caught(rule, at[rule]):
                chosen.append(rule)
        if not path and chosen:
            path += [{r: at[r] + (STEPS - at[r]) * k // 4 for r in chosen} for k in (3, 2, 1)]
        path.append({r: at[r] for r in chosen})
    return [cutoffs for k, cutoffs in enumerate(path) if cutoffs and (k == 0 or cutoffs != path[k - 1])]


def safe_sets(good: list[int], risk: float, level: float) -> int:
    """How many sets of a path are safe, from the holdout's good documents by the first set that rejects them; the last entry is of those that none does."""
    n, lost = sum(good), 0
    for k in range(len(good) - 1):
        lost += good[k]
        if tail_below(lost, n, risk) > level:
            return k
    return len(good) - 1


def pick_set(good: list[int], bad: list[int], risk: float, level: float) -> int | None:
    """The safe set of most worth; None: none is safe and useful."""
    best = (LEAST_CAUGHT, None)
    lost = caught = 0
    for k in range(safe_sets(good, risk, level)):
        lost, caught = lost + good[k], caught + bad[k]
        if (worth := caught / max(1, sum(bad)) - DEAR * lost / max(1, sum(good))) > best[0]:
            best = (worth, k)
    return best[1]


def shares(sizes: list[int], risk: float, level: float) -> float:
    """The level of one stratum: shared out over those with enough good documents in the holdout, by these sizes alone."""
    count = len(sizes)
    while count > 1 and sum(n >= least_good(risk, level / count) for n in sizes) < count:
        count -= 1
    return level / max(1, count)


def steps_of() -> Column:
    """The step of each rule's rate, in the order of RULES."""
    return F.array(*(F.least(F.floor(rate(rule) * STEPS), F.lit(STEPS - 1)).cast("int") for rule in RULES))


def learn(
    measured: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL, label_id: str = "doc_id", label: str = "quality"
) -> list[tuple[str, str, float]]:
    """(stratum, rule, cutoff) learned on the labelled rows; a row is rejected at a rate of at least the cutoff.

    All labelled rows that pass the base rule count, a third of the ids for the paths and the rest for the tests. What comes to the driver are
    histograms of STEPS steps for each rule, stratum and label, and of the sets of each path, whatever the size of the tables. A
    label that is null or not 0 or 1, or that contradicts another one of the same id, takes no part.
    """
    rules = list(RULES)
    marks = labels.select(F.col(label_id).cast("long").alias("id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1))
    marks = marks.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most")
    lays = (F.crc32(F.col("id").cast("string").cast("binary")) % PATH_PART == 0).alias("lays")
    seen = settle(measured.where(~base_failed()).join(marks, "id").select("stratum", "label", lays, steps_of().alias("steps")))
    histogram = seen.where("lays").select("stratum", "label", F.posexplode("steps").alias("rule", "step")).groupBy("stratum", "label", "rule", "step").count()
    by: dict[str, tuple[dict, dict]] = {}
    for r in histogram.collect():
        of = by.setdefault(r["stratum"], tuple({rule: [0] * STEPS for rule in rules} for _ in range(2)))
        of[r["label"]][rules[r["rule"]]][r["step"]] += r["count"]
    paths = {stratum: path for stratum, (bad, good) in sorted(by.items()) if (path := lay_path(good, bad))}
    if not paths:
        return []
    # For each rule and step the first set of the path that rejects it: a small table, whose size the strata give.
    rows = [(s, [[next((k for k, c in enumerate(path) if c.get(rule, STEPS) <= step), len(path)) for step in range(STEPS)] for rule in rules]) for s, path in paths.items()]
    first = seen.sparkSession.createDataFrame(rows, "stratum string, first array<array<int>>")
    at = F.array_min(F.zip_with("first", "steps", lambda of, step: F.get(of, step))).alias("at")
    counted: dict[str, list[list[int]]] = {s: [[0] * (len(path) + 1) for _ in range(2)] for s, path in paths.items()}
    for r in seen.where("not lays").join(first, "stratum").select("stratum", "label", at).groupBy("stratum", "label", "at").count().collect():
        counted[r["stratum"]][r["label"]][r["at"]] += r["count"]
    share = shares([sum(good) for _, good in counted.values()], risk, level)
    out = []
    for stratum, (bad, good) in counted.items():
        if (k := pick_set(good, bad, risk, share)) is not None:
            out += [(stratum, rule, step / STEPS) for rule, step in sorted(paths[stratum][k].items())]
    return out


def verdict(cutoffs: list[tuple[str, str, float]]) -> Column:
    """True where no learned rule rejects; strata without a cutoff reject nothing."""
    rejected = F.lit(False)
    for rule in RULES:
        mine = {s: c for s, r, c in cutoffs if r == rule}
        if mine:
            cutoff = F.create_map(*(F.lit(x) for pair in mine.items() for x in pair))[F.col("stratum")]
            rejected = rejected | F.coalesce(F.floor(rate(rule) * STEPS) >= F.round(cutoff * STEPS), F.lit(False))
    return ~rejected


def judge(df: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Columns id, stratum, COUNTS, base_failed and kept, one row for each row of `df`.

    Texts are measured once; the small rows of counts are set down in the shared folder, since learning and judging both read
    them. Null texts have no words and fail the base rule; repeated ids are judged row by row; empty labels teach nothing, so
    that only the base rule rejects; an empty table gives no rows; other columns are not carried.
    """
    measured = settle(measure(df, id_col, text_col, stratum_col))
    cutoffs = learn(measured, labels, risk, level)
    return measured.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(cutoffs))


def keep_good(df: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The rows of `df` that are kept, all columns as they are. Two passes over the texts, one to learn and one to filter, and no shuffle of them."""
    cutoffs = learn(settle(measure(df, id_col, text_col, stratum_col)), labels, risk, level)
    steps = {(s, r): round(c * STEPS) for s, r, c in cutoffs}
    names, places = df.columns, {name: k for k, name in enumerate(COUNTS)}

    def good(body: bytes, stratum: str) -> bool:
        n = counts(body)
        if n[0] < LEAST_WORDS or 100 * n[places["n_repeat_words"]] > REPEAT_PERCENT * n[0]:
            return False
        for rule, (above, below) in RULES.items():
            step = steps.get((stratum, rule))
            if step is not None and math.floor((n[places[above]] / n[places[below]] if n[places[below]] else 0.0) * STEPS) >= step:
                return False
        return True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(names.index(text_col)).to_pylist()
            strata = batch.column(names.index(stratum_col)).to_pylist() if stratum_col in names else [""] * len(texts)
            yield batch.filter(pa.array([good((t or "").encode(), "" if s is None else str(s)) for t, s in zip(texts, strata, strict=True)], pa.bool_()))

    return df.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(run, df.withColumn(text_col, F.col(text_col).cast("string")).schema)
