"""Quality rules: fixed limits on text statistics, then a learned decision list, in DataFrame functions only.

The list is learned by sequential covering from statistics of labelled documents: a rule grows test by test (a
threshold on one statistic) by information gain on one part of the rows, is pruned from its end on the other part, and
the rows that it covers go before the next one is learned. It is emitted as ordered conditions of a Spark expression."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import REST, n_words, tuck, untuck

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
BLANK = r"[\x20\x09-\x0D]"
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_digits"]


def text_statistics(docs: DataFrame) -> DataFrame:
    """`docs` (text, other columns) without text, with the statistics of the whole text (null: all zero), all long:

    n_words; word_chars, code points in words; n_symbols, characters of #*$%&|<>; n_dup_lines, lines with a word that
    equal an earlier line; n_repeat_words, words inside three-word windows found twice or more in the text;
    n_lines, lines with a word; n_upper, letters A-Z; n_marks, exclamation and question marks; n_digits, 0-9.
    Columns of these names are replaced.

    Window positions are found by sorting the hashes of a text's windows, only where two are equal: no shuffle, and the
    work grows as n log n with the length of a text. 64-bit hashes of one text stand for its words and windows."""
    given = docs.drop(*STATISTICS)
    docs = tuck(given, "text")
    kept = [REST] if REST in docs.columns else []
    text = F.coalesce("text", F.lit(""))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    full = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = F.filter(F.split(text, BLANK + "+", -1), lambda x: x != "")
    # In steps whose columns the next one uses more than once: so each is computed once.
    df = docs.select(*kept, n_words(F.col("text")).alias("n_words"), (F.length(text) - count(BLANK)).alias("word_chars"),
                     count(r"[#*$%&|<>]").alias("n_symbols"), count("[A-Z]").alias("n_upper"), count("[!?]").alias("n_marks"),
                     count("[0-9]").alias("n_digits"), full.alias("_lines"), F.transform(words, lambda x: F.xxhash64(x)).alias("_h"))
    n = F.greatest(F.size("_h") - 2, F.lit(0))
    pairs = F.zip_with(F.slice("_h", F.lit(1), n), F.slice("_h", F.lit(2), n), lambda a, b: F.xxhash64(a, b))
    windows = F.zip_with(pairs, F.slice("_h", F.lit(3), n), lambda p, c: F.xxhash64(p, c))
    numbers = ["n_words", "word_chars", "n_symbols", "n_upper", "n_marks", "n_digits"]
    lines = F.size("_lines")
    df = df.select(*kept, *numbers, lines.cast("long").alias("n_lines"), (lines - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
                   windows.alias("_w"))
    several = F.size(F.array_distinct("_w")) < F.size("_w")
    placed = F.when(several, F.sort_array(F.transform("_w", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    df = df.select(*kept, *numbers, "n_lines", "n_dup_lines", placed.alias("_s"))
    rest = F.size("_s") - 1
    twins = F.filter(F.zip_with(F.slice("_s", F.lit(1), rest), F.slice("_s", F.lit(2), rest), lambda a, b: F.struct(
        (a["x"] == b["x"]).alias("same"), a["i"].alias("a"), b["i"].alias("b"))), lambda t: t["same"])
    covered = F.array_distinct(F.flatten(F.transform(twins, lambda t: F.array(t["a"], t["a"] + 1, t["a"] + 2, t["b"], t["b"] + 1, t["b"] + 2))))
    repeat = F.when(F.col("_s").isNull(), 0).otherwise(F.size(covered)).cast("long")
    return df.select(*kept, *numbers, "n_lines", "n_dup_lines", repeat.alias("n_repeat_words")).select(*untuck(docs, given, "text"), *STATISTICS)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


#: Measures that rules test: a statistic, or one for each of another.
MEASURES = {
    "word length": ("word_chars", "n_words"), "symbols per word": ("n_symbols", "n_words"), "repeated words": ("n_repeat_words", "n_words"),
    "repeated lines": ("n_dup_lines", "n_lines"), "words per line": ("n_words", "n_lines"), "capitals": ("n_upper", "word_chars"),
    "marks per word": ("n_marks", "n_words"), "digits": ("n_digits", "word_chars"), "words": ("n_words", None),
}


def measure(name: str) -> Column:
    over, under = MEASURES[name]
    return F.col(over).cast("double") if under is None else F.when(F.col(under) > 0, F.col(over) / F.col(under)).otherwise(0.0)


def measures(rows: np.ndarray) -> np.ndarray:
    """The same from an array of STATISTICS columns."""
    column = {c: rows[:, i].astype(float) for i, c in enumerate(STATISTICS)}
    return np.stack([column[a] if b is None else np.divide(column[a], column[b], out=np.zeros(len(rows)), where=column[b] > 0)
                     for a, b in MEASURES.values()], axis=1)


@dataclass(frozen=True)
class Test:
    measure: str
    above: bool         # measure >= limit, else measure < limit
    limit: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        column = x[:, list(MEASURES).index(self.measure)]
        return column >= self.limit if self.above else column < self.limit

    def column(self) -> Column:
        return measure(self.measure) >= self.limit if self.above else measure(self.measure) < self.limit


Rule = tuple[Test, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for test in rule:
        out &= test.holds(x)
    return out


def grow(x: np.ndarray, bad: np.ndarray, limits: Sequence[np.ndarray], longest: int = 4) -> Rule:
    """Add the test of the greatest gain (bad rows kept times bits won) until only bad rows are covered."""
    rule: list[Test] = []
    while len(rule) < longest and bad.any() and not bad.all():
        now, best, gain = np.log2(bad.mean()), None, 1e-9
        for name, column, cuts in zip(MEASURES, x.T, limits):
            order = np.argsort(column, kind="stable")
            ordered, hits = column[order], np.concatenate([[0], np.cumsum(bad[order])])
            at = np.searchsorted(ordered, cuts)         # rows below each limit
            for above, p, n in ((True, hits[-1] - hits[at], len(column) - at), (False, hits[at], at)):
                won = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(n, 1)) - now), 0)
                if len(won) and won.max() > gain:
                    best, gain = Test(name, above, float(cuts[int(won.argmax())])), won.max()
        if best is None:
            break
        rule.append(best)
        inside = best.holds(x)
        x, bad = x[inside], bad[inside]
    return tuple(rule)


def prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """The beginning of the rule that best tells bad from good rows; ties go to the shorter one."""
    def worth(r: Rule) -> float:
        inside = covers(r, x)
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=worth, default=())


def learn(statistics: np.ndarray, bad: np.ndarray, precision: float = 0.9, most: int = 12, seed: int = 7) -> list[Rule]:
    """Rules, in order, that find bad rows; limits lie halfway between neighbouring values. Learning ends when too few of
    a pruned rule's rows on the pruning part are bad: (bad + 1) / (rows + 2) below `precision`. So neither doubtful rules
    nor such as few rows support ever drop documents."""
    x = measures(statistics)
    values = [np.unique(c) for c in x.T]
    limits = [(v[1:] + v[:-1]) / 2 for v in values]
    part = np.random.default_rng(seed).random(len(x)) < 2 / 3
    rules: list[Rule] = []
    while len(rules) < most and bad[part].any() and bad[~part].any():
        rule = prune(grow(x[part], bad[part], limits), x[~part], bad[~part])
        inside = covers(rule, x) if rule else np.zeros(len(x), bool)
        tried = inside & ~part
        if not rule or (bad[tried].sum() + 1) / (tried.sum() + 2) < precision:
            break
        rules.append(rule)
        x, bad, part = x[~inside], bad[~inside], part[~inside]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, from 1; null if none does."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, 1))):
        condition = rule[0].column()
        for test in rule[1:]:
            condition = condition & test.column()
        out = F.when(condition, F.lit(k)).otherwise(out)
    return out


def learn_rules(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> list[Rule]:
    """Rules from at most `sample` labelled documents (those with the smallest hash) that pass the base limits."""
    marked = labels.filter("doc_id is not null and quality is not null").select("doc_id", "quality")
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    found = text_statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    # Many rows may hold one id: bounded again, by a sort above the statistics.
    rows = found.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", *STATISTICS).limit(sample).collect()
    # Here, not by a Spark filter: that would be pushed below the steps of the statistics and compute them again.
    rows = [r for r in rows if r.n_words >= MIN_WORDS and 100 * r.n_repeat_words <= MAX_REPEAT_PERCENT * r.n_words]
    rows.sort(key=lambda r: (r.doc_id, r.quality, *[r[c] for c in STATISTICS]))
    if not rows:
        return []
    return learn(np.array([[r[c] for c in STATISTICS] for r in rows], np.int64), np.array([r.quality == 0 for r in rows]))


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """`docs` without text, with the statistics, base_failed, rule (the first that holds) and kept."""
    found = text_statistics(docs).withColumn("base_failed", base_failed())
    return found.withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
