"""Mixing, line windows and quality rules against SQL or brute force."""

import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest

from tapewise.llm import lines, mixing, rules
from tapewise.llm.queries import ORACLES

SCHEMA = "doc_id long, text string, source string, size string, n_lines int, target int, _extra int"


def table(rows):
    return [(d, t, s, "x", 1, 2, 3) for d, t, s in rows]


def sql(name, rows):
    con = duckdb.connect()
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})    # noqa: F841
    con.execute("create table documents as select doc_id::bigint as doc_id, text::varchar as text, source::varchar as source from documents")
    return con.execute(ORACLES[name]).df()


def mix_rows(seed, n=400):
    rng = random.Random(seed)
    sources = ["b", "a", "hot", "hot", "hot", None, "é", "Z", "zero"]
    rows = []
    for i in range(n):
        s = rng.choice(sources)
        rows.append((i, None if rng.random() < 0.05 else " ".join("w" for _ in range(0 if s == "zero" else int(rng.paretovariate(1.2) * 10) % 3000)), s))
    return rows + [rows[0], rows[0], (None, "no id here", "a"), (None, None, None)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_equals_sql(spark, seed):
    rows = mix_rows(seed)
    got = mixing.mix(spark.createDataFrame(table(rows), SCHEMA))
    assert {"_extra", "n_lines"} <= set(got.columns)
    key = ["doc_id", "size", "source_size", "target", "taken"]
    got = got.selectExpr("doc_id", "size", "source_size", "target", "size * copies as taken").toPandas()
    want = sql("op1_mix_sources", rows)
    a, b = (sorted(map(tuple, d[key].astype(object).where(d[key].notna(), None).values.tolist()), key=str) for d in (got, want))
    assert [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in a] == [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in b]


def test_mix_meets_its_targets(spark):
    rng = random.Random(9)
    rows = [(i, " ".join("w" for _ in range(rng.randint(1, 40))), rng.choice("aaaabcdef")) for i in range(3000)]
    df = spark.createDataFrame(table(rows), SCHEMA)
    got = mixing.mix(df).toPandas()
    taken = (got["size"] * got.copies).groupby(got.source).sum()
    target, size = got.groupby("source").target.first(), got.groupby("source").source_size.first()
    assert (abs(taken - target) <= 20).all() and (target <= 2 * size).all()
    assert abs(target.sum() - min(1.5, 2) * size.sum()) < 1e-6 * size.sum()
    again = mixing.mix(df.repartition(7)).toPandas()
    assert sorted(zip(got.doc_id, got.copies)) == sorted(zip(again.doc_id, again.copies))


def test_thresholds_are_nested(spark):
    df = spark.createDataFrame(table(mix_rows(4)), SCHEMA).filter("doc_id is not null")
    low, high = ({(r.doc_id, r.text): r.copies for r in mixing.mix(df, share=s).collect()} for s in (0.6, 0.9))
    assert all(low[k] <= high[k] for k in low)


def test_mix_of_an_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0


def line_rows(seed):
    rng = random.Random(seed)
    pool = [f"line {i}" for i in range(12)] + ["", " ", "\t"]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 14))), "s") for i in range(60)]
    rows += [(100 + i, "\n".join(["hot a", "hot b", "hot c", f"own {i}"]), "s") for i in range(80)]
    return rows + [(300, None, "s"), (301, "", None), (302, "x\n" * 500, "s"), (303, "\n\n\n", "s"), (304, "one\ntwo", "s"), (305, "one\ntwo", "s")]


@pytest.mark.parametrize("seed", [1, 2])
def test_line_windows_equal_sql(spark, seed):
    rows = line_rows(seed)
    got = lines.remove_repeats(spark.createDataFrame(table(rows), SCHEMA)).collect()
    want = {r.doc_id: r for r in sql("op2_line_windows", rows).itertuples()}
    assert len(got) == len(rows)
    for r in got:
        w = want[r.doc_id]
        assert (r.n_lines, r.n_removed) == (w.n_lines, w.n_removed), r
        assert r.text == (None if w.text is None or w.text is pd.NA or w.text != w.text else w.text)
        assert r["_extra"] == 3 and r.target == 2
    # Every distinct line stays somewhere.
    before = {x for _, t, _ in rows for x in (t or "").split("\n") if x.strip()}
    assert before == {x for r in got for x in (r.text or "").split("\n") if x.strip()}


def test_lines_of_rows_without_or_with_one_id(spark):
    text = "a\nb\nc\nd"
    rows = [(5, text, "s"), (5, text, "s"), (None, text, "s"), (None, "z\n" + text, "s"), (None, "q\nr\ns", "s"), (None, "q\nr\ns\nt", "s")]
    got = sorted((r.doc_id or -1, r.text) for r in lines.remove_repeats(spark.createDataFrame(table(rows), SCHEMA)).collect())
    # Of rows without an id the one with the smallest hash is the first; equal rows are one place.
    pairs = [["q\nr\ns", "t"], ["", "q\nr\ns\nt"]]
    assert got in [sorted([(5, text), (5, text), (-1, ""), (-1, "z"), *((-1, x) for x in pair)]) for pair in pairs]
    assert lines.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    full = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, repeated = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i:i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            repeated |= {i + k for i in at for k in range(3)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(full) - len(set(full)),
            "n_repeat_words": len(repeated), "n_lines": len(full), "n_upper": len(re.findall("[A-Z]", text)), "n_marks": len(re.findall("[!?]", text)),
            "n_digits": len(re.findall("[0-9]", text))}


def test_statistics_by_definition(spark):
    rng = random.Random(6)
    texts = [None, "", " ", "a", "a b", "a a a", "a b a b a b", "x " * 9000, "\n\na\n\na\n b\n", "é\xa0ü 日本\x0bq\x0cr\x1cs", "#*$%&|<> !? AbC 019", "a b c a b c d\na b c"]
    texts += [" ".join(rng.choices("ab cd ef gh\n", k=rng.randint(0, 80))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, _h string")
    for r in rules.text_statistics(df).collect():
        assert {c: r[c] for c in rules.STATISTICS} == statistics(texts[r.doc_id]), texts[r.doc_id]
        assert r["_h"] == "x"
    assert rules.text_statistics(df.limit(0)).count() == 0


def test_rules_find_what_marks_bad_rows():
    rng = np.random.default_rng(1)
    n = 3000
    rows = np.zeros((n, len(rules.STATISTICS)), np.int64)
    column = {c: i for i, c in enumerate(rules.STATISTICS)}
    rows[:, column["n_words"]] = rng.integers(50, 900, n)
    rows[:, column["word_chars"]] = rows[:, column["n_words"]] * rng.integers(4, 7, n)
    rows[:, column["n_lines"]] = 10
    symbols = rng.random(n) < 0.1
    rows[symbols, column["n_symbols"]] = rows[symbols, 0] // 2
    loud = rng.random(n) < 0.1
    rows[loud, column["n_upper"]] = rows[loud, column["word_chars"]] // 2
    found = rules.learn(rows, symbols | loud)
    x = rules.measures(rows)
    caught = np.any([rules.covers(r, x) for r in found], axis=0)
    assert (caught == (symbols | loud)).all() and len(found) == 2
    # Labels without reason teach nothing.
    assert rules.learn(rows, rng.random(n) < 0.1) == []
    assert rules.learn(rows[:0], np.zeros(0, bool)) == [] and rules.learn(rows, np.zeros(n, bool)) == []


def test_verdict_is_an_ordered_condition(spark):
    first, second = (rules.Test("symbols per word", True, 0.5),), (rules.Test("words", True, 60.0), rules.Test("capitals", True, 0.9))
    texts = ["## " * 60, "AB " * 70, "ab cd ef gh " * 5 + "xy", " ".join(f"w{i}" for i in range(70)), None]
    got = {r.doc_id: r for r in rules.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), [first, second]).collect()}
    assert [got[i].rule for i in range(5)] == [1, 2, None, None, None]
    assert [got[i].base_failed for i in range(5)] == [True, True, True, False, True]
    assert [got[i].kept for i in range(5)] == [False, False, False, True, False]


def test_learning_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert rules.learn_rules(docs, spark.createDataFrame([], "doc_id long, quality int")) == []
    assert rules.learn_rules(docs, spark.createDataFrame([(None, 0), (1, None), (2, 0)], "doc_id long, quality int")) == []


def test_learning_takes_no_more_rows_than_the_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(rules, "learn", lambda statistics, bad: seen.append(len(bad)) or [])
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text)] * 50 + [(2, text)], "doc_id long, text string")
    rules.learn_rules(docs, spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, quality int"), sample=10)
    assert seen == [10]
