"""Paragraph dedup against brute force."""

import random

import numpy as np
import pytest

from tapewise.llm import paragraphs as P


def word(rng):
    return "".join(rng.choices("abcdefghij", k=rng.randint(2, 7)))


def prose(rng, n):
    return " ".join(word(rng) + ("\n" if rng.random() < 0.02 else "") for _ in range(n))


def test_paragraphs_do_not_depend_on_neighbouring_texts():
    rng = random.Random(1)
    texts = [prose(rng, n).encode() for n in (0, 3, 400, 30, 1000, 25)] + [b"", b"\n\n", b"a " * 300]
    whole = P.paragraphs(texts)
    for i, t in enumerate(texts):
        alone, own = P.paragraphs([t]), whole.text == i
        assert alone.words.tolist() == whole.words[own].tolist()
        assert alone.content.tolist() == whole.content[own].tolist()
        assert alone.place.tolist() == whole.place[own].tolist()
        assert int(alone.words.sum()) == len(t.split())


def test_a_pasted_passage_falls_into_the_same_paragraphs():
    rng = random.Random(2)
    caught = []
    for _ in range(300):
        passage = " ".join(word(rng) for _ in range(rng.randint(52, 90)))
        a, b = (P.paragraphs([" ".join([" ".join(word(rng) for _ in range(200)), passage, " ".join(word(rng) for _ in range(200))]).encode()]) for _ in range(2))
        both = np.isin(a.content, b.content)
        caught.append(int(a.words[both].sum()) / len(passage.split()))
    assert np.mean(np.array(caught) > 0) > 0.97 and np.mean(caught) > 0.5


def test_bands_are_tuned():
    for similarity, recall in ((0.8, 0.99), (0.5, 0.95), (0.9, 0.999)):
        b = P.tune(similarity, recall)
        assert 1 - (1 - similarity) ** b >= recall > 1 - (1 - similarity) ** (b - 1)


def test_overlap_of_sets():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 40, 12)).astype(np.uint64) for _ in range(30)]
    want = [[len(np.intersect1d(a, h)) for h in sets[:10]] for a in sets[10:]]
    assert P.overlap(sets[:10], sets[10:]).tolist() == want


def by_force(rows, similarity):
    """(id, removed places, origins) by comparing all pairs of paragraphs."""
    units = []
    for d, t, *_ in rows:
        u = P.paragraphs([(t or "").encode()])
        for k in range(len(u.words)):
            if u.count[k]:
                units.append((d if d is not None else 1 << 62, d, k, frozenset(u.shingles[u.first[k]:u.first[k] + u.count[k]].tolist()), u.content[k]))
    label = list(range(len(units)))
    changed = True
    links = [(i, j) for i in range(len(units)) for j in range(i)
             if units[i][4] == units[j][4] or len(units[i][3] & units[j][3]) >= similarity * len(units[i][3] | units[j][3])]
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    gone, origins = {}, {}
    for group in set(label):
        members = sorted((units[i] for i in range(len(units)) if label[i] == group), key=lambda u: (u[0], u[2]))
        for u in members[1:]:
            if u[:3] != members[0][:3]:
                gone.setdefault(u[1], set()).add(u[2])
                origins.setdefault(u[1], set()).add(members[0][1])
    return gone, origins


@pytest.mark.parametrize("cell", [1024, 4])
def test_removal_against_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(P.near_links, "__defaults__", (cell, 64))
    rng = random.Random(7)
    passages = [prose(rng, 70) for _ in range(3)]
    near = [word(rng) for _ in range(22)]
    rows = []
    for i in range(40):
        parts = [prose(rng, rng.randint(1, 150)) for _ in range(2)]
        if i % 3 == 0:
            parts.insert(1, rng.choice(passages))
        if i % 4 == 0:      # a line that differs in its last words
            parts.insert(1, "\n" + " ".join(near[:22 - i % 3] + [word(rng)]) + "\n")
        rows.append((i, " ".join(parts), "x", 1))
    rows += [(100, "short one", "x", 1), (101, "short one", "x", 1), (102, None, None, None), (103, "", "x", 1), (None, rows[0][1], "x", 1), (105, rows[0][1], "x", 1)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, content string, gone int")
    gone, origins = by_force(rows, 0.8)
    found = 0
    for r in P.remove_repeats(docs, recall=0.99999).collect():
        text = next(t for d, t, *_ in rows if d == r.doc_id)
        assert r.n_removed == len(gone.get(r.doc_id, ())), r
        assert r.origins == sorted(origins.get(r.doc_id, ()))
        found += r.n_removed
        if not r.n_removed:
            assert r.text == text
        else:
            u = P.paragraphs([text.encode()])
            kept = [w for k in range(len(u.words)) if k not in gone[r.doc_id] for w in text.encode()[u.begin[k] - 1:u.end[k] - 1].split()]
            assert r.text.encode().split() == kept
    assert found > 40


def test_an_empty_table(spark):
    assert P.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def five_words(line):
    words = line.lower().split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


@pytest.mark.parametrize("cell", [1024, 4])
def test_long_lines_with_inner_changes_against_whole_lines(spark, monkeypatch, cell):
    monkeypatch.setattr(P.near_links, "__defaults__", (cell, 64))
    rng = random.Random(11)
    lines = []
    for size in [50, 80, 120, 200, 300, 400] * 6:
        base = [word(rng) for _ in range(size)]
        for k in range(4):
            copy = list(base)
            for at in rng.sample(range(5, size - 5), k * size // 100):
                copy[at] = word(rng)
            lines.append(" ".join(copy))
    hot = [word(rng) for _ in range(100)]       # many near copies of one line
    lines += [" ".join(hot[:40 + i % 20] + [f"new{i}"] + hot[41 + i % 20:]) for i in range(60)]
    rng.shuffle(lines)
    rows = [(i, f"top {i}\n{line}\nown{i} a b c") for i, line in enumerate(lines)]
    sets = [five_words(x) for x in lines]
    label = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            if label[i] != label[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    want = {i for i in range(len(lines)) if label[i] != i}
    got = {r.doc_id: r for r in P.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), whole_lines=True).collect()}
    whole = {i for i in got if got[i].text == f"top {i}\nown{i} a b c"}
    assert whole <= want and len(whole) >= 0.97 * len(want) > 100
    for i in whole:
        assert got[i].words_removed == len(lines[i].split()) and label[i] in got[i].origins
        assert got[i].n_removed == got[i].n_paragraphs - 2


def test_what_a_removed_line_held_first_stays_elsewhere(spark):
    rng = random.Random(12)
    base = [word(rng) for _ in range(300)]
    changed = [word(rng) for _ in range(30)]        # only in the second document's line, and pasted into the third's
    near = base[:150] + changed + base[150:]
    other = [word(rng) for _ in range(200)] + near[140:190] + [word(rng) for _ in range(200)]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(other))]
    got = {r.doc_id: r for r in P.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), whole_lines=True).collect()}
    assert got[1].text == rows[0][1] and got[2].text == "" and got[2].origins == [1]
    assert set(changed) <= set(got[3].text.split())


def test_only_passages_of_many_words_go(spark):
    rng = random.Random(13)
    make = lambda n: [word(rng) for _ in range(n)]
    passage, phrase, line, block, short = make(55), make(30), make(12), [make(20) for _ in range(3)], make(9)
    rows = [(i, "\n".join([" ".join(make(100) + passage + make(100) + phrase + make(100)), " ".join(line), " ".join(make(6))])) for i in range(12)]
    rows += [(20 + i, "\n".join([" ".join(make(8)), *map(" ".join, block), " ".join(make(8))])) for i in range(2)]     # lines side by side
    rows += [(30, " ".join(short)), (31, " ".join(short)), (32, None), (33, "")]
    got = {r.doc_id: r for r in P.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), whole_lines=True, least=50).collect()}
    assert len(got) == len(rows) and got[0].text == rows[0][1] and got[20].text == rows[12][1] and got[30].text == rows[14][1]
    caught = [i for i in range(1, 12) if not set(passage) <= set(got[i].text.split())]
    assert len(caught) >= 10
    for i in range(1, 12):
        kept = got[i].text.split()
        assert set(line) | set(phrase) <= set(kept)
        assert [w for w in rows[i][1].split() if w not in passage] == [w for w in kept if w not in passage]
    assert got[21].n_removed == 3 and got[21].words_removed == 60 and got[21].origins == [20]
    assert got[31].text == "" and got[32].text is None and got[33].text == ""
