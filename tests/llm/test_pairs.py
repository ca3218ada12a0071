"""Near-duplicates of fingerprints and embeddings, and components, against brute force."""

import random

import numpy as np
import pytest
import xxhash

from tapewise.llm import graph, pivots, simhash


def reach(n, pairs):
    """Smallest member of each member's component."""
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_components_of_chains_stars_and_pairs(spark):
    random.seed(2)
    pairs = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 560)] + [(7, 3), (3, 7), (9, 9), (-5, 8)]
    random.shuffle(pairs)
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 500 for i in range(500, 560)} | {3: 3, 7: 3, -5: -5, 8: -5}


def test_components_of_no_links(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def fingerprint(text):
    """By the definition, bit by bit."""
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split() if w]
    grams = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


TEXTS = [None, "", " \n\t", "a", "A b", "a  B\nc", "Élan ÉLAN élan", "x y z x y z x y z", "one two three four five six", "one two three four five seven",
         "long " * 30_000, "no-break\xa0space is no separator", "\x0bvertical\x0ctab"]


def test_fingerprints_by_definition(spark):
    rows = [(i, t, "fp", 1) for i, t in enumerate(TEXTS)]
    got = simhash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string, lang string, fp int")).collect()
    assert [r.fp & (1 << 64) - 1 for r in sorted(got, key=lambda r: r.doc_id)] == [fingerprint(t) for t in TEXTS]


def near_copies(seed, centres, copies, flips):
    rng = random.Random(seed)
    out = []
    for _ in range(centres):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, copies)):
            out.append(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, flips))))
    return sorted(set(out))


@pytest.mark.parametrize("shard_size", [2000, 20, 3])
def test_trees_find_every_pair(spark, shard_size):
    fps = near_copies(4, 120, 8, 4) + near_copies(5, 1, 300, 2)
    fps = sorted({0, (1 << 64) - 1, *fps})
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    links = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), 3, shard_size)
    at = {f: i for i, f in enumerate(signed)}
    want = reach(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    got = reach(len(fps), [(at[r.a], at[r.b]) for r in links.collect()])
    assert got == want and len(set(want)) < len(fps)


def test_near_documents_and_keeping_one(spark):
    base = [f"w{i}" for i in range(400)]
    texts = {5: " ".join(base), 2: " ".join(base[:-1] + ["other"]), 9: " ".join(base), 7: "quite another text here", None: "quite another text here", 11: None, 12: "", 13: " "}
    rows = [(d, t, None, 1) for d, t in texts.items()] + [(7, "quite another text here", None, 1), (7, "and one more by that id", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, best int")
    assert (fingerprint(texts[5]) ^ fingerprint(texts[2])).bit_count() <= 3
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(5, 2), (2, 2), (9, 2), (7, 7), (None, 7), (11, 11), (12, 11), (13, 11)}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(2, texts[2]), (7, "quite another text here"), (7, "and one more by that id"), (11, None)])


def test_near_documents_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0 and simhash.keep_one(docs).count() == 0


def vectors(seed=3, n=300, dim=24, labels=3):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim))
    rows = []
    for i, v in enumerate(base):
        for k in range(1 if i % 5 else int(rng.integers(2, 12))):
            rows.append((v + 0.12 * k / 12 * rng.standard_normal(dim)).astype(np.float32))
    hot = rng.standard_normal(dim)
    rows += [(hot + 0.05 * rng.standard_normal(dim)).astype(np.float32) for _ in range(150)]
    rows += [rows[0]] * 4 + [rows[3] * np.float32(7)]
    return [(i, r.tolist(), int(i % labels) if i < 200 else 0) for i, r in enumerate(rows)]


def links_by_force(rows, least=0.98):
    def usable(v, label):
        return label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    good = [i for i, (_, v, label) in enumerate(rows) if usable(v, label)]
    pairs = []
    for a, i in enumerate(good):
        for j in good[:a]:
            x, y = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if rows[i][2] == rows[j][2] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                pairs.append((i, j))
    return pairs


@pytest.mark.parametrize("options", [{}, {"list_size": 16}, {"pivots": 32, "sample_size": 64}])
def test_vectors_against_brute_force(spark, options):
    rows = vectors()
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [1.0, None] + [0.0] * 22, [float("inf")] + [1.0] * 23, [1.0, 2.0], [1.0, 2.0], rows[0][1], rows[0][1]]
    rows += [(1000 + i, v, None if i == 8 else 0) for i, v in enumerate(odd)]
    rows += [(None, rows[0][1], rows[0][2]), (4, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "vec_id long, embedding array<float>, label int, first string, size int")
    got = pivots.near_vectors(df, **options).collect()
    pairs = links_by_force(rows)
    links = np.bincount([x for p in pairs for x in p], minlength=len(rows))
    label = reach(len(rows), pairs)
    lowest = {}
    for i, (v, *_ ) in enumerate(rows):
        if v is not None:
            lowest[label[i]] = min(lowest.get(label[i], v), v)
    key = lambda r: tuple((x is None, x) for x in r)
    want = sorted(((v, int(links[i]), lowest.get(label[i], v), v == lowest.get(label[i], v)) for i, (v, *_) in enumerate(rows)), key=key)
    assert len(got) == len(rows)
    # No link that is none; of all links nine in ten at least.
    found = sum(r.n_links for r in got)
    assert found <= 2 * len(pairs) and found >= 0.97 * 2 * len(pairs)
    if not options or "list_size" in options:
        assert sorted((tuple(r) for r in got), key=key) == want


def test_vectors_of_an_empty_table(spark):
    assert pivots.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_the_pipeline_keeps_one_of_near_texts_beyond_three_bits(spark):
    from corpus_pipeline import one_of_each_group

    rng = random.Random(8)
    rows, first, far = [], {}, 0
    for g in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        for k in range(3):      # one word in a hundred or so is another one
            copy = list(base)
            for at in rng.sample(range(10, 190), 2 * k):
                copy[at] = f"v{rng.randrange(5000)}"
            first.setdefault(g, len(rows))
            rows.append((len(rows), "\n ".join(copy) if k else " ".join(copy), "s"))
            far += (fingerprint(rows[first[g]][1]) ^ fingerprint(rows[-1][1])).bit_count() > 3
    rows += [(1000 + i, " ".join(f"u{rng.randrange(5000)}" for _ in range(60)), "s") for i in range(30)] + [(2000, None, "s"), (2001, rows[0][1], "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id for r in one_of_each_group(spark, docs, "").collect()}
    wanted = {*first.values(), *range(1000, 1030), 2000}
    assert far > 40 and wanted <= got and len(got - wanted) <= 2
