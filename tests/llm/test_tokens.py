"""Token ids, token files and packing, against the library and by round trip."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tapewise.llm import packing, token_files
from tapewise.llm.queries import tokenizer
from tapewise.llm.tokens import Encoder, distinct, n_holders, pack_ids, unpack_ids

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
ENCODERS = {name: Encoder(tokenizer(name)) for name in FILES}
ODD = ["", " ", "\n", " a", "a ", "a  b", "a \n b", "a\n\nb", "x\t y", "it's, don't 'tis dogs' bark   x   y", "éà,É! ×÷ ß.", "é é,́ ≠ x",
       "日本語 テスト。 ok", "<|endoftext|> a<|startoftext|>", "\x00a\x00 b\x00", "a\x1cb \x1c c", "ΣΑΣ Σ. ς", "a  b", "\x85 a",
       "12 34,5 6a7", "a" * 200 + " " + "b" * 70, "ﬁ ½ Ⅷ ²x", "\U0001F600 ok\U0001F600, x", "'s 't 'LL x's,'s $'s", "a" * 64 + " " + "a" * 65]


def expected(name, text):
    return ENCODERS[name].library.encode(text, add_special_tokens=False).ids


def encoded(name, texts):
    ids, sizes = ENCODERS[name].encode([t.encode() for t in texts])
    return [a.tolist() for a in np.split(ids, np.cumsum(sizes)[:-1])]


@pytest.mark.parametrize("name", FILES)
def test_pieces_give_the_ids_of_whole_texts(name):
    assert encoded(name, ODD) == [expected(name, t) for t in ODD]


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.text(alphabet="ab é'.,! \n\t̸́1中\x00×Σ≠ ", max_size=30), min_size=1, max_size=6))
def test_pieces_of_any_text(name, texts):
    assert encoded(name, texts) == [expected(name, t) for t in texts]


class Counting:
    """A library that counts the pieces that go its whole way."""

    def __init__(self, library):
        self.library, self.pieces = library, []

    def encode_batch_fast(self, pieces, **options):
        self.pieces += pieces
        return self.library.encode_batch_fast(pieces, **options)


@pytest.mark.parametrize("name", FILES)
def test_plain_words_take_the_short_way_and_are_remembered(name):
    work = Encoder(tokenizer(name))
    assert work.direct
    work.library = counting = Counting(work.library)
    letters = [chr(c) for c in [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)] if c not in (0xD7, 0xF7)]
    texts = ["Éclair Straße tHe Ÿ the", " ".join(a + b for a in letters for b in "xÉ"), "x×y 7th É́t ÷ don't"]
    for _ in range(2):
        ids, sizes = work.encode([t.encode() for t in texts])
        assert [a.tolist() for a in np.split(ids, np.cumsum(sizes)[:-1])] == [expected(name, t) for t in texts]
    assert 0 < len(counting.pieces) < 10 and len(set(counting.pieces)) == len(counting.pieces)
    assert (work.keys[1:] > work.keys[:-1]).all() and len(work.keys) == len(work.slots) == work.filled


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), max_size=9), min_size=1, max_size=6))
def test_distinct_values_and_holders(docs):
    values = np.array([x for d in docs for x in d], np.uint64)
    found, at, which = distinct(values)
    assert found.tolist() == sorted(set(values.tolist())) and values[at].tolist() == found.tolist() and found[which].tolist() == values.tolist()
    for vocabulary in (7, 1 << 20):
        held = n_holders(values.astype(np.uint32), np.array([len(d) for d in docs]), vocabulary)
        assert held[:7].tolist() == [sum(t in d for d in docs) for t in range(7)] and not held[7:].any()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 70_000), st.integers(0, 2**32 - 1)), max_size=50))
def test_coding_round_trip(values):
    control, data = token_files.encode_ranks(np.array(values, np.uint32))
    assert token_files.decode_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(values)).tolist() == values
    assert unpack_ids(pack_ids(np.array(values, np.uint32))).tolist() == values
    assert len(data) == sum(1 + (v > 0xFF) + (v > 0xFFFF) + (v > 0xFFFFFF) for v in values)


def corpus(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, part int, n int, ids string")     # names that the operators use inside


ROWS = [(i, t, None, 7, 1, "x") for i, t in enumerate(ODD)] + [(None, "no id", None, 7, 1, "x"), (None, None, None, None, None, None),
        (3, "a", "en", 7, 1, "x"), (3, "a", "en", 7, 1, "x"), (900, "word " * 5000, "en", 7, 1, "x")]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("file_ids", [1 << 22, 40])
def test_token_files_hold_every_document_in_order(spark, file_ids):
    folder, manifest = token_files.write_token_files(corpus(spark, ROWS), tokenizer(FILES[1]), 2, file_ids=file_ids)
    rows = token_files.read_token_files(folder, manifest).orderBy("start").collect()
    want = sorted(((d, crc(expected(FILES[1], t or "") + [2])) for d, t, *_ in ROWS), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert sorted(((r.doc_id, r.ids_crc32) for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1])) == want
    assert [r.doc_id for r in rows] == [w[0] for w in want]
    ends = np.cumsum([r.n_tokens for r in rows])
    assert [r.start for r in rows] == [0, *ends[:-1].tolist()]


def test_token_files_of_an_empty_table(spark):
    folder, manifest = token_files.write_token_files(corpus(spark, []), tokenizer(FILES[1]), 2)
    assert token_files.read_token_files(folder, manifest).count() == 0


@pytest.mark.parametrize("shard_ids, task_ids", [(1 << 22, 1 << 25), (100, 1 << 25), (100, 500)])
def test_packing_lays_every_id_once(spark, shard_ids, task_ids):
    random.seed(5)
    words = [f"w{i}" for i in range(400)]
    rows = ROWS + [(1000 + i, " ".join(random.choices(words, k=random.randint(1, 400))), None, 1, 1, "x") for i in range(60)]
    got = packing.pack(corpus(spark, rows), tokenizer(FILES[0]), 1, length=256, shard_ids=shard_ids, task_ids=task_ids).collect()
    whole = {}
    for d, t, *_ in rows:
        whole.setdefault(d, []).append(expected(FILES[0], t or "") + [1])
    assert sum(r.length for r in got) == sum(len(x) for v in whole.values() for x in v)
    for d, texts in whole.items():
        pieces = sorted((r.start, r.length, r.ids_crc32) for r in got if r.doc_id == d and r.doc_tokens in map(len, texts))
        if len(texts) == 1:
            assert [p[0] for p in pieces] == np.cumsum([0] + [p[1] for p in pieces])[:-1].tolist()
            assert all(c == crc(texts[0][s:s + n]) for s, n, c in pieces)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [p[0] for p in parts] == np.cumsum([0] + [p[1] for p in parts])[:-1].tolist()
        total = sum(p[1] for p in parts)
        assert total == 256 or total & (total - 1) == 0


def test_neighbours_are_lexically_near():
    docs = [np.array([5, 6, 7, 8]), np.array([1, 2, 3]), np.array([5, 6, 9]), np.array([7, 7, 7, 1])]
    index = packing.Index(docs, np.ones(10), 3.5, 1.2, 0.75)
    found, score = index.neighbours(0, np.array([False, True, True, True]))
    assert found.tolist() == [2, 3] and score[0] > score[1] > 0


def test_scores_against_brute_force():
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 60, rng.integers(1, 90)) ** 2 // 60 for _ in range(50)] + [np.array([59, 59])]
    docs += [docs[3], docs[3]]      # ties
    idf, mean, k1, b = rng.random(60), float(np.mean([len(d) for d in docs])), 1.2, 0.75
    index = packing.Index(docs, idf, mean, k1, b)
    for doc in range(len(docs)):
        unused = rng.random(len(docs)) < 0.8
        want = np.zeros(len(docs))
        for i, d in enumerate(docs):
            for t in set(docs[doc].tolist()) & set(d.tolist()):
                n = int((d == t).sum())
                want[i] += idf[t] * n * (k1 + 1) / (n + k1 * (1 - b + b * len(d) / mean))
        found, score = index.neighbours(doc, unused)
        assert sorted(found.tolist()) == np.flatnonzero((want > 0) & unused).tolist()
        assert np.allclose(score, want[found], rtol=1e-4) and (np.diff(score) <= 0).all()
        twins = [x for x in found.tolist() if x in (3, 51, 52)]
        assert twins == sorted(twins)


def test_near_documents_draw_the_same_tokens():
    rng = np.random.default_rng(6)
    docs = [rng.choice(5000, 300) for _ in range(200)]
    near = [np.append(d, rng.choice(5000, 15)) for d in docs]
    holders = np.bincount(np.concatenate([np.unique(d) for d in docs + near]), minlength=5000)
    idf = np.log1p((400 - holders + 0.5) / (holders + 0.5))
    drawn = packing.draws(docs + near, idf, holders, 3)
    same = (drawn[:, :200] == drawn[:, 200:]).mean(axis=1)
    assert (same > 0.8).all() and (drawn[0, :200] == np.roll(drawn[0, :200], 1)).mean() < 0.1
    assert packing.draws([np.array([7])], np.ones(9), np.ones(9), 2).tolist() == [[-1], [-1]]


def test_packing_does_not_depend_on_the_layout_of_the_input(spark):
    random.seed(6)
    words = [f"{a}{b}" for a in "river stone window garden market bridge".split() for b in "abcdefghijklmnopqrstuvwxyz"]
    rows = [(i, " ".join(random.choices(words, k=80))) for i in range(80)]
    packs = []
    for n in (1, 8):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(n, "doc_id")
        got = packing.pack(docs, tokenizer(FILES[0]), 1, length=1024, shard_ids=3000).collect()
        packs.append({(r.doc_id, r.start, r.length, r.seed_doc_id, r.score) for r in got})
    assert packs[0] == packs[1]


def test_packing_an_empty_table(spark):
    assert packing.pack(corpus(spark, []), tokenizer(FILES[0]), 1).count() == 0
