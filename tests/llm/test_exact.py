"""Exact clusters, the hash tree and piece ids, against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapewise.llm import merkle, pieces, subvectors
from tapewise.llm.queries import QUERIES, tokenizer
from tapewise.llm.tokens import unpack_ids

SF = "/root/testdata/sf0.01"
MODEL = tokenizer("piece_bpe_32k.model")
LIBRARY = pieces.processor(MODEL)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- clusters ----------------------------------------------------------------------------------------

def clusters_by_force(rows, k, rounds, dims):
    """(vec_id, cluster, distance, digest of the centroid) with integers of any size; equal first choices by vector."""
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v], [float(x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, sha(f"3:{r[0]}") if r[0] is not None else "", r[2]))[:k]
    centroids = [r[1] for r in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v, _ in kept]
        for c in range(len(centroids)):
            held = [v for (_, v, _), o in zip(kept, own) if o == c]
            if held:
                centroids[c] = [sum(x) // len(held) for x in zip(*held)]
    return [(i, near(v)[1], near(v)[0], sha(",".join(map(str, centroids[near(v)[1]])))) for i, v, _ in kept]


VECTORS = "vec_id long, embedding array<double>, label int, cluster string, codes int, distance long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, None, "x", 1, 2) for i, v in rows], VECTORS)     # names that the operator uses inside


def clustered(df, **kw):
    rows = subvectors.cluster(df, **kw).collect()
    by_cluster = {}
    for r in rows:
        by_cluster[r.cluster] = by_cluster.get(r.cluster, 0) + r.distance
    assert all(r.cluster_inertia == by_cluster[r.cluster] and r.inertia == sum(by_cluster.values()) for r in rows)
    return sorted(((r.vec_id, r.cluster, r.distance, r.centroid_sha256) for r in rows), key=str)


@pytest.mark.parametrize("width, slice_rows", [(1, 7), (2, 1 << 15), (3, 50), (5, 1)])
def test_clusters_of_odd_vectors(spark, width, slice_rows):
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 0.1) for _ in range(5)]) for i in range(60)]
    rows += [(200 + i, rows[3][1]) for i in range(20)] + [(7, rows[7][1]), (None, rows[9][1]), (None, [1e4, -1e4, 0.0, 0.0, 5e-324])]
    rows += [(300, None), (301, []), (302, [0.1] * 4), (303, [0.1, None, 0.1, 0.1, 0.1]), (304, [float("nan")] * 5), (305, [float("inf")] + [0.0] * 4)]
    got = clustered(vectors(spark, rows).repartition(3), k=8, rounds=4, dims=5, width=width, rows=slice_rows)
    assert got == sorted(clusters_by_force(rows, 8, 4, 5), key=str)


def test_ties_few_vectors_and_an_empty_table(spark):
    # All equally far from the two first choices, which are equal: the lower number has them, the other stays as it is.
    rows = [(i, [0.5, -0.5]) for i in range(9)]
    assert {r[1] for r in clustered(vectors(spark, rows), k=2, dims=2)} == {0}
    assert clustered(vectors(spark, rows[:1]), k=8, dims=2) == clusters_by_force(rows[:1], 8, 10, 2)
    empty = subvectors.cluster(vectors(spark, rows).limit(0))
    assert empty.collect() == [] and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_distances_without_an_exact_long_are_an_error(spark):
    with pytest.raises(Exception, match="no long"):
        subvectors.cluster(vectors(spark, [(1, [1e30, 0.0])]), dims=2)


# --- hash tree ---------------------------------------------------------------------------------------

def up(hashes, fanout):
    """Levels of a tree, from its leaves to the root."""
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def way(levels, i, fanout):
    """Siblings left and right of leaf i, level by level."""
    out = []
    for level in levels[:-1]:
        run = level[i // fanout * fanout:][:fanout]
        out.append(("".join(run[:i % fanout]), "".join(run[i % fanout + 1:])))
        i //= fanout
    return out


def manifest_by_force(rows, fanout):
    """(doc_id, leaf, subroot, root, path) of rows (doc_id, source, leaf)."""
    groups = {}
    for d, s, leaf in rows:
        groups.setdefault(s, []).append((d is not None, d or 0, leaf))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: up([leaf for _, _, leaf in sorted(groups[s])], fanout) for s in names}
    top = up([trees[s][-1][0] for s in names], fanout)
    return sorted(((d if known else None, leaf, trees[s][-1][0], top[-1][0], way(trees[s], i, fanout) + way(top, n, fanout))
                   for n, s in enumerate(names) for i, (known, d, leaf) in enumerate(sorted(groups[s]))), key=str)


LEAVES = "doc_id long, source string, leaf string, tree long, place long, n long, hash string, slot0 string, _part int"


def proved(df, fanout):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, [tuple(p) for p in r.path]) for r in merkle.manifest(df, fanout=fanout).collect()), key=str)


@pytest.mark.parametrize("fanout", [2, 3])
def test_manifest_of_odd_rows(spark, fanout):
    rows = [(i, "big", sha(f"b{i}")) for i in range(100)] + [(i, None, sha(f"n{i}")) for i in range(4)] + [(5, "one", sha("one")), (None, "one more", sha("none"))]
    rows += [(None, "big", sha(f"null{i}")) for i in range(3)] + [(50, "big", sha("b50"))] * 4 + [(i, f"é{i}", sha(str(i))) for i in range(7)] + [(1, "", sha("empty"))]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame([(d, s, h, 1, 2, 3, "x", "y", 4) for d, s, h in rows], LEAVES).repartition(5)      # names that the operator uses inside
    assert proved(df, fanout) == manifest_by_force(rows, fanout)


def test_manifest_of_one_leaf_one_source_and_none(spark):
    for rows in ([(1, "s", sha("x"))], [(1, None, sha("x")), (2, None, sha("y"))], [(i, "s", sha("same")) for i in range(9)], []):
        df = spark.createDataFrame([(d, s, h, 1, 2, 3, "x", "y", 4) for d, s, h in rows], LEAVES)
        assert proved(df, 3) == manifest_by_force(rows, 3)


def test_fields_cannot_run_into_each_other(spark):
    rows = [("a", "1:b"), ("a1:b", ""), ("a", None), (None, "a"), ("-", None), (None, None), ("é", "x"), ("a\n", "b"), ("", "")]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(merkle.digest(merkle.field(F.col("a")), merkle.field(F.col("b")))).collect()]
    field = lambda v: "-" if v is None else f"{len(v.encode())}:{v}"
    assert got == [sha(field(a) + field(b)) for a, b in rows] and len(set(got)) == len(rows)


def test_tampering_shows(spark):
    table = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    got = {r.doc_id: r for r in QUERIES["op12_merkle_manifest"](spark, SF).collect()}
    assert len(got) == len(table) and len({r.root for r in got.values()}) == 1
    for r in table:
        changed = zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and "\n" in (r["text"] or "")
        assert got[r["doc_id"]].verified is not changed
    assert 0 < sum(r.verified for r in got.values()) < len(got)


# --- pieces ------------------------------------------------------------------------------------------

ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "\n", "a\n\nb \n c", "\t x", "▁", "a▁b", "▁▁ ▁x", "é ü 日本語 テスト。", "\U0001F600 \U0001F600x", "<s> </s> <unk> <0x41>",
       "\x00 a\x00b", " nbsp x　y", "x" * 5000, " " * 300 + "a" + " " * 40, "́ e ́ é", "ﬁ ①②", "it's 12,345.67", "\r\n a\r b", "﻿bom", "word " * 3000]


def by_chunks(text):
    return [i for c in pieces.chunks_of(text) for i in LIBRARY.encode(c[1:])]


def test_the_given_model_can_be_cut():
    assert pieces.can_be_cut(MODEL)
    for text in ODD:
        assert by_chunks(text) == LIBRARY.encode(text), text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" ▁ab\n\t.é"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_chunks_of_any_text(text):
    assert by_chunks(text) == LIBRARY.encode(text)
    assert "".join(pieces.chunks_of(text)) == (("▁" + text).replace(" ", "▁") if text else "")


@pytest.mark.parametrize("cut, limit", [(True, 1 << 22), (True, 10), (False, 100)])
def test_ids_and_texts_are_those_of_the_library(spark, monkeypatch, cut, limit):
    monkeypatch.setattr(pieces, "can_be_cut", lambda model: cut)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (None, None), (3, "a"), (3, "a"), (900, None)]
    df = spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in rows], "doc_id long, text string, slice string, codes int, chunk string, n_tokens int").repartition(3)
    got = sorted(((r.doc_id, r.n_tokens, unpack_ids(r.ids).tolist(), r.ids_sha256, r.decoded_sha256) for r in pieces.encode_and_decode(df, MODEL, limit).collect()), key=str)
    ids = [(i, LIBRARY.encode(t or "")) for i, t in rows]
    assert got == sorted(((i, len(x), x, sha(",".join(map(str, x))), sha(LIBRARY.decode(x) if x else "")) for i, x in ids), key=str)
    assert pieces.encode_and_decode(df.limit(0), MODEL).collect() == []


def test_pieces_of_all_documents(spark):
    want = {r["doc_id"]: LIBRARY.encode(r["text"] or "") for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    got = {r.doc_id: r for r in QUERIES["op13_sentence_pieces"](spark, SF).collect()}
    assert {d: (len(x), sha(",".join(map(str, x))), sha(LIBRARY.decode(x))) for d, x in want.items()} == {d: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for d, r in got.items()}
