"""Packing documents into sequences by lexical retrieval.

Documents are sorted by tokens drawn from them, rare ones more likely, equal documents alike (a weighted MinHash): those that
share such tokens come side by side wherever they were read, and runs of one token are ordered by the next draw, so that no token
makes a task too large. The sorted table is cut into shards (runs of about `shard_ids` ids inside a task). Each shard has a BM25
inverted index whose document frequencies and average length come from all documents; a query is the whole seed document. A
seed's unused neighbours, best first, fill its sequence; the document that does not fit is cut, and its rest opens the
next sequence and is its seed. The open sequence goes on into the next shard, so only the end of a task is short: it is
cut into sequences whose lengths are powers of two, which need no padding."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import token_counts, token_table, unpack_ids

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, seed_doc_id long, score double"


class Index:
    """BM25 inverted index of one shard: postings by token, with the weight of the token in each document."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float, k1: float, b: float):
        sizes = np.array([len(d) for d in docs], np.int64)
        keys, times = np.unique(np.repeat(np.arange(len(docs), dtype=np.int64), sizes) << 32 | np.concatenate(docs).astype(np.int64),
                                return_counts=True)
        owner, token = keys >> 32, keys & 0xFFFFFFFF
        weight = idf[token] * times * (k1 + 1) / (times + k1 * (1 - b + b * sizes[owner] / mean))
        weight = np.round(weight * (1 << 20)) / (1 << 20)       # sums are exact in any order, so equal documents tie
        # A query is every token of the document.
        self.n, self.token, self.cuts = len(docs), token, np.searchsorted(owner, np.arange(len(docs) + 1))
        order = np.argsort(token, kind="stable")
        self.docs, self.weight = owner[order], weight[order]
        self.at = np.searchsorted(token[order], np.arange(len(idf) + 1))
        # Tokens of many documents as rows of a matrix, all others as postings.
        held = np.diff(self.at)
        common = np.flatnonzero(held * 8 > self.n)
        self.row = np.full(len(idf), -1)
        self.row[common] = np.arange(len(common))
        rows = self.row[token]
        self.dense = np.zeros((len(common), self.n))
        self.dense[rows[rows >= 0], owner[rows >= 0]] = weight[rows >= 0]

    def neighbours(self, doc: int, unused: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unused documents that share a query token with `doc`, best first, and their scores."""
        asked = self.token[self.cuts[doc]:self.cuts[doc + 1]]
        rows = self.row[asked]
        begin = self.at[asked[rows < 0]]
        size = self.at[asked[rows < 0] + 1] - begin
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        chosen = np.zeros(len(self.dense))
        chosen[rows[rows >= 0]] = 1
        score = np.bincount(self.docs[at], weights=self.weight[at], minlength=self.n) + chosen @ self.dense
        found = np.flatnonzero((score > 0) & unused)
        found = found[np.argsort(-score[found], kind="stable")]
        return found, score[found]


def draws(docs: list[np.ndarray], idf: np.ndarray, holders: np.ndarray, times: int) -> np.ndarray:
    """(times x documents) tokens, one drawn from each document per time: of its tokens that others have too, the one
    with the least exponential variable, whose rate is the token's idf; -1 without such a token. Documents draw the same
    one with a probability that is the weighted share of their common tokens."""
    sizes = np.array([len(d) for d in docs])
    first = np.cumsum(sizes) - sizes
    flat = np.concatenate(docs)
    out = np.empty((times, len(docs)), np.int64)
    for k in range(times):
        waiting = np.random.default_rng(k).exponential(size=len(idf)) / np.maximum(idf, 1e-9)
        rank = np.argsort(np.argsort(np.where(holders > 1, waiting, np.inf), kind="stable"))
        least = np.minimum.reduceat(rank[flat], first)
        by_rank = np.argsort(rank)
        out[k] = np.where(holders[by_rank[least]] > 1, by_rank[least], -1)
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int, length: int = 2048, shard_ids: int = 1 << 20, task_ids: int = 1 << 25,
         k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Pieces of documents (doc_id, text; a null text is empty) in sequences of `length` tokens: doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset, and the sequence's seed_doc_id with the BM25 score by which it chose
    the document (null for the seed itself and for what it was continued with).

    Every id lies in one piece. Rows with a null or repeated doc_id are documents like all others; of equal scores the document that
    comes first in the sorted shard is taken first."""
    tokens = token_table(docs, tokenizer, end_id)
    counts = token_counts(tokens).collect()         # at most the vocabulary's size
    sums = tokens.filter("ids is not null").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("ids")).first()
    holders = np.zeros(max((c.token for c in counts), default=0) + 1)
    for c in counts:
        holders[c.token] = c.holders
    n, mean = sums["n"], (sums["ids"] or 0) / max(sums["n"], 1)
    idf = np.log1p((n - holders + 0.5) / (holders + 0.5))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                drawn = draws([unpack_ids(p) for p in batch.column("ids").to_pylist()], idf, holders, 3)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), *map(pa.array, drawn)], ["doc_id", "ids", "d0", "d1", "d2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 36
        state = {"sequence": 0, "offset": 0, "seed": None}
        opened: list[tuple] = []        # pieces of the sequence that is being filled: doc_id, start, ids, doc_tokens, score
        made: list[tuple] = []

        def close(pieces: list[tuple]) -> None:
            offset = 0
            for doc_id, start, ids, whole, score in pieces:
                made.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4")), whole, task + state["sequence"], offset, state["seed"], score))
                offset += len(ids)
            state["sequence"] += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*made)) or [[]] * 9
            made.clear()
            types = [pa.int64()] * 8 + [pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [x.split()[0] for x in PIECES.split(", ")])

        def place(doc_id: int | None, ids: np.ndarray, score: float | None) -> bool:
            """Lay a document down, cut at full sequences; whether it closed one."""
            start, closed = 0, False
            while start < len(ids):
                if not opened:
                    state["seed"], score = doc_id, None
                piece = ids[start:start + length - state["offset"]]
                opened.append((doc_id, start, piece, len(ids), score))
                start += len(piece)
                state["offset"] += len(piece)
                if state["offset"] == length:
                    close(opened)
                    opened.clear()
                    state["offset"], closed = 0, True
            return closed

        def end() -> None:
            """The rest of a task, cut into sequences whose lengths are powers of two."""
            rest, left = list(opened), state["offset"]
            opened.clear()
            while left:
                room, taken = 1 << (left.bit_length() - 1), []
                left -= room
                while room:
                    doc_id, start, ids, whole, score = rest.pop(0)
                    if len(ids) > room:
                        rest.insert(0, (doc_id, start + room, ids[room:], whole, score))
                    taken.append((doc_id, start, ids[:room], whole, score))
                    room -= len(taken[-1][2])
                state["seed"] = taken[0][0]
                close(taken)

        def shard(doc_ids: list, docs: list[np.ndarray]) -> None:
            index, unused, following, seed = Index(docs, idf, mean, k1, b), np.ones(len(docs), bool), 0, None
            near: Iterator = iter(())
            for _ in range(len(docs)):
                doc, score = next(((d, s) for d, s in near if unused[d]), (None, None))
                if doc is None:         # no neighbour is left: the next document in order
                    while not unused[following]:
                        following += 1
                    doc, fresh = following, True
                else:
                    fresh = False
                unused[doc] = False
                closed = place(doc_ids[doc], docs[doc], score)
                # The last document laid into a sequence that it opened is the seed of what follows.
                if closed or fresh or seed is None:
                    seed = doc
                    near = zip(*(x.tolist() for x in index.neighbours(seed, unused)))

        doc_ids, docs, held = [], [], 0
        for batch in batches:
            for doc_id, packed in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                doc_ids.append(doc_id)
                docs.append(unpack_ids(packed))
                held += len(docs[-1])
                if held >= shard_ids:
                    shard(doc_ids, docs)
                    yield flush()
                    doc_ids, docs, held = [], [], 0
        if docs:
            shard(doc_ids, docs)
        end()
        if made:
            yield flush()

    drawn = tokens.filter("ids is not null").select("doc_id", "ids").mapInArrow(draw, "doc_id long, ids binary, d0 long, d1 long, d2 long")
    # Spark's own number of tasks, unless they would hold more than `task_ids` ids each.
    least = -(-(sums["ids"] or 0) // task_ids)
    parts = [least] if least > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
    order = ["d0", "d1", "d2", "_tie", "doc_id"]     # the tie spreads copies of one document
    near = drawn.withColumn("_tie", F.xxhash64("ids", "doc_id")).repartitionByRange(*parts, *order).sortWithinPartitions(*order)
    return near.select("doc_id", "ids").mapInArrow(run, PIECES)
