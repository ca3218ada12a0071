"""Token ids by the tokenizers library, with repeated pieces of text encoded once.

Byte-pair encoders first cut a text into pre-tokens and encode each by itself. A batch of texts is therefore cut
at places where the pre-tokenizer is certain to cut as well (vectorized over the bytes), equal pieces are found
by hash, and the library encodes each piece that has not been seen before. Places that are in doubt are not cut:
the library then gets the longer piece. A tokenizer of another kind gets whole texts."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, slices, table

OTHER, LETTER, PUNCT, SPACE, NEWLINE, BLANK, QUOTE = range(7)
# One pre-token whatever the rules are: letters of ASCII or U+00C0 to U+00FF, after one space at most.
PLAIN = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
LONGEST = 64        # longer pieces are encoded without the cache: the hash is made for short ones


def _classes() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for b in range(0x21, 0x7F):
        out[b] = LETTER if chr(b).isalnum() else PUNCT
    out[ord("'")] = QUOTE       # contractions join it with letters
    out[0x20], out[0x0A] = SPACE, NEWLINE
    out[[0x09, 0x0B, 0x0C, 0x0D]] = BLANK
    return out


def _byte_characters() -> dict[int, str]:
    """The characters for which the byte-level tokenizers take bytes: printable ones are themselves, all others follow U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


CLASSES = _classes()
BYTE_CHARACTERS = _byte_characters()
_rng = np.random.default_rng(20_240_731)
VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
POWERS = np.full(LONGEST + 1, 0x9E3779B97F4A7C17, np.uint64)     # powers of an odd base, then a zero
POWERS[0] = 1
POWERS = np.cumprod(POWERS, dtype=np.uint64)
POWERS[LONGEST] = 0
LENGTH_MIX = np.uint64(0xD6E8FEB86659FD93)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values in ascending order, a place of each, which of them each value is). Any place serves, so
    the sort need not be stable, as that of np.unique with places is."""
    order = np.argsort(values)
    ascending = values[order]
    head = np.ones(len(values), bool)
    head[1:] = ascending[1:] != ascending[:-1]
    which = np.empty(len(values), np.int64)
    which[order] = np.cumsum(head) - 1
    return ascending[head], order[head], which


def n_holders(ids: np.ndarray, sizes: np.ndarray, vocabulary: int) -> np.ndarray:
    """By token, how many documents hold it; `ids` are those of all documents, `sizes` how many each has."""
    pairs = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes) * vocabulary + ids
    if len(sizes) * vocabulary < 1 << 32:
        pairs = pairs.astype(np.uint32)
    pairs.sort()
    head = np.ones(len(pairs), bool)
    head[1:] = pairs[1:] != pairs[:-1]
    return np.bincount(pairs[head] % vocabulary, minlength=vocabulary)


class Encoder:
    """encode(texts) -> (ids of all texts, ids per text). `cache` bounds the pieces that are remembered."""

    def __init__(self, path: str, cache: int = 1_500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True      # their strings in a text are ordinary text
        self.vocabulary = self.library.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cutter, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        plain = model.get("type") == "BPE" and not model.get("dropout")
        lead = (plain and not spec.get("normalizer") and cutter.get("type") == "ByteLevel" and cutter.get("use_regex")
                and not cutter.get("add_prefix_space"))
        ends = plain and model.get("end_of_word_suffix") == "</w>" and cutter.get("type") == "Sequence"
        self.kind = "lead" if lead else "drop" if ends else "whole"
        self.model = self.library.model
        # What the normalizer of the second kind does to letters: they are composed already.
        self.lower = ends and [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        steps = cutter.get("pretokenizers") or []
        byte_level = lead or (self.lower and [c.get("type") for c in steps] == ["Split", "ByteLevel"]
                              and r"[\p{L}]+" in (steps[0].get("pattern") or {}).get("Regex", "").split("|"))
        names = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.direct = byte_level and not any(map(PLAIN.fullmatch, names))
        self.values = VALUES.copy()
        if self.kind == "drop":     # white space belongs to no piece
            self.values[np.isin(CLASSES, (SPACE, NEWLINE, BLANK))] = 0
        self.limit = cache
        self._forget()

    def _forget(self) -> None:
        # Hashes of the remembered pieces in ascending order, and their slots: a block's hashes are sorted too, so that all are
        # looked up in one search.
        self.keys, self.slots = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.start, self.size = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)
        self.filled = 0

    def _ids(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece. A plain word is one pre-token, so the library's model gets it at once, which is less work than
        the way through normalizer, pre-tokenizer and batch. All other pieces go that way."""
        plain = [self.direct and PLAIN.fullmatch(p) is not None for p in pieces]
        rest = iter(self.library.encode_batch_fast([p.decode("utf-8", "replace") for p, x in zip(pieces, plain) if not x], add_special_tokens=False))
        return [[t.id for t in self.model.tokenize(self._characters(p))] if x else next(rest).ids for p, x in zip(pieces, plain)]

    def _characters(self, piece: bytes) -> str:
        if self.lower:
            piece = piece.decode().lower().encode()
        return piece.decode("latin-1").translate(BYTE_CHARACTERS)

    def _add(self, pieces: list[bytes]) -> np.ndarray:
        """Encode pieces and append them; their slots."""
        found = self._ids(pieces)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        total = int(sizes.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.filled + len(found) > len(self.start):
            self.start, self.size = (np.concatenate([a, np.empty_like(a)]) for a in (self.start, self.size))
        self.flat[self.used:self.used + total] = np.fromiter(chain.from_iterable(found), np.uint32, total)
        at = slice(self.filled, self.filled + len(found))
        self.size[at] = sizes
        self.start[at] = self.used + np.cumsum(sizes) - sizes
        self.used, self.filled = self.used + total, self.filled + len(found)
        return np.arange(at.start, at.stop)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if self.kind == "whole":
            found = [self.library.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids for t in texts]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes
        buffer = b"\0".join(texts) + b"\0"
        raw = np.frombuffer(buffer, np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        begins = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
        starts, stops = self._pieces(raw, begins, ends)
        counts, out, i = np.zeros(len(texts), np.int64), [], 0
        while i < len(starts):      # blocks of about a megabyte
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + (1 << 20))))
            ids, sizes = self._block(buffer, raw, starts[i:j], stops[i:j])
            owner = np.searchsorted(begins, starts[i:j], side="right") - 1
            counts += np.bincount(owner, weights=sizes, minlength=len(texts)).astype(np.int64)
            out.append(ids)
            i = j
        return np.concatenate(out) if out else np.empty(0, np.uint32), counts

    def _pieces(self, raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kinds = CLASSES[raw]
        # Two-byte letters U+00C0 to U+00FF, without the multiplication and division signs.
        lead = (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
        kinds[:-1][lead] = LETTER
        kinds[1:][lead] = LETTER
        cut = np.zeros(len(raw) + 1, bool)
        left, right = kinds[:-1], kinds[1:]
        cut[1:-1] |= ((left == LETTER) & (right == PUNCT)) | ((left == PUNCT) & (right == LETTER))
        if self.kind == "drop":
            blank = (kinds >= SPACE) & (kinds <= BLANK)
            cut[:-1] |= blank
            cut[1:] |= blank
        else:
            known = (kinds == LETTER) | (kinds == PUNCT) | (kinds == QUOTE)
            between = np.zeros(len(raw), bool)
            between[1:-1] = known[:-2] & known[2:]
            line = between & (kinds == NEWLINE)
            cut[:-1] |= line | (between & (kinds == SPACE))
            cut[1:] |= line
        cut[begins] = True
        cut[ends] = True
        cut[-1] = True
        places = np.flatnonzero(cut)
        separator = np.zeros(len(raw), bool)
        separator[ends] = True
        keep = ~separator[places[:-1]]
        if self.kind == "drop":
            keep &= ~blank[places[:-1]]
        return places[:-1][keep], places[1:][keep]

    def _block(self, buffer: bytes, raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) > self.limit:
            self._forget()
        base, lengths = starts[0], stops - starts
        short = lengths <= LONGEST
        slots = np.empty(len(starts), np.int64)
        kept = self.used, self.filled
        if short.any():
            # Sum of value * power over each piece; what follows a piece up to the next one counts zero or is the same each time.
            span = raw[base:stops[-1]]
            offsets = starts - base
            gaps = np.diff(np.append(offsets, len(span)))
            place = np.minimum(np.arange(len(span)) - np.repeat(offsets, gaps), LONGEST)
            keys = np.add.reduceat(self.values[span] * POWERS[place], offsets) + lengths.astype(np.uint64) * LENGTH_MIX
            unique, first, inverse = distinct(keys[short])
            near = np.searchsorted(self.keys, unique)
            known = near < len(self.keys)
            known[known] = self.keys[near[known]] == unique[known]
            got = np.empty(len(unique), np.int64)
            got[known] = self.slots[near[known]]
            new = np.flatnonzero(~known)
            if len(new):
                at = np.flatnonzero(short)[first[new]]
                got[new] = self._add([buffer[a:b] for a, b in zip(starts[at].tolist(), stops[at].tolist())])
                self.keys = np.insert(self.keys, near[new], unique[new])
                self.slots = np.insert(self.slots, near[new], got[new])
                kept = self.used, self.filled
            slots[short] = got[inverse]
        if not short.all():
            at = np.flatnonzero(~short)
            slots[at] = self._add([buffer[a:b] for a, b in zip(starts[at].tolist(), stops[at].tolist())])
        sizes = self.size[slots]
        before = np.cumsum(sizes) - sizes
        ids = self.flat[np.repeat(self.start[slots] - before, sizes) + np.arange(int(sizes.sum()))]
        self.used, self.filled = kept      # long pieces are not remembered
        return ids, sizes


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pack_ids(ids: np.ndarray) -> bytes:
    """Ids as planes of their lowest, second, ... byte: planes compress better than whole integers."""
    planes = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    width = 2 if not planes[:, 2:].any() else 4
    return bytes([width]) + planes[:, :width].T.tobytes()


def unpack_ids(packed: bytes) -> np.ndarray:
    width = packed[0]
    planes = np.frombuffer(packed, np.uint8, offset=1).reshape(width, -1)
    out = planes[0].astype(np.uint32)
    for k in range(1, width):
        out |= planes[k].astype(np.uint32) << np.uint32(8 * k)
    return out


TOKEN_SCHEMA = "part int, place long, doc_id long, n int, ids binary, token array<int>, times array<long>, holders array<long>"


def token_table(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Written table of encoded documents, one row each: (part, place) is the row's place in the order of `docs`,
    ids its packed ids with `end_id` after them. One more row per task, with null ids, counts the tokens of that task:
    token, times (occurrences) and holders (documents with it) are arrays of at most the vocabulary's size."""
    vocabulary = max(encoder(path).vocabulary, end_id + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, part, place = encoder(path), TaskContext.get().partitionId(), 0
        times, holders = np.zeros(vocabulary, np.int64), np.zeros(vocabulary, np.int64)
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = ["part", "place", "doc_id", "n", "ids", "token", "times", "holders"]

        def made(*columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for batch in batches:
            text = batch.column("text")
            for lo, hi in slices(text):
                ids, sizes = work.encode(byte_texts(text.slice(lo, hi - lo)))
                cuts = np.cumsum(sizes)
                rows = [np.append(x, np.uint32(end_id)) for x in np.split(ids, cuts[:-1])]
                times += np.bincount(ids, minlength=vocabulary)
                times[end_id] += hi - lo
                holders += n_holders(ids, sizes, vocabulary)
                holders[end_id] += hi - lo
                k = hi - lo
                yield made([part] * k, range(place, place + k), batch.column("doc_id").slice(lo, k), [len(r) for r in rows],
                           [pack_ids(r) for r in rows], [None] * k, [None] * k, [None] * k)
                place += k
        seen = np.flatnonzero(times)
        yield made([part], [place], [None], [None], [None], [seen], [times[seen]], [holders[seen]])

    return table(docs.select("doc_id", "text").mapInArrow(run, TOKEN_SCHEMA), "tokens")


def token_counts(tokens: DataFrame) -> DataFrame:
    """(token, times, holders) over all documents of a token table: at most the vocabulary's size."""
    return (tokens.filter("ids is null").select(F.explode(F.arrays_zip("token", "times", "holders")).alias("c")).select("c.*")
            .groupBy("token").agg(F.sum("times").alias("times"), F.sum("holders").alias("holders")))
