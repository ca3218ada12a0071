"""Token ids of the sentencepiece library through a table of distinct chunks.

The library puts a marker in front of a text and for every blank. Where no piece of the model holds a marker behind another
character, no merge crosses from a word into the marker that follows: a text can be cut in front of every run of markers,
and each chunk has the ids that it has inside the text. So every distinct chunk of the whole input is segmented once.

A slice of texts has a table of its distinct chunks; the library segments each of them once, and the ids come back to the
places in the texts by the numbers of their chunks. Slices are bounded by bytes, so the table is bounded too, and nothing is
shuffled or written: one table for the whole input, joined back by shuffles, was built first and took more disk than
the input has (see README)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .tokens import pack_ids

MARK = "▁"
#: A last single marker stays with the word before it: by itself it would be an empty text to the library.
CHUNK = re.compile(f"{MARK}+[^{MARK}]+(?:{MARK}\\Z)?|{MARK}+")
#: Characters that a normalizing model would change.
PROBE = " ééﬁ①Ａ \t\n\r　  a "


def processor(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def can_be_cut(model: str) -> bool:
    """Whether chunks have the ids that they have inside texts: no piece crosses into a marker, and the library only adds
    one marker in front and replaces blanks."""
    import sentencepiece

    library = processor(model)
    pieces = (library.id_to_piece(i) for i in range(len(library)))
    marked = sentencepiece.SentencePieceNormalizer(model_file=model).normalize(PROBE) == (MARK + PROBE).replace(" ", MARK)
    return marked and not any(MARK in p.lstrip(MARK) for p in pieces)


def chunks_of(text: str) -> list[str]:
    """Marked chunks of a text; together they are the marked text."""
    return CHUNK.findall((MARK + text).replace(" ", MARK)) if text else []


def segmented(chunks: list[str], library) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all chunks, ids per chunk) of distinct chunks."""
    found = library.encode([c[1:] for c in chunks], num_threads=1)      # the library puts the first marker back
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter((i for ids in found for i in ids), np.uint32, int(sizes.sum())), sizes


def encode_texts(texts: list[str | None], library, cut: bool = True) -> Iterator[np.ndarray]:
    """The ids of each text, through the table of their distinct chunks. Without `cut`, a text is one chunk."""
    known: dict[str, int] = {}
    places = []
    for text in texts:
        found = (chunks_of(text) if cut else [MARK + text]) if text else []
        places.append(np.fromiter((known.setdefault(c, len(known)) for c in found), np.int64, len(found)))
    ids, sizes = segmented(list(known), library)
    starts = np.cumsum(sizes) - sizes
    for codes in places:
        n = sizes[codes]
        ends = np.cumsum(n)
        # Place by place: the run of ids of the chunk there.
        yield ids[np.repeat(starts[codes] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]


def encode_and_decode(docs: DataFrame, model: str, limit: int = 1 << 25) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_tokens, ids (packed, see `tokens.unpack_ids`), ids_sha256 (of the
    decimal ids joined by commas), decoded_sha256 (of the text that the library decodes from them).

    A null text counts as empty: no ids, empty decoded text. Rows with a null or repeated doc_id are rows like others; an
    empty table gives an empty one; other columns are ignored. A task holds one slice: `limit` bytes of text, or one longer
    text. Models whose pieces cross markers, or that normalize texts, get whole texts."""
    cut = can_be_cut(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = processor(model)
        for batch in batches:
            for a, b in slices(batch.column("text"), limit):
                out = []
                for ids in encode_texts(batch.column("text").slice(a, b - a).to_pylist(), library, cut):
                    plain = ids.tolist()
                    decoded = library.decode(plain) if plain else ""
                    out.append((len(plain), pack_ids(ids), hashlib.sha256(",".join(map(str, plain)).encode()).hexdigest(),
                                hashlib.sha256(decoded.encode()).hexdigest()))
                columns = zip(zip(*out), (pa.int64(), pa.binary(), pa.string(), pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *(pa.array(c, t) for c, t in columns)],
                                                 ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string")
