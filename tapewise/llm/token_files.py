"""Token ids in binary files: frequency-ranked ids, byte-aligned variable-length coding, control bytes apart.

A file holds the documents of one run of the sorted order:

    magic "TWSV1", documents (uint32), ids (uint64), then
    document lengths (uint32 each), document ids (int64 each), document id present (uint8 each),
    control bytes (four ids each: two bits per id, its bytes less one), data bytes (little-endian, 1 to 4 per id).

What is coded is the id's rank by frequency in all documents (0 = most frequent, ties by id), so that common ids take
one byte. `ranks.ids` beside the files has the magic and the id of each rank (uint32). Files are written under names that no
other attempt uses, and only files that the manifest names are read: a task that is run again leaves no second copy."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import new_folder
from .common import drop, table
from .tokens import token_counts, token_table, unpack_ids

MAGIC = b"TWSV1"
HEADER = struct.Struct("<5sIQ")
# By control byte: the sizes of its four ids.
SIZES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit integers."""
    values = ranks.astype("<u4")
    less = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) <= less[:, None]]
    four = np.concatenate([less, np.zeros(-len(less) % 4, np.uint8)]).reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n integers of control and data bytes (uint8 arrays), by lookup of the sizes."""
    sizes = SIZES[control].reshape(-1)[:n]
    at = np.cumsum(sizes) - sizes
    out = np.zeros(n, np.uint32)
    for k in range(int(sizes.max(initial=1))):
        has = sizes > k
        out[has] |= data[at[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_file(doc_ids: list[int | None], docs: list[np.ndarray]) -> bytes:
    """Bytes of one file; docs are arrays of ranks."""
    ranks = np.concatenate(docs) if docs else np.empty(0, np.uint32)
    control, data = encode_ranks(ranks)
    return b"".join([HEADER.pack(MAGIC, len(docs), len(ranks)), np.array([len(d) for d in docs], "<u4").tobytes(),
                     np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
                     np.array([d is not None for d in doc_ids], np.uint8).tobytes(), control, data])


def read_file(content: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, document lengths, ranks of all documents)."""
    magic, n, total = HEADER.unpack_from(content)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = HEADER.size
    lengths = np.frombuffer(content, "<u4", n, at)
    ids = np.frombuffer(content, "<i8", n, at + 4 * n).tolist()
    present = np.frombuffer(content, np.uint8, n, at + 12 * n).tolist()
    control = np.frombuffer(content, np.uint8, (total + 3) // 4, at + 13 * n)
    ranks = decode_ranks(control, np.frombuffer(content, np.uint8, -1, at + 13 * n + len(control)), total)
    return [d if p else None for d, p in zip(ids, present)], lengths, ranks


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and host of the file system by which Spark reads it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def _put(path: str, content: bytes) -> None:
    from pyarrow import fs

    store, name = (fs.LocalFileSystem(), path.removeprefix("file:").replace("///", "/", 1)) if path.startswith("file:/") else fs.FileSystem.from_uri(path)
    store.create_dir(name.rpartition("/")[0], recursive=True)
    with store.open_output_stream(name) as out:
        out.write(content)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None,
                      file_ids: int = 1 << 22) -> tuple[str, DataFrame]:
    """Encode documents (doc_id, text) and write their ids in ascending doc_id order (null first, equal ids by text
    hash). Returns the folder and the manifest (part, first, docs, ids, file): files in order of (part, first).

    One range shuffle of the texts; the ids are kept in a written table between counting and coding. A file takes
    documents until it holds `file_ids` ids, so memory is bounded by that and the longest document."""
    spark = docs.sparkSession
    folder = qualified(spark, folder or new_folder(spark, "token-files"))
    # The hash spreads rows of one doc_id (null, say) over several tasks.
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("_tie")).repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    tokens = token_table(ordered, tokenizer, end_id)
    # At most the vocabulary's size.
    ranked = [r.token for r in token_counts(tokens).orderBy(F.desc("times"), "token").select("token").collect()]
    order = np.array(ranked, "<u4")
    _put(f"{folder}/ranks.ids", MAGIC + order.tobytes())
    rank = np.zeros(int(order.max(initial=0)) + 1, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, held, ids, docs = None, 0, 0, [], []

        def close() -> pa.RecordBatch:
            name = f"{part:08d}-{first:012d}-{uuid.uuid4().hex}.ids"
            _put(f"{folder}/{name}", write_file(ids, docs))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int32()), (first, pa.int64()), (len(docs), pa.int64()), (held, pa.int64()), (name, pa.string()))],
                                              ["part", "first", "docs", "ids", "file"])

        for batch in batches:
            for p, place, doc_id, packed in zip(*(batch.column(c).to_pylist() for c in ("part", "place", "doc_id", "ids"))):
                if docs and (p != part or held >= file_ids):
                    yield close()
                    held, ids, docs = 0, [], []
                if not docs:
                    part, first = p, place
                docs.append(rank[unpack_ids(packed)])
                ids.append(doc_id)
                held += len(docs[-1])
        if docs:
            yield close()

    manifest = table(tokens.filter("ids is not null").select("part", "place", "doc_id", "ids").mapInArrow(
        run, "part int, first long, docs long, ids long, file string"), "manifest")
    drop(tokens)
    return folder, manifest


def read_token_files(folder: str, manifest: DataFrame) -> DataFrame:
    """What the files of a manifest hold: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of its
    ids as little-endian unsigned 32-bit integers), part, file_place."""
    spark = manifest.sparkSession
    binary = spark.read.format("binaryFile")
    table_row = binary.load(f"{folder}/ranks.ids").select("content").collect()     # the vocabulary's size
    order = np.frombuffer(table_row[0][0], "<u4", offset=len(MAGIC)).copy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("file").to_pylist(), batch.column("content")):
                doc_ids, lengths, ranks = read_file(content.as_buffer())
                ids = order[ranks].astype("<u4")
                ends = np.cumsum(lengths, dtype=np.int64)
                begins = ends - lengths
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(crc), pa.string()), pa.array(range(len(crc)), pa.int64()), pa.array(doc_ids, pa.int64()),
                     pa.array(begins, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                    ["file", "file_place", "doc_id", "inside", "n_tokens", "ids_crc32"])

    # Parts are the tasks of the range sort; files of one part are summed first.
    by_part = Window.partitionBy("part").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("ids")).select(
        "part", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    starts = manifest.select("part", "file", F.coalesce(F.sum("ids").over(by_part), F.lit(0)).alias("inside_part")).join(parts, "part").select(
        "part", "file", (F.col("part_start") + F.col("inside_part")).alias("file_start"))
    files = binary.option("pathGlobFilter", "*-*-*.ids").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    rows = files.join(manifest.select("file"), "file", "left_semi").mapInArrow(
        run, "file string, file_place long, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(starts, "file").select("doc_id", (F.col("file_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32",
                                            "part", "file_place")
