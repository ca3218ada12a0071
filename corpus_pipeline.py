"""A corpus, from documents to packed sequences: each stage works on what the one before has kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewise.llm import lines, mixing, packing, simhash, toxicity
from tapewise.llm.common import drop, read, table, tuck, untuck


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network does not reject; it learns from the labelled ones that are not held out."""
    rows = tuck(docs, "doc_id", "text")
    return toxicity.judge(rows, read(spark, sf_dir, "labels"), keep_text=True).filter("predicted = 0").select(untuck(rows, docs))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of three-line windows that came before; n_chars follows the text."""
    rows = tuck(docs, "doc_id", "text", "n_chars")
    n_chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return lines.remove_repeats(rows).withColumn("n_chars", n_chars).select(untuck(rows, docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first by id, of each group that chains by SimHash fingerprints within three bits or by five-word
    shingles of a Jaccard similarity of 0.8: three bits alone miss most pairs near 0.8."""
    return simhash.keep_one(docs, similarity=0.8)


def mixed_by_source(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: weights 3, 1, 2 by source name, 150 % of all words, no
    source more than twice."""
    rows = tuck(docs, "doc_id", "text", "source")
    copy = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    return mixing.mix(rows).filter("copies > 0").select(*rows.columns, copy).select(untuck(rows, docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, lexically near documents together."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("SimHash near-dedup", one_of_each_group),
    ("mixing sources to target weights", mixed_by_source),
    ("packing", packed),
]

# The network and the packing have no SQL form; tests/llm/test_texts.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each stage's rows are written and read again by the next one, and go when
    that one's are complete."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            drop(before)
        before = docs
    return docs
