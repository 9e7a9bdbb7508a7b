"""A pipeline over ``documents``: quality rules, line dedup, near duplicates, decontamination, packing.

Each stage works on all its predecessor kept, which is written as Parquet and
read again in between. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontamination, jaccard_join, line_dedup, packing, quality_rules, queries, shared

WORD = r"[^\x20\x09-\x0D]"

BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def changed(docs: DataFrame) -> DataFrame:
    """Documents after their texts were cut: those without a word left go, and n_chars follows the text."""
    docs = docs.where(F.col("text").rlike(WORD))
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs go; documents of which no word is left go."""
    return changed(line_dedup.dedup(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the smallest id stays."""
    return jaccard_join.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out; documents of which no word is left go."""
    return changed(decontamination.cut(docs, queries.table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths, with the digest of their ids."""
    packed = packing.pieces(docs, queries.tokenizer_path(queries.TOKENIZER))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("packing", pack),
]

#: SQL has no tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.

    Where the session doesn't say how many bytes an Arrow batch may have, it is
    set to ``BATCH_BYTES``: batches of 10,000 whole texts take much memory on
    both sides. Results don't depend on it.
    """
    if spark.conf.get(BATCHES, None) is None:
        spark.conf.set(BATCHES, str(BATCH_BYTES))
    docs = queries.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = shared.stored(docs, f"stage-{k}")
    return docs
