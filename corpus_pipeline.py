"""Quality, near copies, repeated passages, benchmark leaks, packing: documents to training bins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from glyphwell.llm import chunks, decontaminate, packing, quality, simhash
from glyphwell.session import drop_folder, shared_folder


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier doesn't reject.

    Null and empty texts go. Without labels of both classes all others stay. Equal
    documents share their fate; repeated rows all stay or go. Texts are read whole,
    whatever their length; further columns pass through under any name. Of no
    documents none are left.
    """
    return quality.drop_poor(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the least id, nulls last.

    Repeated rows are copies. Null and empty texts all stay. Texts are read whole;
    further columns pass through under any name. Of no documents none are left.
    """
    return simhash.drop_near_copies(docs)


def unrepeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages that stand in another one, ``n_chars`` to match.

    Null and empty texts stay; a text of which only whitespace is left goes. Rows
    that agree in id and text are one document and stay alike. Texts are read
    whole; further columns pass through under any name. Of no documents none are
    left.
    """
    return chunks.drop_repeats(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that repeat no benchmark item.

    Null and empty texts stay, repeated rows all stay or go, and without items
    everything stays. Texts are read whole; further columns pass through under any
    name. Of no documents none are left.
    """
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of a document in the training bins.

    Texts without words are in no bin, repeated rows are packed as often as they
    come, and a long text is cut into pieces. Other columns are not read. Of no
    documents there are no bins.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", good_quality),
    ("simhash_near_dedup", one_of_near_copies),
    ("substring_dedup", unrepeated_passages),
    ("benchmark_decontamination", uncontaminated),
    ("harmonic_packing", packed),
]
#: SQL can't state the ranking model, the fingerprints or the rolling hash.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each written as Parquet and read again.

    A stage's folder is deleted when the next one is written; the last one is what
    the result reads.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop_folder(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
