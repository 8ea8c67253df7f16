"""A pipeline over documents: quality rules, line deduplication, near duplicates, decontamination, tokenisation.

Each stage is (name, function of (spark, docs, sf_dir)). A stage's rows are written as Parquet and read again as the
next one's docs. All but the last return the columns of docs. Nulls, empty texts, ties, repeated rows, empty tables
and further columns are treated as the operators say. What a stage writes for itself is removed once its rows are written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quayline.llm.common import n_written, new_folder, release, table, written_since
from quayline.llm.decontamination import clean_documents
from quayline.llm.line_dedup import shortened
from quayline.llm.quality import kept_documents
from quayline.llm.queries import vocabulary
from quayline.llm.segmentation import sample_digest
from quayline.llm.similarity_join import one_of_each


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the base rules and the fences of their language and source."""
    return kept_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later repeated runs of lines; every document stays, with n_chars of its new text."""
    return shortened(docs).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least doc_id of each group that links of 0.8 or more over 5-word shingles form."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that share a window of words with a benchmark item."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def segmentations(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples of each document's segmentations without replacement; see quayline.llm.segmentation."""
    return sample_digest(docs, vocabulary("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", segmentations),
]

#: Sampled segmentations have no SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written to the shared folder and read again; the last one's rows stay there."""
    docs, before = table(spark, sf_dir, "documents"), []
    for i, (_, stage) in enumerate(STAGES):
        begun, place = n_written(), new_folder(spark, f"pipeline-{i}")
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
        release(spark, before + [p for p in written_since(begun) if p != place])
        before = [place]
    return docs
