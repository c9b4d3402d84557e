"""Corpus pipeline: language, repeated lines, near duplicates, source mixture and packing, one stage after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next
stage's documents. All but the last return the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docketlake.llm.common import Scratch
from docketlake.llm.curriculum import mix_documents
from docketlake.llm.language_crf import drop_unrecognised
from docketlake.llm.line_dedup import dedup_lines
from docketlake.llm.near_duplicates import drop_near_duplicates
from docketlake.llm.packing import file_place, pack_documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; a null, empty or wordless text goes. Null keys and repeated rows stay; an empty table gives an empty one."""
    return drop_unrecognised(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one; a document that lost lines and has none with a word left goes.

    Null texts and null keys stay as they are; of rows that share a doc_id each loses its own lines; an empty table gives
    an empty one.
    """
    return dedup_lines(docs, drop_emptied=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of near duplicates.

    Of rows that share key and text one stays; rows that share a key alone are documents of their own; otherwise null
    keys and texts without a word stay; an empty table gives an empty one.
    """
    return drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, in the mixture of the default curriculum; every document with a token in its source appears.

    The order is that of the rows: files hold ranges of it. Null texts and texts without a token stand where their
    neighbours do; repeated rows and null keys are documents of their own; an empty table gives an empty one.
    """
    return mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences, which follow the order of ``docs``, with ``place`` and ``epoch`` of each appearance.

    A text without a token has no piece; null keys and repeated rows are packed like others; an empty table gives no rows.
    """
    return pack_documents(docs, order=file_place(docs))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("best_fit_packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.save(docs, name)
    return docs
