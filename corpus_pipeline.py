"""A corpus pipeline: each stage takes the documents that the one before it kept.

All stages take whole texts of any length, and the columns of ``documents`` with any others beside them, also
ones with names that an operator uses itself; all but the last return the columns they got. An empty table gives an
empty one. Each stage's docstring says what it does with nulls, empty texts, ties and repeated rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from readgraph.llm import bpe, exact_dedup, mixing, near_dedup, quality
from readgraph.llm.common import materialize, table
from readgraph.llm.queries import VOCABULARY


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is fitted on labelled rows outside the held-out fold.

    A null text counts as empty, and all empty texts have one score. Rows with equal texts, repeated ones too,
    are accepted or rejected together; a score of exactly 0.5 is accepted. Rows with a null doc_id are judged as any
    other, and rows pass as they are. Without labels of both kinds each text gets the labels' smoothed share.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # so that no column is taken for one of the operator's
    place = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    scored = quality.score(numbered, model, key=place["doc_id"], text=place["text"])
    return scored.filter("predicted = 1").select(*numbered.columns).toDF(*docs.columns)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest doc_id.

    Null and empty texts are one text, which comes back as empty. A null doc_id is smaller than any other. Rows that
    tie in doc_id and text are told apart by their other columns, and one of them stays, also of repeated rows.
    """
    return exact_dedup.keep_one(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the smallest doc_id.

    Null and empty texts are one class; a null text stays null. A null doc_id stays only if its class has no other.
    Of rows that share the doc_id, or are repeated, one stays.
    """
    return near_dedup.keep_one(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, 0 to 3 times.

    Null and empty texts have no words: they are taken as often as their hash says, and count for nothing. A null
    source is a source, the last. Rows with one doc_id, null or repeated, are taken alike, as they share a hash.
    """
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's tokens, as a count and digests, in place of its text.

    A null text counts as empty, which has no tokens. Each row is its own result, repeated rows and ties too.
    """
    return bpe.encode(docs, bpe.load_ranks(public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN)


STAGES = [
    ("quality_filter", quality_filter),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("source_mixing", source_mixing),
    ("tokens", tokens),
]

#: The first stage can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
