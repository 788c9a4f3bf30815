"""The corpus pipeline: documents of good quality, without copies, near copies and secrets, packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next stage's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from furrow.llm import exact_dedup, mil, near_dup, packing, secrets
from furrow.llm.common import documents, ship, stage_table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on this table and its labels, scores 0.3 or more.

    A null text is scored as an empty one; rows that repeat are scored alike; very long texts are scored in blocks, whole; labels without a row here, and rows with a null id,
    aren't learned from. Without a labelled row nothing can be learned, and all rows stay. No rows give none.
    """
    return mil.keep_good(docs, documents(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, white space aside: the one with the smallest doc_id.

    Null and empty texts are one text; a null doc_id is the largest; of rows that repeat id and text one stays. No rows give none.
    """
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8: the one with the smallest doc_id.

    Documents without words are linked with nothing and stay; a null doc_id counts as the smallest; ties don't occur, as ids differ after the stage before. No rows give none.
    """
    ship(spark)
    return near_dup.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in the text and n_chars counted anew where something was.

    Null texts stay null; rows that repeat are masked alike; overlapping secrets become one mask. No rows give none.
    """
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 4096 tokens.

    A null text is empty, one token with its end; longer ones are cut into pieces, none is dropped; of equal lengths any may come first. No rows give none.
    """
    ship(spark)
    return packing.pack(packing.pieces(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: A fitted model and a tokenizer aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
