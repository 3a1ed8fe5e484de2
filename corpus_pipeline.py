"""Corpus pipeline: five stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relinfer.llm.chosen_path import drop_near_duplicates
from relinfer.llm.common import table
from relinfer.llm.contamination import contamination
from relinfer.llm.language import UNKNOWN, held_out, identify, train
from relinfer.llm.line_dedup import dedup_lines
from relinfer.llm.pieces import encode
from relinfer.session import drop_table, new_table_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keeping(docs: DataFrame, added: str, operate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `operate` leaves of docs, with the columns of docs as they were.

    Columns of docs that are named like the ones that the operator adds stand aside meanwhile.
    """
    aside = {c: f"_aside_{c}" for c in docs.columns if c in added.split()}
    left = operate(docs.withColumnsRenamed(aside))
    return left.select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language: null texts and texts without a letter go.

    Without any labelled document there is nothing to tell languages by, and none is left. Null languages are
    not learned from. Repeated rows are judged alike; null ids are never held out.
    """
    classifier = train(docs.where(~held_out("doc_id")))
    return keeping(
        docs, "lang_pred score", lambda d: identify(d, classifier).where(F.col("lang_pred") != UNKNOWN)
    )


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of repeated three-line windows; those emptied by it go.

    Null texts stay null. Rows equal in id and text count as one document and get one result; null ids come first.
    """

    def operate(d: DataFrame) -> DataFrame:
        left = dedup_lines(d).where((F.col("n_removed") == 0) | (F.trim("text") != ""))
        return left.withColumn("n_chars", F.length("text").cast("long"))

    return keeping(docs, "n_lines n_removed", operate)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the least id.

    Null ids come last, and of equal ids the smaller text hash first; rows equal in both stay or go together. Texts
    without a word, null ones included, are a class of their own each.
    """
    return drop_near_duplicates(docs).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark; null and empty texts never are."""
    bench = table(spark, sf_dir, "benchmark")
    added = "n_words n_hit n_items items_sha256 contaminated longest longest_at"
    return keeping(docs, added, lambda d: contamination(d, bench).where("NOT contaminated"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of the documents left."""
    return encode(docs, drop=("text",)).select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids")


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

# SQL can't express the first and the last stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents.

    What a stage leaves is written to the shared folder; a table is deleted when the next
    one is written. The last stage's input stays, since its result is read when it is used.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_table_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop_table(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
