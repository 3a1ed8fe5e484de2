"""Queries of the numbered operators over the supplied tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relinfer.llm.chosen_path import near_duplicates
from relinfer.llm.common import table
from relinfer.llm.contamination import CONTAMINATION_SQL, contamination
from relinfer.llm.ctw import score_texts
from relinfer.llm.digest import compare_with_next
from relinfer.llm.language import held_out, identify, train
from relinfer.llm.licenses import scan_licenses
from relinfer.llm.lexical_search import LEXICAL_SEARCH_SQL, search
from relinfer.llm.line_dedup import LINE_DEDUP_SQL, dedup_lines
from relinfer.llm.packing import pack, tokenize
from relinfer.llm.pieces import decode, encode
from relinfer.llm.pii import find_pii
from relinfer.llm.secrets import scan_secrets
from relinfer.llm.vector_codes import VECTOR_CODES_SQL, compress

Query = Callable[[SparkSession, str], DataFrame]


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), drop=("text",))


def op2_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near duplicates and its number of links."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's piece ids, decoded again; round_trip tells whether the text came back."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(text, 256).alias("sha"))
    coded = decode(encode(docs, drop=("text",)), out_col="decoded_sha256", digest=True)
    return coded.select(
        "doc_id", "n_tokens", "ids", "decoded_sha256", (F.col("decoded_sha256") == F.col("sha")).alias("round_trip")
    )


def op4_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's digest next to those of its edited text and of the next document."""
    return compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability by words and by a weighted context tree."""
    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), drop=("text",))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices of every document."""
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.drop("text", "licenses")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the labels of three quarters of the ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out("doc_id").alias("held_out"))
    classifier = train(docs.where("NOT held_out").drop("held_out"))
    return identify(docs.drop("lang"), classifier, drop=("text",))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of every document stand in the benchmark, and whether it is contaminated."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"), drop=("text",))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "longest_at"
    )


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, with weak parts where complementary ones stand near."""
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the later occurrences of repeated three-line windows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "text", "n_lines", "n_removed")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's code, its error and that of its label."""
    return compress(table(spark, sf_dir, "embeddings"))[0]


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of at most 2048."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(tokenize(docs, drop=("text",)), digest=True).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_pii": op1_pii,
    "op2_chosen_path": op2_chosen_path,
    "op3_pieces": op3_pieces,
    "op4_digest": op4_digest,
    "op5_ctw": op5_ctw,
    "op6_licenses": op6_licenses,
    "op7_language": op7_language,
    "op8_decontamination": op8_decontamination,
    "op9_secrets": op9_secrets,
    "op10_line_dedup": op10_line_dedup,
    "op11_vector_codes": op11_vector_codes,
    "op12_packing": op12_packing,
    "op13_lexical_search": op13_lexical_search,
}

SQL: dict[str, str] = {
    "op8_decontamination": CONTAMINATION_SQL,
    "op10_line_dedup": LINE_DEDUP_SQL,
    "op11_vector_codes": VECTOR_CODES_SQL,
    "op13_lexical_search": LEXICAL_SEARCH_SQL,
}
