"""One thin query for each operator, with production parameters over whole tables, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import conversation_repair, hard_negatives, mixing, warc
from .common import new_folder, ship_package, table
from .html_text import main_texts
from .language_id import identified
from .media import stored_media
from .packing import packed
from .quality_rules import judged
from .simhash import near_duplicates
from .substring_dedup import ORACLE_SQL as SUBSTRING_SQL, without_repeats
from .token_counts import token_counts
from .token_store import stored_digests


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return stored_digests(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), new_folder(spark, "store"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return packed(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return identified(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return warc.audited_pages(table(spark, sf_dir, "pages"), spoilt=F.expr(warc.SPOILT))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return main_texts(table(spark, sf_dir, "pages"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return stored_media(table(spark, sf_dir, "documents"), new_folder(spark, "media"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return conversation_repair.repair_report(table(spark, sf_dir, "conversations"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    kept = without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return hard_negatives.mined(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_token_store": op2_token_store,
    "op3_packing": op3_packing,
    "op4_quality_rules": op4_quality_rules,
    "op5_language_id": op5_language_id,
    "op6_simhash": op6_simhash,
    "op7_mixing": op7_mixing,
    "op8_warc": op8_warc,
    "op9_html_text": op9_html_text,
    "op10_media": op10_media,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op7_mixing": mixing.ORACLE_SQL,
    "op8_warc": warc.ORACLE_SQL,
    "op11_conversation_repair": conversation_repair.ORACLE_SQL,
    "op12_substring_dedup": SUBSTRING_SQL,
    "op13_hard_negatives": hard_negatives.ORACLE_SQL,
}
