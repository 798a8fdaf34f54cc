"""The dealt operators as queries over the whole given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat, decontaminate, fingerprints, language, licenses, line_dedup, lm, mixing, near_dedup, oracles, phrases, secrets, spelling,
               token_files)
from .common import shared_path, table, text_column

END_ID = 2


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path(), END_ID)
    return token_files.token_digests(token_files.read_token_files(spark, path))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], given.schema)
    return chat.chat_digests(chat.format_chats(given.unionByName(extra)))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.span_digests(secrets.secret_spans(table(spark, sf_dir, "documents")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_digests(fingerprints.fingerprints(table(spark, sf_dir, "documents")))


#: The mixture's weights, by level and name, in whole numbers; sources of a language weigh the same.
MIX_WEIGHTS = {"domain": {"web": 60, "curated": 40}, "lang": {"en": 50, "de": 20, "fr": 20, "es": 10}}


def mixture(docs: DataFrame) -> DataFrame:
    """Sources numbered below ten are web, all others curated."""
    domain = F.when(F.col("source").rlike("^src[0-9]$"), "web").otherwise("curated")
    return mixing.mix(docs, {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}, MIX_WEIGHTS)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixture(docs).select("doc_id", "epoch", "domain", "lang", "source", mixing.token_count(text_column()).alias("n_tokens"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.length("text").cast("bigint").alias("n_chars"),
                          F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hit_digests(decontaminate.decontaminate(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents")).drop("found")


QUERIES = {f.__name__: f for f in (
    op1_near_dedup, op2_token_files, op3_lm_scores, op4_chat_formatting, op5_secret_scan, op6_language_id, op7_fingerprints,
    op8_mixing, op9_line_dedup, op10_decontamination, op11_spelling_variants, op12_phrases, op13_license_scan)}
ORACLES: dict[str, str] = {
    "op1_near_dedup": oracles.NEAR_DEDUP, "op4_chat_formatting": oracles.CHAT, "op8_mixing": oracles.MIXING,
    "op9_line_dedup": oracles.LINES, "op10_decontamination": oracles.DECONTAMINATION,
    "op11_spelling_variants": oracles.VARIANTS, "op12_phrases": oracles.PHRASES, "op13_license_scan": oracles.licenses_sql()}
