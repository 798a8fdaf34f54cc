"""From raw documents to token files: language, near duplicates, benchmark passages, mixture, encoding.

Every stage takes (spark, docs, sf_dir) and all that its predecessor kept; what it returns is written as Parquet and read again
as the next one's input. All stages but the last return the columns of `documents`; the last returns digests of the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm import catalog, decontaminate, language, near_dedup, token_files
from gridspark.llm.common import shared_path, table, text_column, written

#: Documents are near duplicates if they share so many of 100 of all their shingles; op1_near_dedup has its own 85.
NEAR_PER_CENT = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts and texts without letters go, all others stay. A null lang becomes the predicted one, also of a close call.

    Rows are judged one by one, so null ids and repeated rows stay as they are. Without any labelled row texts with letters
    stay and null languages stay null. An empty table gives no rows.
    """
    return language.recognised(docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.80 or more stays, the one of the smallest id; of repeated rows one stays.

    A null id comes before all others; ties of one id go to the smallest hash of the text. Null and empty texts are in no group:
    one row of each id stays. An empty table gives no rows.
    """
    found = near_dedup.near_duplicates(docs, per_cent=NEAR_PER_CENT).where("kept")
    keys = (found.groupBy(F.col("doc_id").alias("__id"), F.coalesce("root", "h").alias("__group"))
            .agg(F.min("h").alias("__key")).select("__id", "__key").distinct())
    rows = docs.withColumn("__h", F.xxhash64(text_column())).dropDuplicates(["doc_id", "__h"])
    kept = rows.join(keys, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__key")), "left_semi")
    return kept.select(*docs.columns)


def remove_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item stay: those that the operator does not call contaminated.

    An item of fewer than ten words is one window, so an item of one word removes every document with that word. Null texts
    and items have no words. Rows are judged one by one: null ids and repeated rows stay or go by their text. An empty table gives no rows.
    """
    # The row travels as one column, so that no added column replaces one of its own.
    rows = docs.select("doc_id", "text", F.struct("*").alias("__row"))
    found = decontaminate.decontaminate(rows, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("spans") == 0).select("__row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The chosen mixture; a document stands once for each epoch it is in.

    Null languages and sources are nodes named `none`. Rows of one source and id, null ids among them, stay or go together.
    Null and empty texts count no tokens. An empty table gives no rows.
    """
    return catalog.mixture(docs.select("doc_id", "text", "lang", "source", F.struct("*").alias("__row"))).select("__row.*")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents; their digests, read back.

    Null ids come first; rows of one id, repeated rows among them, follow each other in the order of their text's hash. A null text is
    empty and has the end id alone. An empty table gives no rows.
    """
    path = shared_path(spark, "tokens")
    token_files.write_token_files(docs, path, catalog.tokenizer_path(), catalog.END_ID)
    return token_files.token_digests(token_files.read_token_files(spark, path))


STAGES = [("language_id", identify_language), ("near_dedup", remove_near_duplicates), ("decontamination", remove_benchmark_passages),
          ("mixing", mix_sources), ("token_files", write_tokens)]

#: SQL cannot fit the classifier or run the tokenizer; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
