"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm import language_id, line_dedup, near_text, packing, pii, simhash
from memspark.llm.rows import written

#: Stages work on rows in memory and on model votes; SQL cannot express them.
ORACLE_SQL = None


def _wrapped(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns as one struct, so that their names meet no operator's."""
    return docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")]).alias("__rest"))


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the character models accept as one of the languages they learned from this table's labels.

    A null text, or one without a letter, is no language and goes.
    """
    fold = language_id.fold("doc_id")
    identifier = language_id.train(docs.filter(F.col("lang").isNotNull() & (fold != 2)), "text", "lang", fold == 3)
    return docs.filter(language_id.acceptance(identifier, F.col("text"), spark))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten of them or more share."""
    made = line_dedup.line_dedup(_wrapped(docs), keep=("__rest",)).select("doc_id", F.col("kept_text").alias("text"), "__rest.*")
    return made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: texts whose five-word shingles are 0.8 alike or more."""
    return simhash.one_of_each(docs, groups=near_text.near_texts(docs, words=5, similarity=0.8))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their personal data replaced by its kind."""
    made = pii.mask_pii(docs)
    return made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, packed into sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_languages),
    ("line_dedup", drop_shared_lines),
    ("near_dedup", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
