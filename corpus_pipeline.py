"""A training corpus from raw documents: quality rules, near-dedup, pseudonyms, mixing, tokens.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again as the docs of the next. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.bpe import encode_digests
from pointloom.llm.common import Scratch
from pointloom.llm.mixing import mix
from pointloom.llm.near_copies import drop_near_copies as drop_copies
from pointloom.llm.pii import pseudonymise_documents, session_key
from pointloom.llm.quality_rules import quality_rules


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with their own columns, whatever these are called.

    Null and empty texts have no words and go; repeated rows are judged alike, rows with a null doc_id like others; an empty table gives an empty one.
    """
    judged = quality_rules(docs.select(F.col("doc_id"), F.col("text"), F.struct("*").alias("_d")), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.where("kept").select("_d.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-copies (5-word shingles, Jaccard similarity 0.8 or more), that of least doc_id (a null one last, of repeated rows the first).

    Null and empty texts are copies of each other; an empty table gives an empty one.
    """
    return drop_copies(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pseudonyms for personal data in ``text``; n_chars, if there, follows the new text. All other columns, also those called n_<kind>, are kept.

    Null texts stay null with their n_chars, empty ones empty; repeated rows stay equal; an empty table gives an empty one.
    """
    made = pseudonymise_documents(docs.select("text", F.struct("*").alias("_d")), session_key(spark))
    out = made.select(*[F.col("text") if c == "text" else F.col(f"_d.`{c}`") for c in docs.columns])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares; documents repeat or go as the mix wants, with their own columns.

    Null and empty texts have no words and go; a null source is a source; repeated rows are mixed one by one; an empty table gives an empty one.
    """
    return mix(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes, a row for each row; null texts count as empty."""
    return encode_digests(docs)


STAGES = [
    ("quality_rules", keep_good),
    ("simhash_dedup", drop_near_copies),
    ("pseudonyms", hide_personal_data),
    ("mixing", mix_sources),
    ("byte_bpe", tokenise),
]

#: The fingerprints, pseudonyms and tokens have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.table(docs)
    return docs
