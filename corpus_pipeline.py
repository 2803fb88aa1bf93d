"""A training-data pipeline: five operators in a row over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetwise.llm import decontam, mixing, pii, quality, simhash
from facetwise.llm.queries import pii_key
from facetwise.scratch import Scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Null and empty texts and texts without words stay; rows with equal texts are judged alike. No documents give none.
    """
    return quality.keep(docs, quality.train(docs, spark)[1], spark)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, a similarity of 0.8 or more): the one with the least doc_id.

    All texts without words, null ones among them, are one group; a null doc_id stays only if its group has no other;
    of several rows with the least doc_id the one with the least fingerprint stays, then the one with the least text. No
    documents give none.
    """
    return simhash.keep_one(docs, spark, simhash.SIMILAR)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule leaves, row by row.

    Null, empty and wordless texts stay; a benchmark without rows or words rejects nothing. No documents give none.
    """
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), spark)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data pseudonymised; n_chars, where there is such a column, follows the texts (not null ones).

    Null, empty and clean texts stay as they are, in all rows. No documents give none.
    """
    columns = docs.columns
    out = pii.pseudonymize(docs, key=pii_key(spark), found="pii_found" + "_" * sum(c.lower().startswith("pii_found") for c in columns))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(f"`{c}`") for c in columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Equal weight for every source at the same total size, with mix_copy counting a document's copies.

    Null and the empty source are one source; rows with equal doc_id draw alike. No documents give none.
    """
    return mixing.replicate(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("pii pseudonyms", pii_stage),
    ("mixing to target weights", mixing_stage),
]

#: The classifier, the fingerprints and the pseudonyms have no SQL form; tests compare the pipeline with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again by the next."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.cut(docs)
            scratch.drop(before)  # once the next table is there
    return docs
