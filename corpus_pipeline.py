"""A corpus from raw documents to packed training sequences, stage by stage.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and
returns a DataFrame, which is written and read again as the next one's docs. All but the
last return the columns of documents, whatever else they hold and however it is named.

Defined results, for all stages: an empty table gives an empty table; texts of any length are
read whole; the result depends on the rows and not on their order. What a stage does with nulls,
empty texts, ties and repeated rows stands at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import neardup, packing, pii, quality, spill, toxicity


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go.

    Null and very short texts have no evidence and stay, rows with a null id are judged like others,
    equal texts have one verdict. Without labels of both kinds all rows stay.
    """
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go.

    Null and empty texts stay, a null or unknown language is scored with the stems of all languages,
    equal texts of a language have one verdict. Without labels of both kinds the general words stand alone.
    """
    return toxicity.civil_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, that of the smallest id.

    Rows with a null id and texts without a word stay. Of rows with one id and one text one stays;
    rows that repeat an id with other texts are documents of their own.
    """
    return neardup.drop_near_duplicates(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by their kind; n_chars follows, and stays null where it is null.

    Every row stays; null and empty texts stay as they are.
    """
    return pii.redact_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids and pieces, packed into training sequences of packing.CAPACITY byte-level tokens.

    Rows with a null id or text are left out, an empty text is a piece of its end mark alone, rows
    that repeat an id are packed each. The result holds no other column of the documents.
    """
    return packing.pack(docs, packing.byte_tokens(docs["text"]))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("toxicity", toxicity_filter),
    ("simhash_near_dedup", near_duplicates),
    ("pii", redact_pii),
    ("best_fit_packing", pack_sequences),
]

#: The stages fit models, group by fingerprints and pack by a genetic search: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each one's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = spill.cut(stage(spark, docs, sf_dir), name)
    return docs
