"""Cleans, mixes and encodes a corpus in stages; each reads, as Parquet, what the one before it kept."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadsift.llm import bpe, exact_dedup, language, mixing, simhash
from roadsift.session import written

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def recognised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go.

    That includes null texts and texts without a letter. Each row is judged by its own text, so repeated rows share their
    fate, and null ids, sources and languages do not matter. Without a labelled row, as in an empty table, nothing is
    learned and nothing recognised.
    """
    return language.recognised(docs.select(COLUMNS))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, the one with the smallest id.

    Texts are equal up to A-Z; a null text equals an empty one, however long texts are compared whole. A row without an id
    yields to one with. Of rows that share id and text, the first by its JSON form stays. An empty table stays empty.
    """
    return exact_dedup.deduplicated(docs.select(COLUMNS))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    Near copies are joined by fingerprints over three-word shingles that differ in two bits or fewer. Texts without words,
    null ones among them, are one group. A row without an id yields to one with, then the smaller hash of the text
    decides; of rows that share id and text, the first by its JSON form stays. An empty table stays empty.
    """
    return simhash.thinned(docs.select(COLUMNS), radius=simhash.RADIUS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them.

    Null is a source like any other. Null, empty and wordless texts have size 0 and are taken as their source's certain copies
    say. Rows with equal id and source are ranked by the same draw and taken or left together. An empty table stays empty.
    """
    return mixing.mixed(docs.select(COLUMNS))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the texts.

    One row per row, repeated rows included; a null or empty text has no ids, a long one is encoded whole, and the other
    columns, null or not, stay as they are. An empty table stays empty.
    """
    path = public_tokenizers.path(VOCABULARY)
    return bpe.encoded(docs.select(COLUMNS), path).withColumn("n_tokens", (F.length("token_ids") / 4).cast("long"))


STAGES = [
    ("language ID", recognised),
    ("exact dedup", exact),
    ("near-dedup", near),
    ("source mixing", mixed),
    ("byte-level BPE", encoded),
]
#: None: SQL cannot express the learned language model or the fingerprints' components.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = written(docs)
    return docs
