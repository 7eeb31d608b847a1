"""Feedback tickets from CSV files."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadsift.functions.dates import iso_timestamp
from roadsift.functions.keys import content_id
from roadsift.functions.numbers import whole_rating
from roadsift.functions.text import blank_to_null, missing_to_null, or_default, strip
from roadsift.sources.quoted_csv import read_quoted_csv

COLUMNS = ["body", "author", "rating", "created_at", "external_id"]
FEEDBACK_COLUMNS = ["source", "external_id", "author", "body", "rating", "created_at"]
ANONYMOUS = "anonymous"


def read_csv_text(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """The CSV columns as text, in file order given by ``ingest_order``.

    Only ``body`` is required. Quoted line breaks need ``multi_line``, which reads the files twice, by many tasks each.
    """
    if multi_line:
        raw = read_quoted_csv(spark, path)
        place = F.col("ingest_order")
    else:
        raw = spark.read.options(header=True, quote='"', escape='"', mode="PERMISSIVE", enforceSchema=False).csv(path)
        place = F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("ingest_order")
    if "body" not in raw.columns:
        raise ValueError(f"CSV must have a 'body' column; found: {[name for name in raw.columns if name != 'ingest_order']}")
    present = [F.col(f"`{name}`") if name in raw.columns else F.lit(None).cast("string").alias(name) for name in COLUMNS]
    return raw.select(*present, place)


def normalize_feedback(raw: DataFrame, source: str = "csv") -> DataFrame:
    """Text columns to the feedback schema: missing words to NULL, defaults, whole ratings, trimmed bodies.

    A row without an external id gets one from its content, which stays the same when the file is imported again.
    """
    text = {name: missing_to_null(F.col(name).cast("string")) for name in COLUMNS}
    extra = [name for name in raw.columns if name not in COLUMNS]
    body = strip(text["body"])
    own_id: Column = content_id(f"{source}-", text["author"], body, text["created_at"])
    return raw.select(
        F.lit(source).alias("source"),
        F.coalesce(blank_to_null(text["external_id"]), own_id).alias("external_id"),
        or_default(text["author"], ANONYMOUS).alias("author"),
        body.alias("body"),
        whole_rating(text["rating"]).alias("rating"),
        iso_timestamp(text["created_at"]).alias("created_at"),
        *extra,
    )


def read_feedback_csv(spark: SparkSession, path: str, source: str = "csv", multi_line: bool = True) -> DataFrame:
    return normalize_feedback(read_csv_text(spark, path, multi_line), source)
