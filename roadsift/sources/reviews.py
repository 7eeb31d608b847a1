"""Raw store reviews, landed as JSON or Parquet by whatever fetched them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadsift.functions.dates import iso_timestamp
from roadsift.functions.numbers import whole_rating
from roadsift.functions.text import or_default, strip
from roadsift.sources.feedback_csv import ANONYMOUS


def normalize_reviews(raw: DataFrame, source: str = "play_store") -> DataFrame:
    """(reviewId, userName, content, score, at, …) to the feedback schema; further columns are kept."""
    known = ["reviewId", "userName", "content", "score", "at"]
    return raw.select(
        F.lit(source).alias("source"),
        F.col("reviewId").cast("string").alias("external_id"),
        or_default(F.col("userName"), ANONYMOUS).alias("author"),
        strip(F.coalesce(F.col("content"), F.lit(""))).alias("body"),
        whole_rating(F.col("score")).alias("rating"),
        iso_timestamp(F.col("at")).alias("created_at"),
        *[name for name in raw.columns if name not in known],
    )
