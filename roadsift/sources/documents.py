"""Generated documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadsift.sources.tables import append, read_table


def write_docs(documents: DataFrame, directory: str) -> None:
    """Appends (target_kind, target_id, markdown) rows, stamped with the time of writing."""
    stamped = documents
    if "updated_at" not in documents.columns:
        stamped = documents.withColumn("updated_at", F.current_timestamp())
    append(stamped, directory, "documents")


def latest_docs(documents: DataFrame) -> DataFrame:
    """The newest version of every document."""
    newest = documents.groupBy("target_kind", "target_id").agg(
        F.max_by(F.struct("markdown", "updated_at"), "updated_at").alias("_doc")
    )
    return newest.select("target_kind", "target_id", F.col("_doc")["markdown"].alias("markdown"), F.col("_doc")["updated_at"].alias("updated_at"))


def read_docs(spark: SparkSession, directory: str, kind: str | None = None) -> DataFrame:
    documents = read_table(spark, directory, "documents")
    return latest_docs(documents if kind is None else documents.filter(F.col("target_kind") == kind))


def write_text(documents: DataFrame, path: str) -> None:
    """One text file per kind and target, for theme-sized sets of documents; ``write_docs`` takes any number."""
    lines = documents.select("target_kind", F.col("target_id").cast("string").alias("target_id"), F.col("markdown").alias("value"))
    lines.write.mode("overwrite").partitionBy("target_kind", "target_id").text(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(target_kind, target_id, markdown) out of what ``write_text`` wrote, less the line end it adds."""
    raw = spark.read.text(path, wholetext=True)
    markdown = F.expr("substring(value, 1, length(value) - 1)")
    return raw.select("target_kind", F.col("target_id").try_cast("bigint").alias("target_id"), markdown.alias("markdown"))


def with_documents(opportunities: DataFrame, documents: DataFrame) -> DataFrame:
    """Opportunities with the newest document about their theme, if there is one."""
    about = latest_docs(documents.filter(F.col("target_kind") == "theme")).select(
        F.col("target_id").alias("theme_id"), F.col("markdown").alias("draft_prd"), "updated_at"
    )
    return opportunities.join(about, "theme_id", "left")
