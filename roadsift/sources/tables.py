"""The engine's Parquet tables under one directory."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from roadsift import schemas
from roadsift.operators.state import current_items

TABLES = {
    "items": schemas.ITEMS,
    "label_events": schemas.LABEL_EVENTS,
    "retries": schemas.RETRIES,
    "corrections": schemas.CORRECTIONS,
    "themes": schemas.THEMES,
    "theme_assignments": schemas.ASSIGNMENTS,
    "opportunities": schemas.OPPORTUNITIES,
    "documents": schemas.DOCUMENTS,
    "feature_cache": schemas.FEATURE_CACHE,
}

# A theme run replaces the one before: partitions let readers skip all older runs. Imports are told apart so that
# the highest item id is found in the last of them, label runs so that the last one is found by its partition.
PARTITIONED_BY = {
    "items": ["import_no"],
    "label_events": ["seq"],
    "retries": ["seq"],
    "themes": ["run_id"],
    "theme_assignments": ["run_id"],
    "opportunities": ["run_id"],
    "documents": ["target_kind"],
}

SNAPSHOTS = "current_items"
FINISHED = "finished_snapshots"


def table_path(directory: str, name: str) -> str:
    return f"{directory.rstrip('/')}/{name}"


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table with its declared schema; empty before the first write."""
    schema: T.StructType = TABLES[name]
    try:
        return spark.read.schema(schema).parquet(table_path(directory, name)).select(*schema.fieldNames())
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def append(df: DataFrame, directory: str, name: str) -> None:
    """Appends rows in the table's column order; columns the rows lack are NULL."""
    schema: T.StructType = TABLES[name]
    columns = [
        (F.col(field.name) if field.name in df.columns else F.lit(None)).cast(field.dataType).alias(field.name)
        for field in schema.fields
    ]
    writer = df.select(*columns).write.mode("append")
    if name in PARTITIONED_BY:
        writer = writer.partitionBy(*PARTITIONED_BY[name])
    writer.parquet(table_path(directory, name))


def newest_run(table: DataFrame) -> DataFrame:
    """Rows of the highest run id, without it."""
    return table.filter(F.col("run_id") == table.agg(F.max("run_id")).scalar()).drop("run_id")


def read_current(spark: SparkSession, directory: str) -> DataFrame:
    """Items with their current labels, corrections and themes, worked out from the logs."""
    items = read_table(spark, directory, "items").drop("import_no")
    return current_items(
        items,
        *[read_table(spark, directory, name) for name in ("label_events", "corrections", "theme_assignments", "themes")],
    )


def write_snapshot(spark: SparkSession, directory: str) -> int:
    """Stores the current items as a table of its own and returns its number.

    Working out the state shuffles every text once. Reports that only need a few columns or rows of it should
    read a snapshot instead of joining the logs again.
    """
    number = _snapshots(spark, directory) + 1
    read_current(spark, directory).write.mode("overwrite").parquet(f"{table_path(directory, SNAPSHOTS)}/snapshot={number}")
    finished = spark.createDataFrame([(number,)], "snapshot bigint")
    finished.coalesce(1).write.mode("append").parquet(table_path(directory, FINISHED))
    return number


def _snapshots(spark: SparkSession, directory: str) -> int:
    """The number of the newest finished snapshot, 0 before the first."""
    try:
        stored = spark.read.parquet(table_path(directory, FINISHED))
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return 0
    return stored.agg(F.max("snapshot")).first()[0] or 0


def read_snapshot(spark: SparkSession, directory: str) -> DataFrame:
    """The newest finished snapshot; only its own files are listed."""
    newest = _snapshots(spark, directory)
    return spark.read.parquet(f"{table_path(directory, SNAPSHOTS)}/snapshot={newest}")


def register_views(spark: SparkSession, directory: str) -> None:
    """Temporary views ``feedback_items``, ``themes`` and ``opportunities`` for SQL users."""
    read_current(spark, directory).createOrReplaceTempView("feedback_items")
    newest_run(read_table(spark, directory, "themes")).createOrReplaceTempView("themes")
    newest_run(read_table(spark, directory, "opportunities")).createOrReplaceTempView("opportunities")
