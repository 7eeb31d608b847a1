"""Copies of the items and their logs in buckets by item id, so that the current state is read without shuffling a text.

A copy is made once per many imports and label runs: it shuffles the texts, one file per bucket. Whatever is stored later is
read from the tables themselves and joined on rows without texts, so a copy never has to be fresh. Copies are listed when
they are finished; one that broke off is not read, and an older one goes on being used.

The tables are files below the store's folder; every session declares them anew in its catalog, under names made from their
path, so no metastore is needed.
"""

import hashlib
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadsift.operators.state import current_items, current_items_of_buckets
from roadsift.sources.tables import TABLES, read_table, table_path

COPIES, FINISHED = "bucketed", "finished_buckets"
KEYS = {"items": "id", "label_events": "item_id", "corrections": "item_id"}
NUMBERS = {"items": "import_no", "label_events": "seq", "corrections": "seq"}
LOG = "version bigint, buckets int, last_import bigint, last_event bigint, last_fix bigint"


@dataclass(frozen=True)
class Copy:
    """A finished copy: its version and number of buckets, and the last import, label run and correction that it holds."""

    version: int
    buckets: int
    last_import: int
    last_event: int
    last_fix: int


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """Writes the rows in so many buckets by ``key``, a file each, as a table of the session's catalog."""
    name = _name(path)
    df.sparkSession.sql(f"DROP TABLE IF EXISTS `{name}`")
    df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", path).mode("overwrite").saveAsTable(name)


def read_bucketed(spark: SparkSession, path: str, schema: str, key: str, buckets: int) -> DataFrame:
    """The table written there, which its joins and aggregates by ``key`` know to be bucketed."""
    name = _name(path)
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{name}` ({schema}) USING parquet CLUSTERED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(f"`{name}`")


def _name(path: str) -> str:
    return f"roadsift_{hashlib.md5(path.encode()).hexdigest()}"


def write_copy(spark: SparkSession, directory: str, buckets: int | None = None) -> int:
    """Copies the store's items, label events and corrections into buckets; returns the version of the copy.

    As many buckets as shuffles have partitions, unless told otherwise; fewer would have Spark shuffle the texts all
    the same.
    """
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tables = {name: read_table(spark, directory, name) for name in KEYS}
    # What is stored while the copy is written is not part of it.
    lasts = {name: tables[name].agg(F.coalesce(F.max(number), F.lit(0))).first()[0] for name, number in NUMBERS.items()}
    previous = newest_copy(spark, directory)
    version = previous.version + 1 if previous else 1
    for name, key in KEYS.items():
        held = F.col(NUMBERS[name]) <= lasts[name]
        write_bucketed(tables[name].filter(held), f"{table_path(directory, COPIES)}/version={version}/{name}", key, buckets)
    entry = spark.createDataFrame([(version, buckets, *lasts.values())], LOG)
    entry.coalesce(1).write.mode("append").parquet(table_path(directory, FINISHED))
    return version


def newest_copy(spark: SparkSession, directory: str) -> Copy | None:
    """The newest finished copy, if there is one. The log has a row per copy."""
    try:
        rows = spark.read.schema(LOG).parquet(table_path(directory, FINISHED)).collect()
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return None
    return max((Copy(*row) for row in rows), key=lambda copy: copy.version, default=None)


def read_current(spark: SparkSession, directory: str) -> DataFrame:
    """Items with their current labels, corrections and themes: ``tables.read_current`` by way of the newest copy."""
    items = read_table(spark, directory, "items")
    events, corrections, assignments, runs = (read_table(spark, directory, name) for name in ("label_events", "corrections", "theme_assignments", "themes"))
    copy = newest_copy(spark, directory)
    if copy is None:
        return current_items(items.drop("import_no"), events, corrections, assignments, runs)
    base = {}
    for name, key in KEYS.items():
        schema = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in TABLES[name].fields)
        base[name] = read_bucketed(spark, f"{table_path(directory, COPIES)}/version={copy.version}/{name}", schema, key, copy.buckets)
    newer = events.filter(F.col("seq") > copy.last_event), corrections.filter(F.col("seq") > copy.last_fix)
    copied = current_items_of_buckets(base["items"].drop("import_no"), (base["label_events"], base["corrections"]), newer, assignments, runs)
    added = items.filter(F.col("import_no") > copy.last_import).drop("import_no")
    return copied.unionByName(current_items(added, *newer, assignments, runs))
