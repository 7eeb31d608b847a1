"""Daily counts per theme, kept up to date by signed deltas and read by the drift table.

A change to the items (a micro-batch of a stream, an import, a theme run) adds one small table of signed counts by day and
theme; the counts are the sums over all of them. Nothing is kept in a stream's state and no day is written again when
another changes. LEVEL tables of one level are added up into one of the next, so the number of tables grows with the
logarithm of the changes.

Event time: the log of the tables knows the newest day counted so far. A row whose day lies more than DELAY days before it is
late; it counts like any other, and is also listed as late. Each change has a name and counts once, so a replayed batch
or a run that is started again changes nothing; a table counts from when it is listed, which is last.
"""

import uuid
from collections import defaultdict
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from roadsift.functions.dates import iso_date

COUNTS = "day date, theme_id bigint, items bigint, late bigint"
LOG = "part string, level int, changes array<string>, newest date"
LEVEL = 8
#: Days after which an item is late.
DELAY = 7


@dataclass(frozen=True)
class Part:
    """A listed table: its name, level, the changes whose counts it holds, and their newest day."""

    name: str
    level: int
    changes: frozenset[str]
    newest: date | None


def live_parts(spark: SparkSession, out: str) -> list[Part]:
    """The listed tables that no sum of several replaces. The log has a row per change and sum."""
    try:
        rows = spark.read.schema(LOG).parquet(f"{out}/parts").collect()
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return []
    held: set[str] = set()
    live = []
    for row in sorted(rows, key=lambda row: (-row["level"], row["part"])):
        if not held.issuperset(row["changes"]):
            live.append(Part(row["part"], row["level"], frozenset(row["changes"]), row["newest"]))
            held.update(row["changes"])
    return live


def _summed(counts: DataFrame) -> DataFrame:
    """Signed counts, one row per day and theme; rows that cancel out are gone."""
    sums = counts.groupBy("day", "theme_id").agg(F.sum("items").alias("items"), F.sum("late").alias("late"))
    return sums.filter("items <> 0 OR late <> 0")


def _read(spark: SparkSession, out: str, parts: list[Part]) -> DataFrame:
    paths = [f"{out}/counts/{part.name}" for part in parts]
    return spark.read.schema(COUNTS).parquet(*paths) if paths else spark.createDataFrame([], COUNTS)


def _list(spark: SparkSession, out: str, counts: DataFrame, level: int, changes: frozenset[str], newest: date | None) -> None:
    name = uuid.uuid4().hex
    counts.write.parquet(f"{out}/counts/{name}")
    newest = max(filter(None, [newest, spark.read.schema(COUNTS).parquet(f"{out}/counts/{name}").agg(F.max("day")).first()[0]]), default=None)
    spark.createDataFrame([(name, level, sorted(changes), newest)], LOG).coalesce(1).write.mode("append").parquet(f"{out}/parts")


def add_change(spark: SparkSession, out: str, change: str, rows: DataFrame, delay: int = DELAY) -> bool:
    """Adds up rows (created_at, theme_id, and ``sign`` if it is not 1) under the name of their change; False if it is there
    already. Full levels are added up."""
    parts = live_parts(spark, out)
    if any(change in part.changes for part in parts):
        return False
    newest = max((part.newest for part in parts if part.newest), default=None)
    sign = rows["sign"].cast("long") if "sign" in rows.columns else F.lit(1).cast("long")
    day = iso_date(rows["created_at"])
    late = F.lit(False) if newest is None else F.coalesce(day < F.lit(newest - timedelta(days=delay)), F.lit(False))
    counted = rows.select(day.alias("day"), rows["theme_id"].cast("bigint").alias("theme_id"), sign.alias("items"), F.when(late & (sign > 0), sign).otherwise(0).alias("late"))
    _list(spark, out, _summed(counted), 0, frozenset([change]), newest)
    while True:
        levels = defaultdict(list)
        for part in live_parts(spark, out):
            levels[part.level].append(part)
        full = next((members for _, members in sorted(levels.items()) if len(members) >= LEVEL), None)
        if full is None:
            return True
        days = [part.newest for part in full if part.newest]
        _list(spark, out, _summed(_read(spark, out, full)), full[0].level + 1, frozenset().union(*(part.changes for part in full)), max(days, default=None))


def start_daily_counts(stream: DataFrame, out: str, checkpoint: str, name: str = "stream", delay: int = DELAY) -> StreamingQuery:
    """Adds each micro-batch of (created_at, theme_id) rows as a change of its own; ``name`` tells streams into one
    folder apart."""

    def count(batch: DataFrame, batch_id: int) -> None:
        add_change(batch.sparkSession, out, f"{name}-{batch_id}", batch, delay)

    writer = stream.writeStream.foreachBatch(count)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_daily_counts(spark: SparkSession, out: str) -> DataFrame:
    """day, theme_id and items; days and themes without items are gone."""
    return _summed(_read(spark, out, live_parts(spark, out))).filter("items <> 0").select("day", "theme_id", "items")


def read_late_counts(spark: SparkSession, out: str) -> DataFrame:
    """day, theme_id and late: how many of the items that were ever counted there came late."""
    return _summed(_read(spark, out, live_parts(spark, out))).filter("late <> 0").select("day", "theme_id", "late")


def theme_changes(items: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """created_at, theme_id and sign for items (id, created_at) whose theme differs between two sets of (item_id, theme_id).

    An item leaves its old theme (NULL for none) and enters its new one. Only ids, themes and times are shuffled.
    """
    old, new = before.select("item_id", F.col("theme_id").alias("old")), after.select("item_id", F.col("theme_id").alias("new"))
    moved = old.join(new, "item_id", "full").filter(~F.col("old").eqNullSafe(F.col("new")))
    steps = F.explode(F.array(_step("old", -1), _step("new", 1))).alias("step")
    return items.select(F.col("id").alias("item_id"), "created_at").join(moved, "item_id").select("created_at", steps).select("created_at", "step.theme_id", "step.sign")


def _step(theme: str, sign: int) -> Column:
    return F.struct(F.col(theme).cast("bigint").alias("theme_id"), F.lit(sign).cast("bigint").alias("sign"))
