"""Top-n per group, top-n overall and repeatable samples."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadsift.operators.small import hinted

SALTS = 32


def top_per_group(
    df: DataFrame, group: str, order: Sequence[Column], n: int, rank: str = "rank", salts: int = SALTS
) -> DataFrame:
    """First ``n`` rows of every group with their rank 1..n.

    A group may hold most of the table, so it is first cut to ``n`` rows per salt, in parallel, and only those
    survivors meet in one task. The salt is the input task, so each of these sends at most ``n`` rows per group.
    The order must be total. Callers pass narrow rows and fetch wide columns afterwards (``attach``).
    """
    salted = df.withColumn("_salt", F.spark_partition_id() % salts)
    within_salt = Window.partitionBy(group, "_salt").orderBy(*order)
    survivors = salted.withColumn(rank, F.row_number().over(within_salt)).filter(F.col(rank) <= n)
    within_group = Window.partitionBy(group).orderBy(*order)
    return survivors.drop("_salt").withColumn(rank, F.row_number().over(within_group)).filter(F.col(rank) <= n)


def attach(
    picked: DataFrame, items: DataFrame, columns: Sequence[str], groups: DataFrame | bool | None, n: int, key: str = "id"
) -> DataFrame:
    """Adds wide columns to the picked rows, at most ``n`` for each of the groups, so that no sort carries texts.

    With a checked number of groups the items are scanned once and not shuffled.
    """
    return items.select(key, *columns).join(hinted(picked, groups, n), key)


def first_rows(items: DataFrame, n: int, *order: Column) -> DataFrame:
    """First ``n`` rows; a heap per task and a merge, never a full sort."""
    return items.orderBy(*order).limit(n)


def seeded_sample(items: DataFrame, n: int, seed: int = 42, key: str = "id") -> DataFrame:
    """``n`` rows in an order that is random but repeatable on any engine and partitioning."""
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return items.orderBy(draw, F.col(key)).limit(n)
