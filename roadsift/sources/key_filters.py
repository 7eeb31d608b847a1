"""Key filters kept beside the items: one per import, merged in levels as imports come.

A filter counts once it is published, which happens after its import's items are stored; a filter whose run broke off is
never read. Imports without a published filter are simply read, so a store from before, or one whose run broke off
between items and filter, gives the same results.

When LEVEL filters of one level are there, their imports' keys are read once more and make a filter of the next level.
So there are at most LEVEL filters of each level, a key is read again once per level, and the number of levels is the
logarithm of the number of imports.
"""

import uuid
from collections import defaultdict
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadsift.operators.ingest import stored_hits
from roadsift.operators.key_filter import KEY, blocks_for, filter_blocks, possible_hits
from roadsift.session import written
from roadsift.sources.tables import read_table, table_path

FILTERS, PUBLISHED = "key_filters", "published_key_filters"
LOG = "filter string, level int, imports array<bigint>, blocks bigint"
LEVEL = 8


@dataclass(frozen=True)
class KeyFilter:
    """A published filter: its name, level, the imports whose keys it holds, and its number of blocks."""

    name: str
    level: int
    imports: frozenset[int]
    blocks: int


def live_filters(spark: SparkSession, directory: str) -> list[KeyFilter]:
    """The published filters that no merged one replaces. The log has a row per import and merge."""
    try:
        rows = spark.read.schema(LOG).parquet(table_path(directory, PUBLISHED)).collect()
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return []
    covered: set[int] = set()
    live = []
    for row in sorted(rows, key=lambda row: (-row["level"], row["filter"])):
        if not covered.issuperset(row["imports"]):
            live.append(KeyFilter(row["filter"], row["level"], frozenset(row["imports"]), row["blocks"]))
            covered.update(row["imports"])
    return live


def _keys_of(spark: SparkSession, directory: str, imports: frozenset[int]) -> DataFrame:
    """The stored keys of some imports; only their partitions are read."""
    items = read_table(spark, directory, "items")
    return items.filter(F.col("import_no").isin(sorted(imports)) & F.col("external_id").isNotNull()).select(*KEY)


def _publish(spark: SparkSession, directory: str, imports: frozenset[int], level: int) -> None:
    keys = _keys_of(spark, directory, imports)
    blocks = blocks_for(keys.count())
    name = uuid.uuid4().hex
    filter_blocks(keys, blocks).write.parquet(f"{table_path(directory, FILTERS)}/filter={name}")
    entry = spark.createDataFrame([(name, level, sorted(imports), blocks)], LOG)
    entry.coalesce(1).write.mode("append").parquet(table_path(directory, PUBLISHED))


def extend(spark: SparkSession, directory: str, import_no: int) -> None:
    """Publishes the filter of a stored import, and merges the filters of levels that are full."""
    _publish(spark, directory, frozenset([import_no]), 0)
    while True:
        levels = defaultdict(list)
        for each in live_filters(spark, directory):
            levels[each.level].append(each)
        full = next((level for level, members in sorted(levels.items()) if len(members) >= LEVEL), None)
        if full is None:
            return
        _publish(spark, directory, frozenset().union(*(each.imports for each in levels[full])), full + 1)


def known_keys(spark: SparkSession, directory: str, keys: DataFrame) -> DataFrame | None:
    """Those stored keys that the distinct ``keys`` of a batch can meet; None if no stored key needs to be read.

    ``keys`` is read several times. Stored keys are read of those imports only for which a filter, if there is one, lets
    a key of the batch pass.
    """
    items = read_table(spark, directory, "items")
    stored = {row["import_no"] for row in items.select("import_no").distinct().collect()}  # of partitions, not of rows
    live = [each for each in live_filters(spark, directory) if each.imports & stored]
    bare = stored.difference(*(each.imports for each in live))
    suspects = None
    imports = set(bare)
    if live:
        base = table_path(directory, FILTERS)
        filters = spark.read.option("basePath", base).parquet(*(f"{base}/filter={each.name}" for each in live))
        suspects = written(possible_hits(keys, filters, [(each.name, each.blocks) for each in live]))
        met = {row["filter"] for row in suspects.select("filter").distinct().collect()}  # a row per filter
        imports.update(*(each.imports & stored for each in live if each.name in met))
    if not imports:
        return None
    asked = keys if bare else suspects.select(*KEY).distinct()
    return stored_hits(_keys_of(spark, directory, frozenset(imports)), asked, asked.count())
