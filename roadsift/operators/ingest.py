"""Filtering and deduplicating incoming feedback."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadsift.functions.text import strip
from roadsift.operators.key_filter import KEY
from roadsift.operators.small import is_small
from roadsift.schemas import MIN_BODY_CHARS
from roadsift.session import written

BROADCAST_KEYS = 200_000  # keys of one batch sent to every task, some 20 MB


def filter_usable(df: DataFrame, min_chars: int = MIN_BODY_CHARS) -> DataFrame:
    """Drops items whose trimmed body is shorter than that; missing bodies go too."""
    return df.filter(F.length(strip(F.col("body"))) >= min_chars)


def first_per_key(incoming: DataFrame, order: Sequence[Column]) -> DataFrame:
    """First row of every non-NULL (source, external_id).

    The rank limit is applied before the shuffle as well, so a key with very many copies sends one row per task.
    """
    in_key = Window.partitionBy(*KEY).orderBy(*order)
    return incoming.withColumn("_nth", F.row_number().over(in_key)).filter("_nth = 1").drop("_nth")


def dedup_new(incoming: DataFrame, stored: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Rows of the batch that are to be stored: key not stored yet, and first of its key within the batch.

    Rows without a key never collide, and rows without a source or a body cannot be stored. Keyless rows skip
    both steps: hashed on their key they would all meet in one task.
    """
    storable = incoming.filter(F.col("source").isNotNull() & F.col("body").isNotNull())
    keyed = first_per_key(storable.filter(F.col("external_id").isNotNull()), order)
    fresh = keyed.join(stored.select(*KEY), KEY, "left_anti")
    return fresh.unionByName(storable.filter(F.col("external_id").isNull()))


def stored_hits(stored: DataFrame, incoming: DataFrame, incoming_rows: int, limit: int = BROADCAST_KEYS) -> DataFrame:
    """The stored keys that a batch can meet at all.

    A small batch against a huge table: its keys are broadcast and the stored keys are only scanned, not
    shuffled. ``incoming_rows`` is the measured size of the batch; above the limit the table is used whole.
    """
    keys = stored.select(*KEY)
    if incoming_rows > limit:
        return keys
    return keys.join(F.broadcast(incoming.select(*KEY).distinct()), KEY, "left_semi")


def arrivals(batch: DataFrame, known: DataFrame | None) -> DataFrame:
    """place, file and row of the rows of a written batch that are to be stored: ``dedup_new`` without the texts.

    ``batch`` is a table read back from files, with the order of its rows in the column ``place``. Of the copies of a key
    the first by place, then by file and row, counts. ``known`` holds the stored keys the batch can meet.
    """
    here = [F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")]
    narrow = batch.filter(F.col("source").isNotNull() & F.col("body").isNotNull()).select(*KEY, "place", *here)
    copies = narrow.filter(F.col("external_id").isNotNull()).groupBy(*KEY)
    first = copies.agg(F.min(F.struct("place", "file", "row")).alias("first"))
    fresh = first if known is None else first.join(known.select(*KEY), KEY, "left_anti")
    return fresh.select("first.*").unionByName(narrow.filter(F.col("external_id").isNull()).select("place", "file", "row"))


def with_item_ids(chosen: DataFrame, start: int, ordered: bool = True) -> DataFrame:
    """file, row and ``id`` per chosen row: ids from ``start`` on without gaps, rising by place if ``ordered``.

    Only these narrow rows are sorted, by ranges, and written; an id is then the start, the rows of the files before its own,
    and the place within the file. So ids stay below 2^63 for any number of tasks. To be used by one importer at a
    time.
    """
    laid_out = chosen.repartitionByRange("place").sortWithinPartitions("place", "file", "row") if ordered else chosen
    stored = written(laid_out.select("file", "row"))
    own = stored.select("file", "row", F.col("_metadata.file_name").alias("part"), F.col("_metadata.row_index").alias("at"))
    number = [F.regexp_extract("part", pattern, 1).cast("int") for pattern in (r"^part-(\d+)", r"-c(\d+)[^-]*$")]
    before = Window.orderBy(*number).rowsBetween(Window.unboundedPreceding, -1)
    sizes = own.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row per file
    firsts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return own.join(F.broadcast(firsts), "part").select("file", "row", (F.lit(start).cast("long") + F.col("first") + F.col("at")).alias("id"))


def numbered_rows(batch: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of a written batch that have an id, with it. The bodies are not sorted, and only shuffled if ids are many."""
    rows = batch.drop("place").select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    return rows.join(F.broadcast(ids) if is_small(ids) else ids.hint("shuffle_hash"), ["file", "row"]).drop("file", "row")


def next_import(items: DataFrame) -> tuple[int, int]:
    """Number and first item id of the next import. Ids rise, so only the last import's are read."""
    last = items.agg(F.max("import_no")).first()[0]
    if last is None:
        return 1, 0
    return last + 1, items.filter(F.col("import_no") == last).agg(F.max("id")).first()[0] + 1


def ingest_counts(incoming: DataFrame, usable: DataFrame, inserted: DataFrame) -> DataFrame:
    """One row with the sizes of the three stages of an import."""
    sizes = [
        frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(stage).alias("stage"), "n")
        for stage, frame in (("incoming", incoming), ("usable", usable), ("inserted", inserted))
    ]
    rows = sizes[0].union(sizes[1]).union(sizes[2])
    return rows.agg(
        *[F.max(F.when(F.col("stage") == stage, F.col("n"))).alias(stage) for stage in ("incoming", "usable", "inserted")]
    )
