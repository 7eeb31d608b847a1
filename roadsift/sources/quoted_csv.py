"""CSV with quoted line breaks, read by many tasks per file.

Whether a line begins inside quotes depends on all quotes before it, but only on their number being odd. So the lines of each
split are read once for the parity of their quotes; the parities, added up over a file's splits, say in which state
each split begins; and in a second reading every split puts its records together from that state on. A record that goes
over the end of a split leaves a part in each split it touches, and only these parts are shuffled.
"""

import csv
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUOTE = '"'
SPLITS = "file string, block bigint, odd boolean"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block (where the split begins) and value, in the order of the file within a split."""
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _by_split(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], list[str]]]:
    """((file, block), lines) for each run of lines of one split."""
    held: list[str] = []
    split = None
    for file, block, value in zip(*(batch.column(name).to_pylist() for name in ("file", "block", "value"))):
        if (file, block) != split and held:
            yield split, held
            held = []
        split = file, block
        held.append(value)
    if held:
        yield split, held


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether each split holds an odd number of quotes; a row per split."""
    odd: defaultdict[tuple[str, int], bool] = defaultdict(bool)
    for batch in batches:
        for split, lines in _by_split(batch):
            odd[split] ^= sum(line.count(QUOTE) for line in lines) % 2 == 1
    columns = [[file for file, _ in odd], [block for _, block in odd], list(odd.values())]
    yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(columns, (pa.string(), pa.int64(), pa.bool_()))], names=["file", "block", "odd"])


def inside_quotes(splits: list[tuple[str, int, bool]]) -> set[tuple[str, int]]:
    """The splits (file, block) that begin inside quotes, from the parities of all."""
    inside, file, state = set(), None, False
    for own, block, odd in sorted(splits):
        state = state if own == file else False
        file = own
        if state:
            inside.add((own, block))
        state ^= odd
    return inside


def records(spark: SparkSession, path: str, header: list[str] | None = None) -> DataFrame:
    """file, block, row and record (its text with line breaks and quotes as they are): the records of all files.

    (block, row) is the place in the file. A row per split comes to the driver; those that begin inside quotes go to the
    tasks. With ``header`` a file whose first record is another one is an error. A quote within a value must be doubled,
    as all writers do it, or records after it are cut in the wrong places.
    """
    lines = _lines(spark, path)
    splits = [tuple(row) for row in lines.mapInArrow(_parities, SPLITS).groupBy("file", "block").agg((F.sum(F.col("odd").cast("int")) % 2 == 1).alias("odd")).collect()]
    shared = spark.sparkContext.broadcast(inside_quotes(splits))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, row, part, inside, first = None, 0, [], False, False
        rows: list[tuple] = []

        def close(kind: int) -> None:
            # kind 0: a whole record; 1: the end of one that began in an earlier split; 2: one that goes on; 3: both
            text = "\n".join(part)
            if header is not None and split[1] == row == 0 and kind == 0 and next(csv.reader([text.rstrip("\r").removeprefix("\ufeff")]), []) != header:
                raise ValueError(f"{split[0]} begins with {text[:200]!r}, not with {header}")
            rows.append((*split, row, kind, text))

        for batch in batches:
            for own, values in _by_split(batch):
                if own != split:
                    if part:
                        close(3 if first else 2)
                    split, row, part = own, 0, []
                    inside = first = own in shared.value
                for value in values:
                    part.append(value)
                    inside ^= value.count(QUOTE) % 2 == 1
                    if not inside:
                        close(1 if first else 0)
                        row, part, first = row + 1, [], False
            yield _packed(rows)
            rows = []
        if part:
            close(3 if first else 2)
            yield _packed(rows)

    found = lines.mapInArrow(assemble, "file string, block bigint, row bigint, kind int, record string")
    whole = found.filter("kind = 0").select("file", "block", "row", "record")
    # Parts of records that go over a split's end: at most two per split. A record's parts follow one another.
    order = Window.partitionBy("file").orderBy("block", "row")
    parts = found.filter("kind > 0").withColumn("record_no", F.sum(F.when(F.col("kind") == 2, 1).otherwise(0)).over(order))
    joined = parts.groupBy("file", "record_no").agg(F.array_sort(F.collect_list(F.struct("block", "row", "record"))).alias("parts"))
    place = F.col("parts")[0]
    return whole.unionByName(joined.select("file", place["block"].alias("block"), place["row"].alias("row"), F.array_join(F.col("parts.record"), "\n").alias("record")))


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
    columns = list(zip(*rows)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(columns, kinds)], names=["file", "block", "row", "kind", "record"])


def read_quoted_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, named by the header, and ``ingest_order`` (file, block, row). Every file begins with the same
    header, or reading fails. Line breaks within a value stay as they are."""
    names = spark.read.options(header=True, quote=QUOTE, escape=QUOTE).csv(path).columns
    schema = ", ".join(f"`{name}` string" for name in names)
    record = F.regexp_replace("record", "\r$", "")
    parsed = F.from_csv(record, F.lit(schema), {"quote": QUOTE, "escape": QUOTE, "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"})
    rows = records(spark, path, names).filter((F.col("block") != 0) | (F.col("row") != 0)).filter(record != "")
    return rows.select(parsed.alias("_csv"), F.struct("file", "block", "row").alias("ingest_order")).select("_csv.*", "ingest_order")
