"""Incremental import and labelling of files landing in a directory."""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from roadsift.operators.models import Answer
from roadsift.plans.runs import import_feedback, label_import, label_new


def landed_files(
    spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", max_files: int = 1000, **options: str
) -> DataFrame:
    """Stream of the files in a directory, a bounded number per micro-batch."""
    return spark.readStream.format(fmt).schema(schema).options(maxFilesPerTrigger=max_files, **options).load(path)


def start_ingest(
    raw: DataFrame,
    directory: str,
    checkpoint: str,
    normalize: Callable[[DataFrame], DataFrame],
    order: Sequence[Column],
    answer: Answer | None = None,
) -> StreamingQuery:
    """Imports and labels everything that has landed, then stops.

    Items an earlier run left without a label are taken up before the stream starts. After that a micro-batch labels
    its own import only and does not look at the rest of the tables. A micro-batch that is replayed meets its own
    rows as stored keys and inserts nothing. So nothing is lost and nothing is doubled.
    """
    label_new(raw.sparkSession, directory, answer)

    def process(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        inserted, import_no = import_feedback(spark, directory, normalize(batch), order)
        if inserted:
            label_import(spark, directory, import_no, answer)

    writer = raw.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
