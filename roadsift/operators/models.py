"""The one place where work leaves Spark: a caller's function that answers prompts."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

Answer = Callable[[list[str]], list[tuple[str | None, str | None]]]


def one_of_each_text(hashed: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(body_hash, body) once per text of ``hashed`` (id, body, body_hash), of those in ``wanted`` (id, body_hash) if it is given.

    Texts are chosen by hash and least id, on rows without them, and fetched by id: they are shuffled once at most and
    never sorted.
    """
    first = (hashed if wanted is None else wanted).groupBy("body_hash").agg(F.min("id").alias("id"))
    return hashed.select("id", "body").join(first.hint("shuffle_hash"), "id").select("body_hash", "body")


def ask(prompts: DataFrame, answer: Answer, partitions: int | None = None) -> DataFrame:
    """The rows with (reply, error) in place of their ``prompt``; all other columns pass through untouched.

    ``answer`` gets the prompts of an Arrow batch and returns a (reply, error) pair for each. ``partitions`` is the
    number of batches under way at a time, given enough cores.
    """
    others = [field for field in prompts.schema.fields if field.name != "prompt"]
    rows = prompts.select(*[field.name for field in others], "prompt")
    spread = rows.repartition(partitions) if partitions else rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = answer(batch.column("prompt").to_pylist())
            answers = [pa.array([pair[side] for pair in pairs], pa.string()) for side in (0, 1)]
            columns = [batch.column(field.name) for field in others]
            yield pa.RecordBatch.from_arrays(columns + answers, names=[field.name for field in others] + ["reply", "error"])

    schema = StructType(others + [StructField("reply", StringType()), StructField("error", StringType())])
    return spread.mapInArrow(run, schema)
