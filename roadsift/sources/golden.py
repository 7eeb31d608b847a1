"""The golden set as CSV."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadsift.schemas import GOLDEN

CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"'}


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden rows; columns are matched by name, and those a file lacks are NULL."""
    raw = spark.read.options(**CSV_OPTIONS, multiLine=True, encoding="UTF-8").csv(path)
    return raw.select(
        *[
            (F.col(field.name) if field.name in raw.columns else F.lit(None)).cast(field.dataType).alias(field.name)
            for field in GOLDEN.fields
        ]
    )


def write_golden(golden: DataFrame, path: str, mode: str = "overwrite") -> None:
    keep_blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    golden.write.mode(mode).options(**CSV_OPTIONS, **keep_blanks).csv(path)
