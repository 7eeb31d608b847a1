import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def column(spark):
    """Values of a column function over one row per input."""

    def values(inputs, kind, function):
        frame = spark.createDataFrame([(i, value) for i, value in enumerate(inputs)], f"i int, x {kind}")
        return [row[0] for row in frame.orderBy("i").select(function(F.col("x"))).collect()]

    return values


ITEM_FIELDS = {
    "id": "bigint", "source": "string", "external_id": "string", "author": "string", "body": "string", "rating": "int",
    "created_at": "timestamp", "ingested_at": "timestamp", "status": "string", "fb_type": "string",
    "product_area": "string", "sentiment": "string", "severity": "int", "confidence": "double",
    "human_corrected": "int", "theme_id": "bigint",
}
DEFAULTS = {"source": "csv", "body": "a body that is long enough", "status": "classified", "fb_type": "bug", "human_corrected": 0}


@pytest.fixture
def make_items(spark):
    """Feedback items from keyword dicts; ids count from 1 unless given."""

    def build(*rows):
        schema = ", ".join(f"{name} {kind}" for name, kind in ITEM_FIELDS.items())
        filled = [{"id": at, **DEFAULTS, **row} for at, row in enumerate(rows, start=1)]
        return spark.createDataFrame([tuple(row.get(name) for name in ITEM_FIELDS) for row in filled], schema)

    return build
