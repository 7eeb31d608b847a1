"""Runs registered queries and their SQL side by side: ``python -m checks.compare [directory [name…]]``."""

import sys
import time

import duckdb
import pyarrow as pa
from pyspark.sql import SparkSession

from checks.fixtures import BASE_TABLES
from checks.oracles import ORACLES
from checks.queries import QUERIES


def oracle_connection(directory: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in BASE_TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{directory}/{name}.parquet'")
    return connection


def canonical(table: pa.Table) -> list[tuple]:
    """Rows with columns by name, in a fixed order."""
    columns = [table.column(name).to_pylist() for name in sorted(table.column_names)]
    return sorted(zip(*columns, strict=True), key=repr)


def types(table: pa.Table) -> dict[str, str]:
    return {field.name: str(field.type).replace("large_", "") for field in table.schema}


def difference(spark: SparkSession, connection: duckdb.DuckDBPyConnection, directory: str, name: str) -> str | None:
    """What differs, or None."""
    got = QUERIES[name](spark, directory).toArrow()
    if name not in ORACLES:
        return None if got.num_rows else "no rows"
    want = connection.execute(ORACLES[name]).to_arrow_table()
    if types(got) != types(want):
        return f"types {sorted(set(types(got).items()) ^ set(types(want).items()))}"
    left, right = canonical(got), canonical(want)
    if left == right:
        return None
    only_left = [row for row in left if row not in right][:2]
    only_right = [row for row in right if row not in left][:2]
    return f"rows {len(left)} / {len(right)}\n  spark {only_left}\n  sql   {only_right}"


def main() -> None:
    directory = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = oracle_connection(directory)
    failed = 0
    for name in names:
        started = time.time()
        try:
            problem = difference(spark, connection, directory, name)
        except Exception as error:  # keep going, to list every failure
            problem = str(error)[:700]
        failed += problem is not None
        print(f"{name:24s} {time.time() - started:6.2f}s {'ok' if problem is None else problem[:1500]}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")


if __name__ == "__main__":
    main()
