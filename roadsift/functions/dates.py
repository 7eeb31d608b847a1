"""Dates out of ISO text; sessions are expected to run in UTC."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_timestamp(value: Column) -> Column:
    """Text or timestamp to timestamp: offsets are shifted to the session zone, unreadable text is NULL."""
    return value.try_cast("timestamp")


def iso_date(value: Column) -> Column:
    """Calendar day. Goes through the timestamp, since a direct cast of text would ignore its offset."""
    return F.to_date(iso_timestamp(value))
