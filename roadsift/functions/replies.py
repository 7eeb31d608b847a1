"""Reading the JSON record out of a chatty model reply."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadsift.functions.numbers import clamp
from roadsift.functions.text import cut, strip
from roadsift.schemas import (
    AREA_CHARS,
    DEFAULT_AREA,
    DEFAULT_CONFIDENCE,
    DEFAULT_SENTIMENT,
    DEFAULT_SEVERITY,
    DEFAULT_TYPE,
    FEEDBACK_TYPES,
    SENTIMENTS,
)

# What counts as text of a whole or of a decimal number.
WHOLE_NUMBER = r"^[+-]?[0-9]+$"
DECIMAL_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def json_span(reply: Column) -> Column:
    """From the first ``{`` to the last ``}``; empty when there is no such span."""
    return F.regexp_extract(reply, r"(?s)\{.*\}", 0)


def with_record(replies: DataFrame, reply: str, *fields: str, typed: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``_span`` and ``_record``: the named fields as strings or (``typed``) variants, which keep ``3`` and
    ``"3"`` apart. The record is NULL unless the span is exactly one JSON object.

    Parsing ``[span]`` as an array is what refuses trailing text: on the bare span the parser stops after the
    first object and would accept ``{"a":1} tail }``. Each step is a column, so that none is worked out twice.
    """
    listed = [f"`{name}`:string" for name in fields] + [f"`{name}`:variant" for name in typed]
    schema = "array<struct<" + ",".join(listed) + ">>"
    bracketed = F.concat(F.lit("["), F.col("_span"), F.lit("]"))
    spanned = replies.withColumn("_span", json_span(F.col(reply)))
    parsed = spanned.withColumn("_records", F.from_json(bracketed, schema, {"allowSingleQuotes": "false"}))
    single = F.when(F.size("_records") == 1, F.get("_records", F.lit(0)))
    return parsed.withColumn("_record", single).drop("_records")


def number_of(value: Column, quoted_pattern: str) -> Column:
    """A JSON number or boolean, or a string that fits the pattern; NULL for all else, NaN and infinity included."""
    text = strip(value.cast("string"))
    return F.when(
        F.schema_of_variant(value) == "STRING", F.when(text.rlike(quoted_pattern), text.try_cast("double"))
    ).otherwise(F.try_variant_get(value, "$", "double"))


def one_of(text: Column, domain: list[str], default: str) -> Column:
    return F.when(text.isin(domain), text).otherwise(F.lit(default))


def bounded(number: Column, low: int | float, high: int | float, default: int | float) -> Column:
    finite = F.abs(number) < float("inf")  # NaN is greater than all numbers
    return F.when(finite, clamp(number, low, high)).otherwise(F.lit(float(default)))


def label_of(record: Column, severity: Column, confidence: Column) -> Column:
    """Label struct from a parsed reply and its numbers; anything out of the taxonomy becomes a default.

    Severity fractions are cut. (A quoted fraction is no whole number and has become NULL before.)
    """
    return F.struct(
        one_of(record["type"], FEEDBACK_TYPES, DEFAULT_TYPE).alias("fb_type"),
        cut(F.coalesce(record["area"], F.lit(DEFAULT_AREA)), AREA_CHARS).alias("product_area"),
        one_of(record["sentiment"], SENTIMENTS, DEFAULT_SENTIMENT).alias("sentiment"),
        bounded(severity, 1, 4, DEFAULT_SEVERITY).cast("int").alias("severity"),
        bounded(confidence, 0.0, 1.0, DEFAULT_CONFIDENCE).alias("confidence"),
    )


def truthy(value: Column) -> Column:
    """Truth of a verdict field: absent, null, 0, empty and the word "false" are false, the rest is true."""
    text, kind = value.cast("string"), F.schema_of_variant(value)
    return F.coalesce(
        F.when(kind == "STRING", ~F.lower(strip(text)).isin("", "false"))
        .when(kind == "BOOLEAN", text == "true")
        .when(kind.rlike("^(OBJECT|ARRAY)"), ~text.isin("{}", "[]"))
        .otherwise(text.try_cast("double") != 0.0),
        F.lit(False),
    )
