"""Rounding, clamping and percentage text."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_even(value: Column, digits: int = 0) -> Column:
    """Half-even rounding on the double, the rule of Python's ``round``; ``F.round`` rounds half up."""
    scale = float(10**digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def clamp(value: Column, low: int | float, high: int | float) -> Column:
    """Value within the bounds; NULL stays NULL, which ``least`` and ``greatest`` would skip."""
    return F.when(value < low, F.lit(low)).when(value > high, F.lit(high)).otherwise(value)


def whole_rating(value: Column) -> Column:
    """Rating text or number cut to an int; NULL when absent or not a number."""
    return value.try_cast("double").try_cast("int")


def percent_text(part: Column, whole: Column) -> Column:
    """``part / whole`` as a whole percentage, NULL when there is nothing to divide by."""
    share = F.rint(F.try_divide(part.cast("double"), whole.cast("double")) * 100.0)
    return F.concat(share.cast("bigint").cast("string"), F.lit("%"))


def theme_count(items: Column) -> Column:
    """Number of clusters for that many items: one per 18, at least 4, at most 8."""
    return clamp(F.rint(items.cast("double") / 18.0).cast("int"), 4, 8)


def scaled_sum(value: Column) -> Column:
    """Sum of a fraction as an integer count of millionths, so that the row order cannot change the result."""
    return F.sum(F.rint(value * 1e6).cast("bigint"))
