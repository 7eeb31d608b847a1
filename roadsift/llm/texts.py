"""Column functions that several operators share."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def lowered(text: Column) -> Column:
    """The text with A-Z, and nothing else, in lower case; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def utf8(text: Column) -> Column:
    """The text's bytes, for functions that read them without decoding; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def text_key(text: Column) -> Column:
    """128 bits that stand for the text as it is; null counts as empty."""
    return F.unhex(F.md5(utf8(text)))


def words(text: Column) -> Column:
    """How many words the text has."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def whole_rows(docs: DataFrame, **computed: Column) -> DataFrame:
    """Each row as one struct ``row`` beside computed columns, so that no column of the input can clash with them."""
    return docs.select(F.struct(*(docs[f"`{name}`"] for name in docs.columns)).alias("row"), *(column.alias(name) for name, column in computed.items()))
