"""Content keys."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_ABSENT = "\x00"  # cannot occur in the text itself


def body_hash(body: Column) -> Column:
    return F.sha2(body, 256)


def content_id(prefix: str, *parts: Column) -> Column:
    """Id of a record without one of its own: equal for the same content, however it is read.

    A separator no text holds keeps ``("ab", "c")`` and ``("a", "bc")`` apart, and NULL apart from empty.
    """
    joined = F.concat_ws("\x1f", *[F.coalesce(part.cast("string"), F.lit(_ABSENT)) for part in parts])
    return F.concat(F.lit(prefix), F.sha2(joined, 256))
