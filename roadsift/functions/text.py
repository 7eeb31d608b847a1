"""Trimming, cutting and the line formats of reports."""

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Python's ``str.strip`` removes. SQL ``trim`` alone removes only blanks.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Words that a data-frame CSV reader takes as missing.
MISSING_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
    "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def blank_to_null(text: Column) -> Column:
    return F.when(F.length(strip(text)) > 0, text)


def missing_to_null(text: Column) -> Column:
    return F.when(~text.isin(MISSING_WORDS), text)


def or_default(text: Column, default: str) -> Column:
    """``text``, or the default when it is NULL or empty."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def cut(text: Column, chars: int) -> Column:
    """First ``chars`` code points."""
    return F.substring(text, 1, chars)


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """Whether the lower-cased text holds one of the (lower-case) words."""
    lowered = F.lower(text)
    found = F.lit(False)
    for word in words:
        found = found | F.contains(lowered, F.lit(word))
    return found


def title_words(text: Column) -> Column:
    """Upper-cases the first letter of every run of letters and lower-cases the rest.

    ``initcap`` breaks words at blanks only and would leave ``ui/ux`` as ``Ui/ux``.
    """
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    titled = F.transform(runs, lambda run: F.concat(F.upper(run.substr(1, 1)), F.lower(F.substring(run, 2, 2**31 - 1))))
    return F.array_join(titled, "")


def shown(value: Column) -> Column:
    """Value as report text; a missing value reads ``None``."""
    return F.coalesce(value.cast("string"), F.lit("None"))


def evidence_line(item_id: Column, fb_type: Column, severity: Column, body: Column, chars: int) -> Column:
    """``[#7] (bug, sev 3): text``, the form in which items are put before a writer."""
    return F.concat(
        F.lit("[#"), item_id.cast("string"), F.lit("] ("), shown(fb_type), F.lit(", sev "), shown(severity),
        F.lit("): "), cut(F.coalesce(body, F.lit("None")), chars),
    )


def verbatim_line(item_id: Column, fb_type: Column, severity: Column, body: Column, chars: int = 280) -> Column:
    """``- **[#7]** (bug, sev 3): "text"``, the form of the evidence section."""
    return F.concat(
        F.lit("- **[#"), item_id.cast("string"), F.lit("]** ("), shown(fb_type), F.lit(", sev "), shown(severity),
        F.lit('): "'), cut(F.coalesce(body, F.lit("None")), chars), F.lit('"'),
    )


def picker_line(item_id: Column, fb_type: Column, severity: Column, body: Column, chars: int = 55) -> Column:
    """``#7 · bug · sev 3 · text``, the form of selection lists."""
    return F.concat(
        F.lit("#"), item_id.cast("string"), F.lit(" · "), shown(fb_type), F.lit(" · sev "), shown(severity),
        F.lit(" · "), cut(F.coalesce(body, F.lit("None")), chars),
    )


def signed(number: Column) -> Column:
    """``+5``, ``+0``, ``-2``."""
    return F.format_string("%+d", number)


def score_text(score: Column) -> Column:
    """One-decimal score in plain notation, whatever its size (a double cast turns to ``1.0E7``)."""
    return score.cast("decimal(38,1)").cast("string")


def guidance_block(guidance: Column) -> Column:
    """Optional steering text for a writer; empty when none is given."""
    text = strip(F.coalesce(guidance, F.lit("")))
    return F.when(text == "", F.lit("")).otherwise(
        F.concat(F.lit("\n\nGuidance from the product manager, to be reflected in the sections it concerns:\n"), text, F.lit("\n"))
    )


def ordered_lines(line: str, rank: str, separator: str = "\\n") -> Column:
    """Aggregate: the named column's lines in rank order. Only for groups of bounded size."""
    return F.expr(f"listagg({line}, '{separator}') WITHIN GROUP (ORDER BY {rank})")
