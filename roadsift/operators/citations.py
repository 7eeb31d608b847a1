"""Evidence pools, siblings, and checks that documents cite what they were shown.

Pools are small (30 items per theme, 7 for siblings) and travel as one array per theme. A document or item then
needs a single join on its theme; everything after that is work within the row. No row is exploded and regrouped,
so an item cited by very many documents is no hot key.
"""

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadsift.functions.text import cut, strip, verbatim_line
from roadsift.operators.ranking import attach, top_per_group
from roadsift.operators.small import hinted, is_small
from roadsift.schemas import EVIDENCE_POOL_SIZE, SIBLING_COUNT
from roadsift.session import written

# The citation pattern, the report's wording, and the patterns that read its counters back
# (older wordings included).
CITATION = "#([0-9]+)"
REPORT_HEAD = "\n---\n## Citation Verification (automated guardrail)"
REPORT_FOUND = "- Citations found: **"
REPORT_VALID = "- Valid (point to a real review): **"
REPORT_HALLUCINATED = "- Hallucinated: **"
REPORT_FLAGGED = " - flagged: "
REPORT_NONE = " - none"
EVIDENCE_HEAD = "\n## Evidence - verbatim from source (rendered from the database, not the model)"
FOUND_COUNTER = r"Citations found:\s*\*\*([0-9]+)\*\*"
VALID_COUNTER = r"Valid[^:\n]*:\s*\*\*([0-9]+)\*\*"
HALLUCINATED_COUNTER = r"Hallucinated[^:\n]*:\s*\*\*([0-9]+)\*\*"

QUOTE = r'#([0-9]+)[^"\n]*"([^"\n]+)"'
#: Quotes of one item that are looked for in one scan of its text.
QUOTES_A_SCAN = 5_000
EVIDENCE_CHARS = 300  # kept of an item for the report, unless a caller asks for more

ITEM = ["id", "fb_type", "severity", "body"]


def _order() -> list[Column]:
    return [F.col("severity").desc_nulls_last(), F.col("id").asc()]


def evidence_pool(items: DataFrame, themes: DataFrame | bool | None = None, n: int = EVIDENCE_POOL_SIZE) -> DataFrame:
    """(theme_id, rank, id, fb_type, severity, body): the n most severe items of every theme, lower ids first.

    Ranking sorts ids and severities only; texts are fetched for the winners. Here and below, ``themes`` (one row
    per theme) lets pools be broadcast after a check of their number.
    """
    themed = items.filter(F.col("theme_id").isNotNull())
    picked = top_per_group(themed.select("theme_id", "severity", "id"), "theme_id", _order(), n)
    return attach(picked, themed, ["fb_type", "body"], themes, n).select("theme_id", "rank", *ITEM)


def pool_by_theme(pool: DataFrame, chars: int = EVIDENCE_CHARS) -> DataFrame:
    """(theme_id, pool): the ranked items of a theme as one array, texts cut to ``chars``."""
    entry = F.struct("rank", "id", "fb_type", "severity", cut(F.col("body"), chars).alias("body"))
    return pool.groupBy("theme_id").agg(F.array_sort(F.collect_list(entry)).alias("pool"))


def with_siblings(
    targets: DataFrame,
    items: DataFrame,
    themes: DataFrame | None = None,
    n: int = SIBLING_COUNT,
    chars: int = EVIDENCE_CHARS,
) -> DataFrame:
    """Target rows (id, theme_id, …) with ``siblings``: the n worst other items of the same theme, none without one.

    The n + 1 worst of a theme hold the n worst others of every member.
    """
    few = is_small(themes, n + 1)
    pools = pool_by_theme(evidence_pool(items, few, n + 1), chars)
    others = F.slice(F.filter("pool", lambda other: other["id"] != F.col("id")), 1, n)
    empty = F.filter("pool", lambda other: F.lit(False))
    return (
        targets.join(hinted(pools, few), "theme_id", "left")
        .withColumn("siblings", F.coalesce(others, empty, F.array()))
        .drop("pool")
    )


def siblings(items: DataFrame, themes: DataFrame | None = None, n: int = SIBLING_COUNT) -> DataFrame:
    """(id, rank, sibling_id) rows for every item with siblings."""
    listed = with_siblings(items.select("id", "theme_id"), items, themes, n).select("id", F.posexplode("siblings").alias("_at", "_sibling"))
    return listed.select("id", (F.col("_at") + 1).alias("rank"), F.col("_sibling")["id"].alias("sibling_id"))


def cited_ids(markdown: Column) -> Column:
    """Distinct cited ids in ascending order, as digits: a cited number may exceed any integer type."""
    numbers = F.transform(
        F.regexp_extract_all(markdown, F.lit(CITATION), F.lit(1)),
        lambda digits: F.struct(F.length(canonical(digits)).alias("length"), canonical(digits).alias("digits")),
    )
    return F.array_sort(F.array_distinct(numbers))["digits"]


def canonical(digits: Column) -> Column:
    """A whole number's digits without leading zeros."""
    return F.regexp_replace(digits, "^0+(?=[0-9])", "")


def check_citations(documents: DataFrame, valid_ids: Column) -> DataFrame:
    """Adds cited, valid and hallucinated ids of each document, against the ids its writer was shown."""
    allowed = F.coalesce(valid_ids, F.array()).cast("array<string>")
    cited = documents.withColumn("cited", cited_ids(F.col("markdown"))).withColumn("_allowed", allowed)
    return cited.withColumns(
        {
            "valid": F.array_intersect("cited", "_allowed"),
            "hallucinated": F.array_except("cited", "_allowed"),
        }
    ).drop("_allowed")


def citation_counts(checked: DataFrame, *keys: str) -> DataFrame:
    return checked.select(
        *keys,
        F.size("cited").alias("n_cited"),
        F.size("valid").alias("n_valid"),
        F.size("hallucinated").alias("n_hallucinated"),
    )


def check_theme_documents(
    documents: DataFrame,
    items: DataFrame,
    themes: DataFrame | None = None,
    pool_size: int = EVIDENCE_POOL_SIZE,
    chars: int = EVIDENCE_CHARS,
) -> DataFrame:
    """Documents about themes (theme_id, markdown); only the pool shown to the writer is valid."""
    few = is_small(themes, pool_size)
    pools = pool_by_theme(evidence_pool(items, few, pool_size), chars).withColumnRenamed("pool", "evidence")
    joined = documents.join(hinted(pools, few), "theme_id", "left")
    return check_citations(joined, F.transform("evidence", lambda entry: entry["id"]))


def check_review_documents(
    documents: DataFrame,
    items: DataFrame,
    themes: DataFrame | None = None,
    n: int = SIBLING_COUNT,
    chars: int = EVIDENCE_CHARS,
) -> DataFrame:
    """Documents about single items (item_id, markdown); the item and its siblings are valid."""
    target = F.struct(
        F.lit(0).alias("rank"), "id", "fb_type", "severity", cut(F.col("body"), chars).alias("body")
    )
    lines = items.select("id", "theme_id", target.alias("_target"))
    about = documents.join(lines, documents["item_id"] == lines["id"])
    shown = with_siblings(about, items, themes, n, chars)
    joined = shown.withColumn("evidence", F.concat(F.array("_target"), F.col("siblings")))
    checked = joined.drop("id", "theme_id", "_target", "siblings")
    return check_citations(checked, F.transform("evidence", lambda entry: entry["id"]))


def verification_report(checked: DataFrame, *keys: str, chars: int = 280) -> DataFrame:
    """(keys, markdown): the document with its citation counts and the cited items quoted from the table, as far as
    ``chars`` and the evidence go."""
    flagged = F.concat(F.lit(REPORT_FLAGGED + "["), F.array_join("hallucinated", ", "), F.lit("]"))
    cited = F.filter("evidence", lambda entry: F.array_contains("valid", entry["id"].cast("string")))
    by_id = F.array_sort(F.transform(cited, lambda entry: F.struct(entry["id"], entry["fb_type"], entry["severity"], entry["body"])))
    quotes = F.transform(
        by_id, lambda entry: verbatim_line(entry["id"], entry["fb_type"], entry["severity"], entry["body"], chars)
    )

    def count(ids: str) -> Column:
        return F.concat(F.size(ids).cast("string"), F.lit("**"))

    text = F.concat(
        strip(F.col("markdown")),
        F.lit("\n" + REPORT_HEAD + "\n" + REPORT_FOUND), count("cited"),
        F.lit("\n" + REPORT_VALID), count("valid"),
        F.lit("\n" + REPORT_HALLUCINATED), count("hallucinated"),
        F.when(F.size("hallucinated") > 0, flagged).otherwise(REPORT_NONE),
        F.lit("\n"),
        F.array_join(F.concat(F.array(F.lit(EVIDENCE_HEAD)), F.coalesce(quotes, F.array().cast("array<string>"))), "\n"),
        F.lit("\n"),
    )
    return checked.select(*keys, text.alias("markdown"))


def report_counters(documents: DataFrame, *keys: str) -> DataFrame:
    """(keys, n_cited, n_valid, n_hallucinated) read back out of finished reports; NULL where not stated."""

    def counter(pattern: str) -> Column:
        return F.nullif(F.regexp_extract("markdown", pattern, 1), F.lit("")).try_cast("int")

    return documents.select(
        *keys,
        counter(FOUND_COUNTER).alias("n_cited"),
        counter(VALID_COUNTER).alias("n_valid"),
        counter(HALLUCINATED_COUNTER).alias("n_hallucinated"),
    )


def quotes(documents: DataFrame, *keys: str) -> DataFrame:
    """(keys, item_id, quote): quoted text that follows a citation on the same line, as often as it does; the id as digits."""
    text = F.col("markdown")
    ids = F.regexp_extract_all(text, F.lit(QUOTE), F.lit(1))
    spans = F.regexp_extract_all(text, F.lit(QUOTE), F.lit(2))
    found = documents.select(*keys, F.explode(F.arrays_zip(ids.alias("item"), spans.alias("quote"))).alias("_pair"))
    return found.select(
        *keys,
        canonical(F.col("_pair")["item"]).alias("item_id"),
        F.col("_pair")["quote"].alias("quote"),
    )


def check_quotes(documents: DataFrame, items: DataFrame, *keys: str, quotes_a_scan: int = QUOTES_A_SCAN) -> DataFrame:
    """Adds ``found``: does the cited item's whole text hold the quote? False when there is no such item.

    All quotes of an item are looked for in one scan of its text, by an Aho-Corasick automaton; an item with very many has
    a scan for each part of them, so no task holds more than a part. Quotes and texts meet in one shuffle by item and part. A
    small number of cited items is sent to the items, whose texts are then scanned and only the cited ones are shuffled.
    """
    listed = written(quotes(documents, *keys))
    cited = written(listed.groupBy("item_id").agg(F.ceil(F.count(F.lit(1)) / quotes_a_scan).alias("parts")))
    several = cited.filter(F.col("parts") > 1)
    several = hinted(several, several)
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    pair = F.struct("quote", F.struct(*keys).alias("asked")).alias("pair")
    asked = listed.join(several, "item_id", "left").select("item_id", F.pmod(F.xxhash64("quote", *keys), parts).alias("part"), pair, F.lit(None).cast("string").alias("body"))
    bodies = items.select(F.col("id").cast("string").alias("item_id"), "body").filter(F.col("item_id").isNotNull())
    if is_small(cited):
        bodies = bodies.join(F.broadcast(cited.select("item_id")), "item_id", "left_semi")
    spread = bodies.join(several, "item_id", "left").select("item_id", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), F.lit(None).cast(asked.schema["pair"].dataType).alias("pair"), "body")
    # No quote holds a line break, so the texts of an item that is stored twice are looked through as one.
    met = asked.unionByName(spread).groupBy("item_id", "part").agg(F.collect_set("pair").alias("pairs"), F.array_join(F.collect_list("body"), "\n").alias("body"))
    scans = met.filter(F.size("pairs") > 0).select("item_id", F.col("pairs.quote").alias("quotes"), "body", F.col("pairs.asked").alias("asked"))
    schema = T.StructType([*(listed.schema[key] for key in keys), *FOUND.fields])
    return scans.mapInArrow(_scanned, schema)


FOUND = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("quote", T.StringType()), T.StructField("found", T.BooleanType())])


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, quote, found), behind the fields of ``asked`` if there are any, per quote of each row, the row's text being
    read once."""
    for batch in batches:
        rows: list[tuple[str, str, bool]] = []
        for item_id, quoted, body in zip(*(batch.column(name).to_pylist() for name in ("item_id", "quotes", "body"))):
            held = held_in(body or "", list(dict.fromkeys(quoted)))
            rows += [(item_id, quote, quote in held) for quote in quoted]
        columns = [pa.array(column, kind) for column, kind in zip(zip(*rows), (pa.string(), pa.string(), pa.bool_()))]
        if columns:
            asked = batch.column("asked").flatten() if "asked" in batch.schema.names else pa.array([{}] * len(rows), pa.struct([]))
            yield pa.RecordBatch.from_arrays([*asked.flatten(), *columns], names=[*(field.name for field in asked.type), *FOUND.names])


def held_in(body: str, quoted: list[str]) -> set[str]:
    """The quotes, none of them empty, that a text holds, found in one scan."""
    automaton = ahocorasick.Automaton()
    for quote in quoted:
        automaton.add_word(quote, quote)
    automaton.make_automaton()
    return {quote for _, quote in automaton.iter(body)}
