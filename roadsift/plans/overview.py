"""Tables of the overview, review queue and sanity report."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadsift.functions.numbers import percent_text
from roadsift.functions.text import cut, picker_line
from roadsift.operators.small import hinted
from roadsift.schemas import SEVERITY_LABELS, WORK_BATCH_SIZE


def kpis(items: DataFrame, opportunities: DataFrame) -> DataFrame:
    """One row of counts, in one pass over the items."""
    classified = F.col("status") == "classified"
    counts = items.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(classified).alias("classified"),
        F.count_if(classified & (F.col("fb_type") != "praise")).alias("actionable"),
        F.count("theme_id").alias("themed"),
    )
    scored = opportunities.agg(F.count(F.lit(1))).scalar()
    share = F.concat(percent_text(F.col("themed"), F.col("total")), F.lit(" of all feedback"))
    return counts.select("*", scored.alias("opportunities"), F.coalesce(share, F.lit("0%")).alias("themed_share"))


def funnel(kpi_row: DataFrame) -> DataFrame:
    """(position, stage, items) out of the KPI row."""
    return kpi_row.selectExpr(
        "stack(4, 1, 'Ingested', total, 2, 'Classified', classified, 3, 'Actionable', actionable,"
        " 4, 'Prioritized (RICE)', themed) AS (position, stage, items)"
    )


def mix(items: DataFrame, column: str) -> DataFrame:
    """(column, items) over classified items, largest group last."""
    counts = items.filter(F.col("status") == "classified").groupBy(column).agg(F.count(F.lit(1)).alias("items"))
    return counts.orderBy("items", column)


def severity_mix(items: DataFrame) -> DataFrame:
    return mix(items, "severity").withColumn("label", severity_label()).orderBy("severity")


def severity_label():
    pairs = [F.lit(value) for pair in SEVERITY_LABELS.items() for value in pair]
    return F.try_element_at(F.create_map(*pairs), F.col("severity"))


def histogram(items: DataFrame, column: str) -> DataFrame:
    """(column, items) over all items; missing values are a group of their own."""
    return items.groupBy(column).agg(F.count(F.lit(1)).alias("items")).orderBy(column)


def review_queue(items: DataFrame, n: int = WORK_BATCH_SIZE) -> DataFrame:
    """Items for a human: uncorrected first, then least confident, then most severe."""
    queue = items.filter(F.col("status") == "classified").orderBy(
        F.col("human_corrected").asc_nulls_first(),
        F.col("confidence").asc_nulls_first(),
        F.col("severity").desc_nulls_last(),
        F.col("id").asc(),
    )
    return queue.limit(n).select("id", "body", "fb_type", "severity", "confidence")


def theme_sizes(items: DataFrame) -> DataFrame:
    themed = items.filter(F.col("theme_id").isNotNull())
    return themed.groupBy("theme_id").agg(F.count(F.lit(1)).alias("items"))


def theme_headers(items: DataFrame, themes: DataFrame) -> DataFrame:
    """(id, header): theme name with its number of items."""
    sized = themes.join(theme_sizes(items), themes["id"] == F.col("theme_id"), "left")
    count = F.coalesce(F.col("items"), F.lit(0)).cast("string")
    header = F.concat(F.col("name"), F.lit(" — "), count, F.lit(" items"))
    return sized.select("id", header.alias("header")).orderBy("id")


def theme_drilldown(items: DataFrame, themes: DataFrame) -> DataFrame:
    """Every themed item under its theme, most severe first; a range sort, so one large theme spreads out."""
    labels = themes.select(F.col("id").alias("theme_id"), F.col("name").alias("theme"))
    themed = items.filter(F.col("theme_id").isNotNull()).select("theme_id", "id", "fb_type", "severity", "body")
    return themed.join(hinted(labels, themes), "theme_id").orderBy("theme_id", F.col("severity").desc_nulls_last(), "id")


def review_picker(items: DataFrame) -> DataFrame:
    """(id, label) of all classified items."""
    label = picker_line(F.col("id"), F.col("fb_type"), F.col("severity"), F.col("body"))
    return items.filter(F.col("status") == "classified").select("id", label.alias("label")).orderBy("id")


def low_ratings(items: DataFrame, n: int = 5, at_most: int = 2, chars: int = 160) -> DataFrame:
    picked = items.filter(F.col("rating") <= at_most).orderBy("id").limit(n)
    return picked.select("id", "rating", cut(F.col("body"), chars).alias("body"))


def data_sanity(items: DataFrame, batch: DataFrame) -> DataFrame:
    """(section, entry, value) rows: ratings, statuses, low-rating texts and the next work batch."""

    def section(name: str, rows: DataFrame, entry, value) -> DataFrame:
        return rows.select(F.lit(name).alias("section"), entry.cast("string").alias("entry"), value.cast("string").alias("value"))

    ratings = section("rating", histogram(items, "rating"), F.col("rating"), F.col("items"))
    statuses = section("status", histogram(items, "status"), F.col("status"), F.col("items"))
    low = section("low rating", low_ratings(items), F.col("id"), F.col("body"))
    waiting = section("work batch", batch, F.col("id"), F.lit(None))
    return ratings.unionByName(statuses).unionByName(low).unionByName(waiting)
