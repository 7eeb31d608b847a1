"""RICE scores and the roadmap."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadsift.functions.numbers import round_even, scaled_sum
from roadsift.functions.text import ordered_lines, score_text
from roadsift.schemas import DEFAULT_EFFORT


def theme_stats(items: DataFrame) -> DataFrame:
    """(theme_id, reach, impact, confidence), averages over the known values only.

    Sums are kept in integers and each task combines its rows first, so the few themes are no bottleneck.
    """
    sums = (
        items.filter(F.col("theme_id").isNotNull())
        .groupBy("theme_id")
        .agg(
            F.count(F.lit(1)).alias("reach"),
            F.sum(F.col("severity").cast("bigint")).alias("_severity"),
            F.count("severity").alias("_severities"),
            scaled_sum(F.col("confidence")).alias("_confidence"),
            F.count("confidence").alias("_confidences"),
        )
    )
    return sums.select(
        "theme_id",
        "reach",
        F.try_divide(F.col("_severity").cast("double"), F.col("_severities")).alias("impact"),
        F.try_divide(F.col("_confidence").cast("double"), F.col("_confidences") * 1e6).alias("confidence"),
    )


def rice(items: DataFrame, themes: DataFrame, efforts: DataFrame | None = None) -> DataFrame:
    """Opportunities, one per theme; themes without items score 0.

    Impact and confidence are rounded before they are multiplied. ``efforts(theme_id, effort)`` replaces the
    default of two person-weeks where a human gave one.
    """
    scored = themes.select(F.col("id").cast("bigint").alias("theme_id")).join(theme_stats(items), "theme_id", "left")
    if efforts is None:
        scored = scored.withColumn("effort", F.lit(DEFAULT_EFFORT))
    else:
        given = efforts.select("theme_id", F.col("effort").cast("double").alias("effort"))
        scored = scored.join(given, "theme_id", "left").withColumn(
            "effort", F.coalesce(F.col("effort"), F.lit(DEFAULT_EFFORT))
        )
    zero = F.lit(0.0)
    rounded = scored.select(
        "theme_id",
        F.coalesce(F.col("reach"), F.lit(0)).cast("bigint").alias("reach"),
        round_even(F.coalesce(F.col("impact"), zero), 2).alias("impact"),
        round_even(F.coalesce(F.col("confidence"), zero), 2).alias("confidence"),
        "effort",
    )
    product = F.col("reach") * F.col("impact") * F.col("confidence") / F.col("effort")
    return rounded.withColumn("rice_score", round_even(product, 1))


def named(opportunities: DataFrame, themes: DataFrame) -> DataFrame:
    """Opportunities with their theme's name; those of a theme run cleared since are left out."""
    labels = themes.select(F.col("id").cast("bigint").alias("theme_id"), *[c for c in ("name", "summary") if c in themes.columns])
    return opportunities.join(labels, "theme_id")


def roadmap(opportunities: DataFrame, themes: DataFrame) -> DataFrame:
    """Highest score first."""
    columns = ["theme_id", "name", "reach", "impact", "confidence", "effort", "rice_score"]
    return named(opportunities, themes).select(*columns).orderBy(F.desc("rice_score"), "theme_id")


def score_printout(opportunities: DataFrame, themes: DataFrame) -> DataFrame:
    """Score table ordered by every shown value, from high to low."""
    columns = ["rice_score", "name", "reach", "impact", "confidence"]
    return named(opportunities, themes).select(*columns).orderBy(*[F.desc(c) for c in columns])


def top_opportunity(opportunities: DataFrame, themes: DataFrame) -> DataFrame:
    return named(opportunities, themes).orderBy(F.desc("rice_score"), "theme_id").limit(1)


def opportunity_of(opportunities: DataFrame, themes: DataFrame, theme_id: int) -> DataFrame:
    return named(opportunities, themes).filter(F.col("theme_id") == theme_id)


def landscape(opportunities: DataFrame, themes: DataFrame) -> DataFrame:
    return named(opportunities, themes).select("name", "reach", "impact", "rice_score")


def roadmap_lines(opportunities: DataFrame, themes: DataFrame) -> DataFrame:
    """(position, line) of the numbered roadmap. One window without groups: themes only, never items."""
    place = Window.orderBy(F.desc("rice_score"), "theme_id")
    placed = named(opportunities, themes).withColumn("position", F.row_number().over(place))
    line = F.concat(
        F.col("position").cast("string"), F.lit(". "), F.col("name"), F.lit(" — reach "), F.col("reach").cast("string"),
        F.lit(", impact "), F.col("impact").cast("string"), F.lit("/4, effort "), F.col("effort").cast("string"),
        F.lit("w, RICE "), score_text(F.col("rice_score")),
    )
    return placed.select("position", "theme_id", line.alias("line"))


def roadmap_text(opportunities: DataFrame, themes: DataFrame) -> DataFrame:
    """The numbered roadmap as one text."""
    return roadmap_lines(opportunities, themes).agg(ordered_lines("line", "position").alias("roadmap"))
