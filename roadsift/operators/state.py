"""The current state of items, derived from append-only logs.

Parquet rows cannot be updated, so labels, resets and corrections are appended and the latest one per item counts.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadsift.operators.labels import LABEL_FIELDS
from roadsift.schemas import FEEDBACK_TYPES


def latest(log: DataFrame, key: str, columns: list[str], name: str) -> DataFrame:
    """(key, struct of the row with the highest ``seq``); combined within tasks before the shuffle."""
    return log.groupBy(key).agg(F.max_by(F.struct(*columns), F.col("seq")).alias(name))


def latest_themes(assignments: DataFrame, published: DataFrame | None = None) -> DataFrame:
    """(item_id, theme_id) of the newest theme run; items it left out have no theme any more.

    ``published``, rows with the ``run_id`` of finished runs, leaves out runs that broke off. An item that a run
    lists twice counts once.
    """
    newest = (assignments if published is None else published).agg(F.max("run_id").alias("run_id"))
    of_run = assignments.filter(F.col("run_id") == newest.scalar())
    return of_run.groupBy("item_id").agg(F.max("theme_id").alias("theme_id"))


def correction_events(edits: DataFrame, seq: int | Column) -> DataFrame:
    """Log rows for a reviewer's edits; values outside the taxonomy are refused, not repaired."""
    allowed = F.col("fb_type").isin(FEEDBACK_TYPES) & F.col("severity").between(1, 4)
    return edits.filter(allowed).select(
        F.col("item_id").cast("bigint").alias("item_id"),
        (seq if isinstance(seq, Column) else F.lit(seq)).cast("bigint").alias("seq"),
        "fb_type",
        F.col("severity").cast("int").alias("severity"),
    )


def latest_events(label_events: DataFrame) -> DataFrame:
    """item_id, ``_last`` (the latest event) and ``_kept`` (the latest one other than a reset) per item."""
    event = F.struct("kind", "seq", *LABEL_FIELDS)
    return label_events.groupBy("item_id").agg(
        F.max_by(event, "seq").alias("_last"),
        F.max_by(event, F.when(F.col("kind") != "reset", F.col("seq"))).alias("_kept"),
    )


def latest_fixes(corrections: DataFrame) -> DataFrame:
    """item_id and ``_fix`` (the latest correction) per item."""
    return latest(corrections, "item_id", ["fb_type", "severity", "seq"], "_fix")


def current_items(
    items: DataFrame,
    label_events: DataFrame,
    corrections: DataFrame,
    assignments: DataFrame,
    theme_runs: DataFrame | None = None,
) -> DataFrame:
    """Items with status, labels, correction flag and theme.

    All joins are on the item id, so the items are shuffled once. An item is new without an event or after a
    reset. A reset clears the labels but not the theme, and does not touch an item a human corrected before:
    there the latest event other than a reset counts. A correction overrides type and severity only.
    """
    joined = items
    for state in (latest_events(label_events), latest_fixes(corrections), latest_themes(assignments, theme_runs)):
        joined = joined.join(state, F.col("id") == F.col("item_id"), "left").drop("item_id")
    return _stated(joined, items.columns)


def current_items_of_buckets(
    items: DataFrame,
    base: tuple[DataFrame, DataFrame],
    newer: tuple[DataFrame, DataFrame],
    assignments: DataFrame,
    theme_runs: DataFrame | None = None,
) -> DataFrame:
    """``current_items`` for items that are bucketed by id, and label events and corrections (``base``) bucketed by item.

    ``newer`` holds the events and corrections since then, with a higher ``seq`` than any event or correction of ``base``. The bucketed logs
    meet the items bucket by bucket, and of everything else only rows without texts are shuffled. The joins hash the state of
    a bucket, so the items are not sorted either.
    """
    joined = items

    def met(state: DataFrame, names: list[str], suffix: str) -> DataFrame:
        renamed = state.select("item_id", *(F.col(name).alias(name + suffix) for name in names)).hint("shuffle_hash")
        return joined.join(renamed, F.col("id") == F.col("item_id"), "left").drop("item_id")

    for (events, corrections), suffix in ((base, "_then"), (newer, "_since")):
        joined = met(latest_events(events), ["_last", "_kept"], suffix)
        joined = met(latest_fixes(corrections), ["_fix"], suffix)
    for name in ("_last", "_kept", "_fix"):
        joined = joined.withColumn(name, F.coalesce(f"{name}_since", f"{name}_then"))
    joined = met(latest_themes(assignments, theme_runs), ["theme_id"], "")
    return _stated(joined, items.columns)


def _stated(joined: DataFrame, columns: list[str]) -> DataFrame:
    """The items' columns with their state, from ``_last``, ``_kept``, ``_fix`` and theme_id."""
    fixed = F.col("_fix").isNotNull()
    void_reset = fixed & (F.col("_last")["kind"] == "reset") & (F.col("_last")["seq"] > F.col("_fix")["seq"])
    event = F.when(void_reset, F.col("_kept")).otherwise(F.col("_last"))
    kind = event["kind"]
    labelled = kind == "label"

    def label(field: str) -> Column:
        return F.when(labelled, event[field])

    return joined.select(
        *columns,
        F.when(labelled, "classified").when(kind == "fail", "failed").otherwise("new").alias("status"),
        F.when(fixed, F.col("_fix")["fb_type"]).otherwise(label("fb_type")).alias("fb_type"),
        label("product_area").alias("product_area"),
        label("sentiment").alias("sentiment"),
        F.when(fixed, F.col("_fix")["severity"]).otherwise(label("severity")).alias("severity"),
        label("confidence").alias("confidence"),
        fixed.cast("int").alias("human_corrected"),
        "theme_id",
    )


def reset_events(current: DataFrame, seq: int | Column) -> DataFrame:
    """Log rows that make every item new again, except those a human corrected."""
    return current.filter(F.col("human_corrected") == 0).select(
        F.col("id").alias("item_id"),
        (seq if isinstance(seq, Column) else F.lit(seq)).cast("bigint").alias("seq"),
        F.lit("reset").alias("kind"),
        F.lit(None).cast("string").alias("fb_type"),
        F.lit(None).cast("string").alias("product_area"),
        F.lit(None).cast("string").alias("sentiment"),
        F.lit(None).cast("int").alias("severity"),
        F.lit(None).cast("double").alias("confidence"),
        F.lit(None).cast("string").alias("error"),
    )


def unlabeled(items: DataFrame, label_events: DataFrame) -> DataFrame:
    """Ids of the items a label run has to take: no event yet, or a reset as the last one. No text is moved."""
    last = latest(label_events, "item_id", ["kind"], "_last")
    done = last.filter(F.col("_last")["kind"] != "reset").select(F.col("item_id").alias("id"))
    return items.select("id").join(done, "id", "left_anti")
