"""Table schemas and the label taxonomy."""

from pyspark.sql import types as T

# The label taxonomy, its meanings, and the record defaults.
TYPE_MEANINGS = {
    "bug": "something is broken: crashes, errors, freezes, data loss, or it doesn't work as intended",
    "feature_request": "the user wants a capability that doesn't exist yet",
    "ux_friction": "it works, but it's confusing, clunky, slow, or harder to use than it should be",
    "pricing": "about cost, plans, billing, paywalls, or value-for-money",
    "praise": "positive feedback with no problem to fix",
    "churn_risk": "the user EXPLICITLY signals they are leaving: canceling, uninstalling, switching to a "
    "competitor, or demanding a refund. Anger or frustration ALONE is NOT churn_risk — there must be a clear "
    "exit signal",
    "question": "the user asks how to do something, or is confused about an existing feature (a docs/onboarding gap)",
    "other": "genuinely none of the above",
}
FEEDBACK_TYPES = list(TYPE_MEANINGS)
SENTIMENTS = ["positive", "neutral", "negative"]
SEVERITY_MEANINGS = {
    1: "minor (cosmetic, mild annoyance)",
    2: "moderate (slows the user down, has a workaround)",
    3: "major (blocks an important task, no easy workaround)",
    4: "critical (app unusable, data loss, or user is explicitly churning)",
}
SEVERITY_LABELS = {1: "1 · minor", 2: "2 · moderate", 3: "3 · major", 4: "4 · critical"}
DEFAULT_TYPE, DEFAULT_AREA, DEFAULT_SENTIMENT = "other", "unknown", "neutral"
DEFAULT_SEVERITY, DEFAULT_CONFIDENCE = 2, 0.5
MIN_BODY_CHARS = 20
AREA_CHARS = 50
DEFAULT_EFFORT = 2.0
EVIDENCE_POOL_SIZE = 30
SIBLING_COUNT = 6
NAMING_SAMPLE_SIZE, NAMING_SAMPLE_CHARS = 12, 160
WORK_BATCH_SIZE = 15
GOLDEN_PER_TYPE = 25
WINDOW_DAYS = 7

ITEMS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("external_id", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("rating", T.IntegerType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("ingested_at", T.TimestampType()),
        T.StructField("import_no", T.LongType()),
    ]
)

LABEL_EVENTS = T.StructType(
    [
        T.StructField("item_id", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("kind", T.StringType()),  # label | fail | reset
        T.StructField("fb_type", T.StringType()),
        T.StructField("product_area", T.StringType()),
        T.StructField("sentiment", T.StringType()),
        T.StructField("severity", T.IntegerType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("error", T.StringType()),
    ]
)

RETRIES = T.StructType(
    [
        T.StructField("seq", T.LongType()),  # the label run that was limited
        T.StructField("item_id", T.LongType()),
        T.StructField("attempt", T.IntegerType()),  # how often the item was limited
        T.StructField("next_at", T.TimestampType()),
    ]
)

CORRECTIONS = T.StructType(
    [
        T.StructField("item_id", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("fb_type", T.StringType()),
        T.StructField("severity", T.IntegerType()),
    ]
)

THEMES = T.StructType(
    [
        T.StructField("run_id", T.LongType()),
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("summary", T.StringType()),
    ]
)

ASSIGNMENTS = T.StructType(
    [
        T.StructField("run_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("theme_id", T.LongType()),
    ]
)

OPPORTUNITIES = T.StructType(
    [
        T.StructField("run_id", T.LongType()),
        T.StructField("theme_id", T.LongType()),
        T.StructField("reach", T.LongType()),
        T.StructField("impact", T.DoubleType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("effort", T.DoubleType()),
        T.StructField("rice_score", T.DoubleType()),
    ]
)

DOCUMENTS = T.StructType(
    [
        T.StructField("target_kind", T.StringType()),  # theme | review | brief | memo
        T.StructField("target_id", T.LongType()),
        T.StructField("markdown", T.StringType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

GOLDEN = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("gold_type", T.StringType()),
        T.StructField("gold_severity", T.StringType()),
        T.StructField("gold_sentiment", T.StringType()),
        T.StructField("gold_notes", T.StringType()),
    ]
)

FEATURE_CACHE = T.StructType(
    [
        T.StructField("body_hash", T.StringType()),
        T.StructField("features", T.ArrayType(T.FloatType())),
    ]
)
