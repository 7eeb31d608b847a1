"""Labelling: prompts, replies, error classes and the resumable label run."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadsift.functions.keys import body_hash
from roadsift.functions.replies import DECIMAL_NUMBER, WHOLE_NUMBER, label_of, number_of, with_record
from roadsift.functions.text import contains_any
from roadsift.operators.models import Answer, ask, one_of_each_text
from roadsift.schemas import (
    DEFAULT_AREA,
    DEFAULT_SENTIMENT,
    DEFAULT_SEVERITY,
    DEFAULT_TYPE,
    SENTIMENTS,
    SEVERITY_MEANINGS,
    TYPE_MEANINGS,
    WORK_BATCH_SIZE,
)

# Hints by which an error text is recognised, the codes of passing server faults, and the
# keyword rules (words, type, area, sentiment, severity, confidence), tried in this order.
RATE_LIMIT_HINTS = ["429", "rate limit", "rate_limit", "resource_exhausted", "too many requests", "tokens per"]
TRANSIENT_CODES = [500, 502, 503, 504]
TRANSIENT_HINTS = ["500", "502", "503", "504", "overloaded", "unavailable", "timeout"]
KEYWORD_RULES = [
    (["not opening", "crash", "bug", "laggy"], "bug", "general", "negative", 3, 0.6),
    (["how to", "how do"], "question", "onboarding", "neutral", 1, 0.6),
    (["love", "great", "best"], "praise", "general", "positive", 1, 0.7),
]
KEYWORD_DEFAULT = ("other", "general", "neutral", 2, 0.4)
LABEL_FIELDS = ["fb_type", "product_area", "sentiment", "severity", "confidence"]

NO_OBJECT = "no JSON object in the reply"
BROKEN_OBJECT = "the reply's JSON object cannot be read"

PROMPT_HEAD = (
    "Label one piece of user feedback about a B2B SaaS product.\n\n"
    "`type` is exactly one of the following, by these meanings:\n"
    + "\n".join(f"- {name}: {meaning}" for name, meaning in TYPE_MEANINGS.items())
    + "\n\n`severity` is a whole number on this scale:\n"
    + "\n".join(f"{level} = {meaning}" for level, meaning in SEVERITY_MEANINGS.items())
    + "\n\n`area` is the product area in 1-3 words, `sentiment` one of "
    + ", ".join(SENTIMENTS)
    + ",\nand `confidence` how sure you are of the label, from 0.0 to 1.0.\n\n"
    "Answer with a JSON object of this shape and nothing else:\n"
    '{"type": "...", "area": "...", "sentiment": "...", "severity": 0, "confidence": 0.0}\n\n'
    'USER FEEDBACK:\n"""'
)
PROMPT_TAIL = '"""\n'


def label_prompts(items: DataFrame, head: str = PROMPT_HEAD, tail: str = PROMPT_TAIL) -> DataFrame:
    """(id, prompt): the instruction text with the whole body in it."""
    return items.select("id", F.concat(F.lit(head), F.col("body"), F.lit(tail)).alias("prompt"))


def parse_label_replies(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Adds the label fields and ``error``.

    A reply that cannot be read gives the safe label with confidence 0 and an error; so does one that arrived
    with an ``error`` of its own. A NULL reply without an error means there is no answer yet: all fields NULL.
    """
    text, span, record = F.col(reply), F.col("_span"), F.col("_record")
    kept = [name for name in replies.columns if name != "error"]
    own_error = replies.withColumnRenamed("error", "_reported") if "error" in replies.columns else replies
    parsed = with_record(own_error, reply, "type", "area", "sentiment", typed=("severity", "confidence")).withColumns(
        {
            "_severity": number_of(F.col("_record")["severity"], WHOLE_NUMBER),
            "_confidence": number_of(F.col("_record")["confidence"], DECIMAL_NUMBER),
        }
    )
    reported = F.col("_reported") if "error" in replies.columns else F.lit(None).cast("string")
    error = (
        F.when(reported.isNotNull(), reported)
        .when(text.isNull(), F.lit(None))
        .when(span == "", F.lit(NO_OBJECT))
        .when(record.isNull(), F.lit(BROKEN_OBJECT))
    )
    safe = F.struct(
        F.lit(DEFAULT_TYPE).alias("fb_type"),
        F.lit(DEFAULT_AREA).alias("product_area"),
        F.lit(DEFAULT_SENTIMENT).alias("sentiment"),
        F.lit(DEFAULT_SEVERITY).alias("severity"),
        F.lit(0.0).alias("confidence"),
    )
    good = label_of(record, F.col("_severity"), F.col("_confidence"))
    label = F.when(error.isNotNull(), safe).when(text.isNotNull(), good)
    labelled = parsed.select(*kept, error.alias("error"), label.alias("_label"))
    return labelled.select(*kept, *[F.col("_label")[field].alias(field) for field in LABEL_FIELDS], "error")


def keyword_label(body: Column) -> Column:
    """Label struct by keyword rules, for work without a model."""

    def record(fb_type: str, area: str, sentiment: str, severity: int, confidence: float) -> Column:
        return F.struct(
            F.lit(fb_type).alias("fb_type"),
            F.lit(area).alias("product_area"),
            F.lit(sentiment).alias("sentiment"),
            F.lit(severity).alias("severity"),
            F.lit(confidence).alias("confidence"),
        )

    label = None
    for words, *values in KEYWORD_RULES:
        met = contains_any(body, words)
        label = F.when(met, record(*values)) if label is None else label.when(met, record(*values))
    return label.otherwise(record(*KEYWORD_DEFAULT))


def keyword_labels(items: DataFrame) -> DataFrame:
    """(id, label fields) from the body's keywords."""
    labelled = items.select("id", keyword_label(F.col("body")).alias("_label"))
    return labelled.select("id", *[F.col("_label")[field].alias(field) for field in LABEL_FIELDS])


def label_with(
    items: DataFrame,
    answer: Answer | None = None,
    head: str = PROMPT_HEAD,
    tail: str = PROMPT_TAIL,
    partitions: int | None = None,
) -> DataFrame:
    """(id, label fields, error) for every item that got an answer.

    A model is asked once per distinct body; only hashes travel back through the join. Without one the keyword
    rules are used.
    """
    if answer is None:
        return keyword_labels(items).withColumn("error", F.lit(None).cast("string"))
    hashed = items.select("id", "body", body_hash(F.col("body")).alias("body_hash"))
    prompts = one_of_each_text(hashed).select("body_hash", F.concat(F.lit(head), F.col("body"), F.lit(tail)).alias("prompt"))
    replies = answered(ask(prompts, answer, partitions))
    return hashed.select("id", "body_hash").join(parse_label_replies(replies).drop("reply"), "body_hash").drop("body_hash")


def is_rate_limit(error: Column) -> Column:
    return contains_any(error, RATE_LIMIT_HINTS)


def error_class(error: Column, code: Column | None = None) -> Column:
    """rate_limit, transient or permanent; NULL without an error."""
    passing = contains_any(error, TRANSIENT_HINTS)
    if code is not None:
        passing = F.coalesce(code.isin(TRANSIENT_CODES), F.lit(False)) | F.coalesce(passing, F.lit(False))
    present = error.isNotNull() if code is None else error.isNotNull() | code.isNotNull()
    return F.when(
        present,
        F.when(F.coalesce(is_rate_limit(error), F.lit(False)), "rate_limit").when(passing, "transient").otherwise("permanent"),
    )


def answered(replies: DataFrame) -> DataFrame:
    """Replies that settle an item: rate-limited ones and those without an answer leave it new.

    To be applied before parsing, where it costs next to nothing.
    """
    if "error" not in replies.columns:
        return replies.filter(F.col("reply").isNotNull())
    limited = F.coalesce(is_rate_limit(F.col("error")), F.lit(False))
    return replies.filter((F.col("reply").isNotNull() | F.col("error").isNotNull()) & ~limited)


def retries(asked: DataFrame, labelled: DataFrame, seq: int, now: Column, wait: int) -> DataFrame:
    """Log rows for asked items (id, attempt) that got no answer: due again after ``wait`` seconds, twice as many each time."""
    limited = asked.select("id", "attempt").join(labelled.select("id"), "id", "left_anti")
    seconds = F.lit(wait) * F.pow(F.lit(2.0), F.col("attempt"))
    return limited.select(
        F.lit(seq).cast("bigint").alias("seq"),
        F.col("id").cast("bigint").alias("item_id"),
        (F.col("attempt") + 1).cast("int").alias("attempt"),
        F.timestamp_seconds(F.unix_timestamp(now) + seconds).alias("next_at"),
    )


def due_retries(log: DataFrame, label_events: DataFrame, now: Column) -> DataFrame:
    """(id, attempt) of the items whose latest retry is due and that no label run has answered since; no item is scanned."""
    last = log.groupBy("item_id").agg(F.max(F.struct("seq", "attempt", "next_at")).alias("_last"))
    due = last.filter(F.col("_last.next_at") <= now).select(F.col("item_id").alias("id"), F.col("_last.seq").alias("_seq"), F.col("_last.attempt").alias("attempt"))
    answered_since = label_events.select(F.col("item_id").alias("id"), F.col("seq").alias("_answered"))
    known = (due["id"] == answered_since["id"]) & (answered_since["_answered"] >= due["_seq"])
    return due.join(answered_since, known, "left_anti").select("id", "attempt")


def label_events(labelled: DataFrame, seq: int | Column, key: str = "id") -> DataFrame:
    """Log rows for labels of answered items; one with an error, whatever its class, is a failure."""
    failed = F.col("error").isNotNull()
    return labelled.select(
        F.col(key).cast("bigint").alias("item_id"),
        (seq if isinstance(seq, Column) else F.lit(seq)).cast("bigint").alias("seq"),
        F.when(failed, "fail").when(F.col("fb_type").isNotNull(), "label").alias("kind"),
        *[F.when(~failed, F.col(field)).alias(field) for field in LABEL_FIELDS],
        "error",
    )


def work_batch(current: DataFrame, n: int = WORK_BATCH_SIZE) -> DataFrame:
    """Oldest new items; reading it again gives the same rows until labels are stored."""
    new = current.filter(F.col("status") == "new").select("id", "body", "ingested_at")
    return new.orderBy(F.col("ingested_at").asc_nulls_first(), "id").limit(n).select("id", "body")


def label_run_summary(events: DataFrame, seq: int | None = None) -> DataFrame:
    """Numbers of labelled and failed items, of one run or of all."""
    run = events if seq is None else events.filter(F.col("seq") == seq)
    return run.agg(
        F.count_if(F.col("kind") == "label").alias("classified"), F.count_if(F.col("kind") == "fail").alias("failed")
    )
