"""Label quality: golden rows, judge verdicts, accuracy and correction rates."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadsift.functions.replies import truthy, with_record
from roadsift.functions.text import blank_to_null, cut, shown, strip
from roadsift.operators.labels import BROKEN_OBJECT
from roadsift.operators.models import Answer, ask
from roadsift.operators.ranking import attach, seeded_sample, top_per_group
from roadsift.operators.small import MAX_SMALL_ROWS, hinted
from roadsift.schemas import FEEDBACK_TYPES, GOLDEN_PER_TYPE

REASONING_CHARS = 300

JUDGE_HEAD = (
    "Check one label of a feedback classifier. Be strict.\n\n"
    "Types it may assign: " + ", ".join(FEEDBACK_TYPES) + '\n\nUser review:\n"""'
)
JUDGE_MIDDLE = '"""\n\nAssigned type: '
JUDGE_TAIL = (
    "\n\nAnswer with this JSON and nothing else:\n"
    '{"type_correct": true, "suggested_type": "...", "reasoning": "..."}\n'
)


def golden_sample(items: DataFrame, per_type: int = GOLDEN_PER_TYPE) -> DataFrame:
    """First items of every predicted type, prefilled with the prediction for a human to correct."""
    labelled = items.filter((F.col("status") == "classified") & F.col("fb_type").isNotNull())
    picked = top_per_group(labelled.select("id", "fb_type", "severity"), "fb_type", [F.col("id")], per_type)
    few = len(FEEDBACK_TYPES) * per_type <= MAX_SMALL_ROWS  # labels have no other types
    return (
        attach(picked, labelled, ["body"], few, per_type)
        .select(
            "id",
            "body",
            F.col("fb_type").alias("gold_type"),
            F.col("severity").alias("gold_severity"),
            F.lit("").alias("gold_notes"),
        )
        .orderBy("id")
    )


def judge_prompts(items: DataFrame) -> DataFrame:
    """(id, fb_type, prompt) asking a judge whether the assigned type fits."""
    prompt = F.concat(F.lit(JUDGE_HEAD), F.col("body"), F.lit(JUDGE_MIDDLE), shown(F.col("fb_type")), F.lit(JUDGE_TAIL))
    return items.select("id", "fb_type", prompt.alias("prompt"))


def parse_verdicts(replies: DataFrame, reply: str = "reply", assigned: str = "fb_type") -> DataFrame:
    """Adds type_correct, suggested_type, reasoning and error.

    A reply that cannot be read gives no verdict, keeps the assigned type as the suggestion and has an error.
    A NULL reply is a judge that did not answer, which is an error too: the given one, if there is an ``error``.
    """
    given = F.col("_reported") if "error" in replies.columns else F.lit(None).cast("string")
    replies = replies.withColumnRenamed("error", "_reported")
    kept = [name for name in replies.columns if name != "_reported"]
    parsed = with_record(replies, reply, "suggested_type", "reasoning", typed=("type_correct",))
    record, read = F.col("_record"), F.col("_record").isNotNull() & given.isNull()
    error = F.when(~read, F.coalesce(given, F.lit(BROKEN_OBJECT)))
    return parsed.select(
        *kept,
        F.when(read, truthy(record["type_correct"])).alias("type_correct"),
        F.coalesce(F.when(read, record["suggested_type"]), F.col(assigned)).alias("suggested_type"),
        F.when(read, cut(F.coalesce(record["reasoning"], F.lit("")), REASONING_CHARS))
        .otherwise(F.concat(F.lit("judge error: "), error))
        .alias("reasoning"),
        error.alias("error"),
    )


def judge_with(items: DataFrame, answer: Answer, partitions: int | None = None) -> DataFrame:
    """(item_id, fb_type, type_correct, suggested_type, reasoning, error) by a model that judges every given item."""
    replies = ask(judge_prompts(items), answer, partitions).withColumnRenamed("id", "item_id")
    return parse_verdicts(replies).drop("reply")


def labelled_golden(golden: DataFrame) -> DataFrame:
    """Golden rows a human has labelled."""
    return golden.filter(blank_to_null(F.col("gold_type")).isNotNull())


def certify(golden: DataFrame, items: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Per golden row: does the judge agree with the human about the classifier's type?

    ``verdicts(item_id, type_correct)``; rows without an item or with a failed verdict are left out.
    """
    human = labelled_golden(golden).select(
        F.col("id").try_cast("bigint").alias("id"), strip(F.col("gold_type")).alias("gold_type")
    )
    judged = verdicts.filter(F.col("type_correct").isNotNull()).select(F.col("item_id").alias("id"), "type_correct")
    joined = items.select("id", "fb_type").join(hinted(human, human), "id").join(judged, "id")
    human_correct = F.coalesce(F.col("gold_type") == F.col("fb_type"), F.lit(False))
    match = F.col("type_correct") == human_correct
    return joined.select(
        "id",
        F.col("fb_type").alias("predicted"),
        "gold_type",
        human_correct.alias("human_correct"),
        F.col("type_correct").alias("judge_correct"),
        F.when(match, "MATCH").otherwise("MISMATCH").alias("result"),
    )


def agreement(certified: DataFrame) -> DataFrame:
    """One row: agree, counted and their ratio (NULL if nothing was comparable)."""
    counted = certified.agg(
        F.count_if(F.col("result") == "MATCH").alias("agree"), F.count(F.lit(1)).alias("counted")
    )
    return counted.withColumn("agreement", F.try_divide(F.col("agree").cast("double"), F.col("counted")))


def sample_items(items: DataFrame, n: int = 50, seed: int = 42) -> DataFrame:
    """Random classified items for a judge."""
    return seeded_sample(items.filter(F.col("status") == "classified").select("id", "body", "fb_type"), n, seed)


def judged_sample(sample: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdict per sampled item: ok, flagged with the suggested type, or a judge error."""
    answers = verdicts.select(F.col("item_id").alias("id"), "type_correct", "suggested_type")
    note = (
        F.when(F.col("type_correct"), F.lit("ok"))
        .when(~F.col("type_correct"), F.concat(F.lit("FLAG -> suggests "), F.col("suggested_type")))
        .otherwise(F.lit("judge error"))
    )
    return sample.join(answers, "id", "left").select("id", "fb_type", "type_correct", "suggested_type", note.alias("note"))


def sampled_accuracy(judged: DataFrame) -> DataFrame:
    """One row: correct, wrong, errors and the accuracy over judged items (NULL if none)."""
    counts = judged.agg(
        F.count_if(F.col("type_correct")).alias("correct"),
        F.count_if(~F.col("type_correct")).alias("wrong"),
        F.count_if(F.col("type_correct").isNull()).alias("errors"),
    )
    seen = F.col("correct") + F.col("wrong")
    return counts.withColumn("accuracy", F.try_divide(F.col("correct").cast("double"), seen))


def golden_accuracy(golden: DataFrame, items: DataFrame) -> DataFrame:
    """Type and severity accuracy against the golden rows, per predicted type and overall (NULL type)."""
    human = labelled_golden(golden).select(
        F.col("id").try_cast("bigint").alias("id"),
        strip(F.col("gold_type")).alias("gold_type"),
        F.col("gold_severity").try_cast("int").alias("gold_severity"),
    )
    matched = items.select("id", "fb_type", "severity").join(hinted(human, human), "id").select(
        "fb_type",
        (F.col("gold_type") == F.col("fb_type")).alias("type_match"),
        (F.col("gold_severity") == F.col("severity")).alias("severity_match"),
    )

    def rate(match: str):
        return F.try_divide(F.count_if(F.col(match)).cast("double"), F.count(match))

    return (
        matched.filter(F.col("fb_type").isNotNull())
        .rollup("fb_type")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            rate("type_match").alias("type_accuracy"),
            rate("severity_match").alias("severity_accuracy"),
        )
    )


def correction_rate(items: DataFrame) -> DataFrame:
    """One row: share of classified items a human corrected, and share of all items that have a theme."""
    classified = F.col("status") == "classified"
    return items.agg(
        F.try_divide(
            F.count_if(classified & (F.col("human_corrected") == 1)).cast("double"), F.count_if(classified)
        ).alias("correction_rate"),
        F.try_divide(F.count("theme_id").cast("double"), F.count(F.lit(1))).alias("themed_share"),
    )
