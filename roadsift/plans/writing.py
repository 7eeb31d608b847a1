"""Runs in which a model writes or judges: documents, the weekly brief, the memo, and evaluations.

Prompts and answers are rows; a model is asked in Arrow batches, and its answers are written before anything is made of them,
so they are paid for once. What a run stores is the newest version of its documents; rows whose model failed store nothing
and are returned with their error.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadsift.operators import citations, drift, evaluation, scoring
from roadsift.operators.models import Answer, ask
from roadsift.plans import packs
from roadsift.session import written
from roadsift.sources.documents import write_docs
from roadsift.sources.tables import newest_run, read_current, read_table


def answered(given: DataFrame, answer: Answer, partitions: int | None = None) -> DataFrame:
    """Packs (any keys, pack) with the model's ``reply`` and ``error``; an empty reply is an error."""
    replies = ask(given.withColumnRenamed("pack", "prompt"), answer, partitions)
    empty = F.col("reply").isNull() | (F.trim("reply") == "")
    return written(replies.withColumn("error", F.when(empty, F.coalesce("error", F.lit("no reply")))))


def theme_documents(
    opportunities: DataFrame, themes: DataFrame, items: DataFrame, answer: Answer, guidance: str = "", partitions: int | None = None
) -> DataFrame:
    """theme_id, markdown (the draft with its verified citations) and error per opportunity."""
    drafts = answered(packs.theme_pack(opportunities, themes, items, guidance), answer, partitions)
    good = drafts.filter("error IS NULL").select("theme_id", F.col("reply").alias("markdown"))
    reports = citations.verification_report(citations.check_theme_documents(good, items, themes), "theme_id")
    return drafts.select("theme_id", "error").join(reports, "theme_id", "left").select("theme_id", "markdown", "error")


def review_documents(
    ids: DataFrame, items: DataFrame, themes: DataFrame, answer: Answer, guidance: str = "", partitions: int | None = None
) -> DataFrame:
    """item_id, markdown and error for each classified item of ``ids`` (id)."""
    wanted = packs.review_pack(items, themes, guidance).join(ids.select("id").distinct(), "id", "left_semi")
    drafts = answered(wanted, answer, partitions).withColumnRenamed("id", "item_id")
    good = drafts.filter("error IS NULL").select("item_id", F.col("reply").alias("markdown"))
    reports = citations.verification_report(citations.check_review_documents(good, items, themes), "item_id")
    return drafts.select("item_id", "error").join(reports, "item_id", "left").select("item_id", "markdown", "error")


def brief_document(items: DataFrame, themes: DataFrame, opportunities: DataFrame, answer: Answer | None = None) -> DataFrame:
    """The weekly brief (target_kind, target_id, markdown); without a model, or if it fails, without a summary."""
    sections = written(drift.brief_sections(drift.drift(items, themes), scoring.top_opportunity(opportunities, themes)))
    if answer is None:
        return drift.brief_markdown(sections)
    told = answered(drift.brief_pack(sections), answer).select(F.when(F.col("error").isNull(), F.col("reply")).alias("reply"))
    return drift.brief_markdown(sections, told)


def memo_document(roadmap: DataFrame, roles: DataFrame, answer: Answer, decide: Answer | None = None) -> DataFrame:
    """The memo (target_kind, target_id, markdown): every role (position, role, mandate) speaks, then one decides.

    A role whose model failed is left out.
    """
    roadmap = written(roadmap.select("roadmap"))
    spoken = answered(packs.opinion_packs(roadmap, roles), answer)
    opinions = spoken.filter("error IS NULL").select("position", "role", F.col("reply").alias("opinion"))
    decision = answered(packs.decision_pack(roadmap, opinions), decide or answer)
    return packs.memo_markdown(roadmap, opinions, decision)


def judged_golden(golden: DataFrame, items: DataFrame, answer: Answer, partitions: int | None = None) -> DataFrame:
    """``evaluation.certify`` with verdicts that a model gives on the items of labelled golden rows."""
    human = evaluation.labelled_golden(golden).select(F.col("id").try_cast("bigint").alias("id"))
    judged = items.filter(F.col("status") == "classified").join(human, "id", "left_semi")
    return evaluation.certify(golden, items, written(evaluation.judge_with(judged, answer, partitions)))


def judged_sample(items: DataFrame, answer: Answer, n: int = 50, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """``evaluation.judged_sample`` with verdicts that a model gives on a random sample."""
    sample = written(evaluation.sample_items(items, n, seed))
    return evaluation.judged_sample(sample, written(evaluation.judge_with(sample, answer, partitions)))


# The same over the engine's tables


def _state(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The current items, the newest themes and their newest scores."""
    themes, scores = (newest_run(read_table(spark, directory, name)) for name in ("themes", "opportunities"))
    return read_current(spark, directory), themes, scores


def write_theme_documents(spark: SparkSession, directory: str, answer: Answer, guidance: str = "", partitions: int | None = None) -> DataFrame:
    """Stores a document per scored theme; returns the themes whose model failed (theme_id, error)."""
    items, themes, scores = _state(spark, directory)
    made = written(theme_documents(scores, themes, items, answer, guidance, partitions))
    write_docs(made.filter("error IS NULL").select(F.lit("theme").alias("target_kind"), F.col("theme_id").alias("target_id"), "markdown"), directory)
    return made.filter("error IS NOT NULL").select("theme_id", "error")


def write_review_documents(
    spark: SparkSession, directory: str, ids: DataFrame, answer: Answer, guidance: str = "", partitions: int | None = None
) -> DataFrame:
    """Stores a document per asked item; returns the items whose model failed (item_id, error)."""
    items, themes, _ = _state(spark, directory)
    made = written(review_documents(ids, items, themes, answer, guidance, partitions))
    write_docs(made.filter("error IS NULL").select(F.lit("review").alias("target_kind"), F.col("item_id").alias("target_id"), "markdown"), directory)
    return made.filter("error IS NOT NULL").select("item_id", "error")


def write_brief(spark: SparkSession, directory: str, answer: Answer | None = None) -> None:
    """Stores the weekly brief."""
    items, themes, scores = _state(spark, directory)
    write_docs(brief_document(items, themes, scores, answer), directory)


def write_memo(spark: SparkSession, directory: str, roles: DataFrame, answer: Answer, decide: Answer | None = None) -> None:
    """Stores the memo on the newest roadmap."""
    _, themes, scores = _state(spark, directory)
    write_docs(memo_document(scoring.roadmap_text(scores, themes), roles, answer, decide), directory)
