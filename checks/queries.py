"""Every registered query: the engine's operators over the driver tables."""

import re
from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixtures import table, view
from roadsift.functions.numbers import round_even, theme_count
from roadsift.operators import citations, drift, evaluation, ingest, kmeans, labels, ranking, scoring, state, themes
from roadsift.plans import overview, packs, runs, writing
from roadsift.session import shared_folder
from roadsift.sources import buckets, documents, feedback_csv, golden, reviews, tables
from roadsift.streaming import daily
from roadsift.streaming import ingest as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


class Inputs:
    """The views and tables of one data directory by name."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory
        self.registered: set[str] = set()

    def __getattr__(self, name: str) -> DataFrame:
        frame = view(self.spark, self.directory, name, self.registered)
        setattr(self, name, frame)  # read once per query
        return frame

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.directory, name)


def query(build: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    """Registers a function of the inputs under its name."""

    def run(spark: SparkSession, directory: str) -> DataFrame:
        return build(Inputs(spark, directory))

    QUERIES[build.__name__] = run
    return build


def _opportunities(given: Inputs) -> DataFrame:
    return scoring.rice(given.feedback_items, given.themes)


# Roadmap


@query
def rice_roadmap(given):
    return scoring.roadmap(_opportunities(given), given.themes)


@query
def rice_with_efforts(given):
    return scoring.rice(given.feedback_items, given.themes, given.efforts)


@query
def top_opportunity(given):
    return scoring.top_opportunity(_opportunities(given), given.themes)


@query
def opportunity_lookup(given):
    return scoring.opportunity_of(_opportunities(given), given.themes, 3)


@query
def roadmap_lines(given):
    return scoring.roadmap_lines(_opportunities(given), given.themes)


@query
def roadmap_text(given):
    return scoring.roadmap_text(_opportunities(given), given.themes)


@query
def landscape(given):
    return scoring.landscape(_opportunities(given), given.themes)


@query
def score_printout(given):
    return scoring.score_printout(_opportunities(given), given.themes)


# Drift


def _drift(given: Inputs) -> DataFrame:
    return drift.drift(given.feedback_items, given.themes)


@query
def drift_table(given):
    return _drift(given).withColumn("anchor", F.col("anchor").cast("string"))


@query
def drift_printout(given):
    return drift.drift_lines(_drift(given))


@query
def drift_brief(given):
    top = scoring.top_opportunity(_opportunities(given), given.themes)
    return drift.brief_sections(_drift(given), top)


@query
def brief_document(given):
    top = scoring.top_opportunity(_opportunities(given), given.themes)
    return drift.brief_markdown(drift.brief_sections(_drift(given), top), "Ship it.").select("target_kind", "markdown")


# Overview


@query
def kpi_counts(given):
    return overview.kpis(given.feedback_items, _opportunities(given))


@query
def funnel(given):
    return overview.funnel(overview.kpis(given.feedback_items, given.themes))


@query
def type_mix(given):
    return overview.mix(given.feedback_items, "fb_type")


@query
def sentiment_mix(given):
    return overview.mix(given.feedback_items, "sentiment")


@query
def severity_mix(given):
    return overview.severity_mix(given.feedback_items)


@query
def severity_labels(given):
    return given.feedback_items.select("id", overview.severity_label().alias("label"))


@query
def rating_hist(given):
    return overview.histogram(given.feedback_items, "rating")


@query
def status_hist(given):
    return overview.histogram(given.feedback_items, "status")


@query
def review_queue(given):
    return overview.review_queue(given.feedback_items)


@query
def review_picker(given):
    return overview.review_picker(given.feedback_items)


@query
def work_batch(given):
    return labels.work_batch(given.feedback_items)


@query
def low_rating_sample(given):
    return overview.low_ratings(given.feedback_items)


@query
def theme_drilldown(given):
    return overview.theme_drilldown(given.feedback_items, given.themes)


@query
def theme_headers(given):
    return overview.theme_headers(given.feedback_items, given.themes)


@query
def data_sanity(given):
    return overview.data_sanity(given.feedback_items, labels.work_batch(given.feedback_items, 5))


@query
def actionable_items(given):
    return themes.actionable(given.feedback_items).select("id", "body", "product_area")


@query
def item_lookup(given):
    sql = "SELECT id, body, fb_type, severity, product_area, theme_id FROM {items} WHERE id = :wanted"
    return given.spark.sql(sql, args={"wanted": 42}, items=given.feedback_items)


# Ingest


@query
def ingest_filter(given):
    return ingest.filter_usable(given.plain_items).select("id", "source", "external_id")


@query
def ingest_normalize(given):
    normalized = ingest.filter_usable(reviews.normalize_reviews(given.raw_reviews))
    return normalized.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


def _stored(given: Inputs) -> DataFrame:
    """Items with a human label count as stored already."""
    marked = given.table("labels").select(F.col("doc_id").alias("id"))
    return given.plain_items.join(marked, "id", "left_semi")


@query
def ingest_dedup(given):
    fresh = ingest.dedup_new(ingest.filter_usable(given.plain_items), _stored(given), [F.col("id")])
    return fresh.select("id", "source", "external_id")


@query
def ingest_dedup_keyless(given):
    keyless = given.plain_items.withColumn("external_id", F.when(F.col("source") != "en", F.col("external_id")))
    return ingest.dedup_new(keyless, _stored(given), [F.col("id")]).select("id", "source", "external_id")


@query
def ingest_counts(given):
    usable = ingest.filter_usable(given.plain_items)
    inserted = ingest.dedup_new(usable, _stored(given), [F.col("id")])
    return ingest.ingest_counts(given.plain_items, usable, inserted)


@query
def csv_import(given):
    """Writes the documents as CSV files and imports them."""
    path = shared_folder(given.spark)
    outgoing = given.table("documents").select(
        F.col("text").alias("body"), F.col("lang").alias("author"), (F.col("n_chars") / 10).alias("rating"), "doc_id"
    )
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    outgoing.write.options(header=True, quote='"', escape='"', **keep).csv(path)
    usable = ingest.filter_usable(feedback_csv.read_feedback_csv(given.spark, path))
    none_stored = given.spark.createDataFrame([], "source string, external_id string")
    fresh = ingest.dedup_new(usable, none_stored, [F.col("ingest_order")])
    return fresh.select("source", "author", "rating", F.md5("body").alias("body_md5"))


# Labels


@query
def label_prompts(given):
    return labels.label_prompts(given.plain_items).select("id", F.md5("prompt").alias("prompt_md5"))


@query
def judge_prompts(given):
    classified = given.feedback_items.filter("status = 'classified'")
    return evaluation.judge_prompts(classified).select("id", F.md5("prompt").alias("prompt_md5"))


@query
def reply_parse(given):
    parsed = labels.parse_label_replies(given.replies)
    return parsed.select("item_id", "error")


@query
def reply_validate(given):
    return labels.parse_label_replies(given.replies).drop("reply", "error")


@query
def huge_numbers(given):
    """Replies with numbers near and beyond the largest double."""
    numbers = F.array(*map(F.lit, ["1e301", "-1e305", "1e308", '"1e308"', '"2"', "7e-310"]))
    number = F.get(numbers, (F.col("item_id") % 6).cast("int"))
    reply = F.concat(F.lit('{"type": "bug", "severity": '), number, F.lit(', "confidence": '), number, F.lit("}"))
    replies = given.replies.select("item_id", reply.alias("reply"))
    return labels.parse_label_replies(replies).select("item_id", "severity", "confidence")


@query
def keyword_labels(given):
    return labels.keyword_labels(given.plain_items)


@query
def hooked_labels(given):
    """A labelling function called per distinct text; it answers by length."""

    def answer(prompts):
        size = [len(prompt) for prompt in prompts]
        return [
            ('{"type": "bug", "severity": 3, "confidence": 1}' if n % 2 else None, None if n % 2 else "503 overloaded")
            for n in size
        ]

    return labels.label_with(given.plain_items, answer, head="", tail="").select("id", "fb_type", "severity", "error")


@query
def error_classes(given):
    kind = labels.error_class(F.col("message"), F.col("code"))
    return given.failures.select("id", labels.is_rate_limit(F.col("message")).alias("rate_limit"), kind.alias("kind"))


def _events(given: Inputs) -> DataFrame:
    return labels.label_events(labels.parse_label_replies(labels.answered(given.replies)), 7, key="item_id")


@query
def label_run_events(given):
    return _events(given).drop("error")


@query
def label_run_summary(given):
    return labels.label_run_summary(_events(given))


@query
def unlabeled_items(given):
    return state.unlabeled(given.plain_items, given.label_log)


def _current(given: Inputs) -> DataFrame:
    corrections = state.correction_events(given.edits, F.col("seq"))
    return state.current_items(given.plain_items, given.label_log, corrections, given.theme_runs)


@query
def current_state(given):
    return _current(given).drop("body", "external_id", "source")


@query
def reset_state(given):
    items = given.feedback_items.select("id", "human_corrected")
    return state.reset_events(items, 99).select("item_id", "seq", "kind")


@query
def corrections_current(given):
    corrections = state.correction_events(given.edits, F.col("seq"))
    last = state.latest(corrections, "item_id", ["fb_type", "severity"], "fix")
    return last.select("item_id", F.col("fix")["fb_type"].alias("fb_type"), F.col("fix")["severity"].alias("severity"))


# Evaluation


@query
def golden_sample(given):
    return evaluation.golden_sample(given.feedback_items)


@query
def golden_files(given):
    """Writes the golden sample as CSV and reads it back."""
    path = shared_folder(given.spark)
    golden.write_golden(evaluation.golden_sample(given.feedback_items), path)
    back = golden.read_golden(given.spark, path)
    return back.select(
        F.col("id").cast("bigint").alias("id"), F.md5("body").alias("body_md5"), "gold_type", "gold_severity", "gold_sentiment"
    )


@query
def verdict_parse(given):
    return evaluation.parse_verdicts(given.verdict_replies).drop("reply")


@query
def judge_certify(given):
    return evaluation.certify(given.golden, given.feedback_items, given.verdicts)


@query
def judge_agreement(given):
    return evaluation.agreement(evaluation.certify(given.golden, given.feedback_items, given.verdicts))


@query
def judge_sample(given):
    sample = evaluation.sample_items(given.feedback_items)
    return evaluation.judged_sample(sample, given.verdicts)


@query
def sampled_accuracy(given):
    sample = evaluation.sample_items(given.feedback_items)
    return evaluation.sampled_accuracy(evaluation.judged_sample(sample, given.verdicts))


@query
def golden_accuracy(given):
    return evaluation.golden_accuracy(given.golden, given.feedback_items)


@query
def correction_rate(given):
    return evaluation.correction_rate(given.feedback_items)


# Themes


def _members(given: Inputs) -> DataFrame:
    return given.feedback_items.filter("theme_id IS NOT NULL")


@query
def cache_misses(given):
    cached = _stored(given).select(F.sha2("body", 256).alias("body_hash"))
    return themes.cache_misses(given.plain_items, cached).select("body_hash", F.md5("body").alias("body_md5"))


@query
def cached_vectors(given):
    """Features of a text are its length; a cache holds them once per distinct text."""
    nothing = given.spark.createDataFrame([], "body_hash string")
    misses = themes.cache_misses(given.plain_items, nothing)
    cache = themes.compute_features(misses, lambda texts: [[len(text), 1.0] for text in texts])
    hashed = given.plain_items.select("id", F.sha2("body", 256).alias("body_hash"))
    joined = hashed.join(cache, "body_hash")
    return joined.select("id", F.get("features", F.lit(0)).cast("double").alias("chars"))


@query
def theme_k(given):
    counted = themes.actionable(given.feedback_items).agg(F.count(F.lit(1)).alias("items"))
    return counted.withColumn("k", theme_count(F.col("items")))


@query
def theme_top_area(given):
    return themes.top_areas(_members(given))


@query
def theme_names(given):
    return themes.name_themes(_members(given), given.name_replies)


@query
def theme_sample_text(given):
    return themes.theme_samples(_members(given), given.themes)


@query
def theme_centroids(given):
    vectors = given.table("embeddings").select(F.col("label").alias("theme_id"), F.col("embedding").alias("features"))
    flat = themes.centroids(vectors).select("theme_id", F.posexplode("centroid").alias("pos", "mean"))
    return flat.select("theme_id", "pos", round_even(F.col("mean"), 6).alias("mean"))


@query
def nearest_centroid(given):
    vectors = given.table("embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").alias("theme_id"), F.col("embedding").alias("features")
    )
    return themes.nearest_centroid(vectors, themes.centroids(vectors))


def _unit(given: Inputs) -> DataFrame:
    vectors = given.table("embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").alias("cluster"), F.col("embedding").alias("features")
    )
    return themes.unit_vectors(vectors)


@query
def kmeans_themes(given):
    """Every item's cluster in the cheapest of the ten starts, with that start and its cost; equal to the last bit."""
    vectors = given.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"))
    model = kmeans.fit(vectors, 8, list(themes.SEEDS))
    return kmeans.assigned(vectors, model).select("id", "cluster", F.lit(model.seed).cast("bigint").alias("start"), F.lit(str(model.cost)).alias("cost"))


@query
def silhouette(given):
    """Of the clustering that the vectors' labels give."""
    value = themes.silhouette(_unit(given))
    return given.spark.createDataFrame([(round(value, 6),)], "silhouette double")


# Citations and documents


@query
def evidence_top30(given):
    return citations.evidence_pool(given.feedback_items, given.themes)


@query
def siblings(given):
    return citations.siblings(given.feedback_items, given.themes)


@query
def sibling_preview(given):
    return packs.sibling_preview(given.feedback_items, given.themes)


@query
def citation_check(given):
    checked = citations.check_theme_documents(given.theme_drafts, given.feedback_items, given.themes)
    return citations.citation_counts(checked, "theme_id", "draft")


@query
def citation_ids(given):
    checked = citations.check_theme_documents(given.theme_drafts, given.feedback_items, given.themes)
    return checked.select(
        "theme_id",
        "draft",
        *[F.array_join(F.col(name).cast("array<string>"), ",").alias(name) for name in ("cited", "valid", "hallucinated")],
    )


@query
def overlong_citations(given):
    """Cited numbers of 26 digits and more, and with leading zeros."""
    number = F.col("id").cast("string")
    markdown = F.concat(F.lit("[#00"), number, F.lit("] [#"), F.repeat(F.lit("9"), F.lit(25)), number, F.lit("] [#1"), F.repeat(F.lit("0"), F.lit(25)), number, F.lit("]"))
    checked = citations.check_citations(given.plain_items.select("id", markdown.alias("markdown")), F.array("id"))
    return checked.select("id", *[F.array_join(name, ",").alias(name) for name in ("cited", "valid", "hallucinated")])


@query
def review_citation_check(given):
    checked = citations.check_review_documents(given.review_drafts, given.feedback_items, given.themes)
    return citations.citation_counts(checked, "item_id")


@query
def citation_report(given):
    checked = citations.check_theme_documents(given.theme_drafts, given.feedback_items, given.themes)
    return citations.verification_report(checked, "theme_id", "draft")


@query
def review_report(given):
    checked = citations.check_review_documents(given.review_drafts, given.feedback_items, given.themes)
    return citations.verification_report(checked, "item_id")


@query
def report_counters(given):
    return citations.report_counters(given.reports, "doc_id")


@query
def quote_check(given):
    checked = citations.check_quotes(given.quoting_drafts, given.plain_items, "doc_id")
    return checked.withColumn("item_id", F.col("item_id").cast("bigint"))


@query
def theme_pack(given):
    return packs.theme_pack(_opportunities(given), given.themes, given.feedback_items, "  Android first ")


@query
def review_pack(given):
    return packs.review_pack(given.feedback_items, given.themes)


def _panel(given: Inputs) -> tuple[DataFrame, DataFrame]:
    """The roadmap text, and one opinion per feedback type."""
    by_type = overview.mix(given.feedback_items, "fb_type")
    opinions = by_type.select(
        F.col("fb_type").alias("position"),
        F.col("fb_type").alias("role"),
        F.concat(F.col("items").cast("string"), F.lit(" items")).alias("opinion"),
    )
    return scoring.roadmap_text(_opportunities(given), given.themes), opinions


@query
def memo_document(given):
    return packs.memo_markdown(*_panel(given), "Done.").select("target_kind", "markdown")


@query
def decision_pack(given):
    return packs.decision_pack(*_panel(given))


@query
def opinion_packs(given):
    roadmap, opinions = _panel(given)
    return packs.opinion_packs(roadmap, opinions.withColumnRenamed("opinion", "mandate"))


@query
def brief_pack(given):
    top = scoring.top_opportunity(_opportunities(given), given.themes)
    return drift.brief_pack(drift.brief_sections(_drift(given), top))


@query
def hooked_verdicts(given):
    """A judging function that approves prompts of even length and fails on the others."""

    def answer(prompts):
        return [('{"type_correct": true}', None) if len(p) % 2 == 0 else (None, "quota") for p in prompts]

    classified = given.feedback_items.filter("status = 'classified'")
    return evaluation.judge_with(classified, answer).select("item_id", "fb_type", "type_correct", "error")


@query
def theme_docs(given):
    scored = _opportunities(given).select("theme_id", "rice_score")
    return documents.with_documents(scored, given.versions)


@query
def report_files(given):
    """Writes one text file per report and reads the files back."""
    path = shared_folder(given.spark)
    checked = citations.check_theme_documents(given.theme_drafts, given.feedback_items, given.themes)
    reports = citations.verification_report(checked, "theme_id", "draft")
    number = (F.col("theme_id") * 1_000_000 + F.col("draft")).alias("target_id")
    documents.write_text(reports.select(F.lit("theme").alias("target_kind"), number, "markdown"), path)
    return citations.report_counters(documents.read_text(given.spark, path), "target_id")


# Runs in which a model writes or judges; the models here are stubs that work by rule


def _citing(prompts):
    """A writer that cites all it was shown and an item that is not there, and fails on one theme."""
    replies = [f"Plan: {' '.join(re.findall(r'\[#[0-9]+\]', prompt))} and [#999999999]" for prompt in prompts]
    return [(None, "quota") if "about: theme 3\n" in prompt else (reply, None) for prompt, reply in zip(prompts, replies)]


def _approving(prompts):
    """A judge that approves prompts of even length and fails on the others."""
    return [('{"type_correct": true}', None) if len(prompt) % 2 == 0 else (None, "quota") for prompt in prompts]


@query
def theme_document_run(given):
    return writing.theme_documents(_opportunities(given), given.themes, given.feedback_items, _citing)


@query
def review_document_run(given):
    items = given.feedback_items
    return writing.review_documents(items.select("id"), items, given.themes, _citing)


@query
def brief_run(given):
    made = writing.brief_document(given.feedback_items, given.themes, _opportunities(given), lambda prompts: [("Ship it.", None)] * len(prompts))
    return made.select("target_kind", "markdown")


@query
def memo_run(given):
    by_type = overview.mix(given.feedback_items, "fb_type")
    mandate = F.concat(F.col("items").cast("string"), F.lit(" items")).alias("mandate")
    roles = by_type.select(F.col("fb_type").alias("position"), F.col("fb_type").alias("role"), mandate)
    roadmap = scoring.roadmap_text(_opportunities(given), given.themes)

    def first_line(prompts):
        return [(prompt.split("\n")[0], None) for prompt in prompts]

    def voices(prompts):
        return [(f"{prompt.count('### ')} voices.", None) for prompt in prompts]

    return writing.memo_document(roadmap, roles, first_line, voices).select("target_kind", "markdown")


@query
def golden_run(given):
    return writing.judged_golden(given.golden, given.feedback_items, _approving)


@query
def sample_run(given):
    return writing.judged_sample(given.feedback_items, _approving)


# Runs and streams


@query
def batch_runs(given):
    """Import, labels, corrections, reset and relabelling over tables of the engine."""
    path, spark = shared_folder(given.spark), given.spark
    incoming = _normalized(given)
    for _ in range(2):  # the second import meets its own rows
        runs.import_feedback(spark, path, incoming, [F.col("arrival")])
    runs.label_new(spark, path)
    edits = tables.read_current(spark, path).filter("fb_type = 'question'")
    runs.correct(spark, path, edits.select(F.col("id").alias("item_id"), F.lit("bug").alias("fb_type"), F.lit(4).alias("severity")))
    runs.reset_labels(spark, path)
    runs.label_new(spark, path)
    tables.write_snapshot(spark, path)
    return tables.read_snapshot(spark, path).select(
        "source", "external_id", "author", "status", "fb_type", "severity", "human_corrected"
    )


def _normalized(given: Inputs) -> DataFrame:
    items = given.feedback_items
    return items.select("source", "external_id", "author", "body", "rating", F.col("created_at").cast("timestamp").alias("created_at"), F.col("id").alias("arrival"))


@query
def filtered_imports(given):
    """Items as four imports store them, with their ids: the labelled ones, the English ones, all, and all again."""
    path, spark = shared_folder(given.spark), given.spark
    items = given.plain_items.withColumn("arrival", F.col("id")).drop("id")
    items = items.withColumns({"author": F.lit("ann"), "rating": F.lit(1), "created_at": F.lit(None).cast("timestamp")})
    marked = given.table("labels").select(F.col("doc_id").alias("arrival"))
    for batch in (items.join(marked, "arrival", "left_semi"), items.filter("source = 'en'"), items, items):
        runs.import_feedback(spark, path, batch, [F.col("arrival")])
    return tables.read_table(spark, path, "items").select("id", "source", "external_id", "import_no")


@query
def retry_run(given):
    """Items that a model limits up to twice, by the length of their text, and in which pass they are labelled."""
    path, spark = shared_folder(given.spark), given.spark
    runs.import_feedback(spark, path, _normalized(given), [F.col("arrival")])
    around = len(labels.PROMPT_HEAD) + len(labels.PROMPT_TAIL)

    def limited(passes):
        return lambda prompts: [(None, "429") if (len(prompt) - around) % 3 >= passes else ('{"type": "bug"}', None) for prompt in prompts]

    runs.label_import(spark, path, 1, limited(1), now=F.timestamp_seconds(F.lit(0)))
    for at in (1, 2):
        runs.label_due(spark, path, limited(at + 1), now=F.timestamp_seconds(F.lit(1000 * at)))
    events = tables.read_table(spark, path, "label_events").select(F.col("item_id").alias("id"), "seq", "fb_type")
    return tables.read_table(spark, path, "items").select("id", "source", "external_id").join(events, "id").drop("id")


@query
def bucketed_state(given):
    """The current state out of bucketed items and logs, with the later half of the log, all corrections and themes since."""
    path, spark = shared_folder(given.spark), given.spark
    middle = given.label_log.agg(F.expr("percentile_approx(seq, 0.5)")).first()[0]
    tables_of = {
        "items": (given.plain_items, "id"),
        "events": (given.label_log.filter(F.col("seq") <= middle), "item_id"),
        "fixes": (state.correction_events(given.edits, F.col("seq")).filter(F.col("seq") <= middle), "item_id"),
    }
    count, base = int(spark.conf.get("spark.sql.shuffle.partitions")), {}
    for name, (rows, key) in tables_of.items():
        buckets.write_bucketed(rows, f"{path}/{name}", key, count)
        schema = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in rows.schema)
        base[name] = buckets.read_bucketed(spark, f"{path}/{name}", schema, key, count)
    later = F.col("seq") > middle
    newer = given.label_log.filter(later), state.correction_events(given.edits, F.col("seq")).filter(later)
    return state.current_items_of_buckets(base["items"], (base["events"], base["fixes"]), newer, given.theme_runs).drop("body", "external_id", "source")


@query
def theme_run(given):
    """Import, labels, themes from the words of the texts, names and scores; what must come out for every item."""
    path = shared_folder(given.spark)
    _labelled(given, path)
    runs.build_themes(given.spark, path)
    return _themed(given, path)


def _labelled(given: Inputs, path: str) -> None:
    runs.import_feedback(given.spark, path, _normalized(given), [F.col("arrival")])
    runs.label_new(given.spark, path)


def _themed(given: Inputs, path: str) -> DataFrame:
    """Each item with its type and whether it has a theme, beside the totals of the scored themes."""
    spark = given.spark
    runs.score_themes(spark, path)
    scored = tables.newest_run(tables.read_table(spark, path, "opportunities"))
    named = scoring.named(scored, tables.newest_run(tables.read_table(spark, path, "themes")))
    total = named.agg(F.count("name").alias("themes"), F.sum("reach").alias("reach")).first()
    current = tables.read_current(spark, path).select("source", "external_id", "fb_type", F.col("theme_id").isNotNull().alias("themed"))
    return current.withColumns({name: F.lit(total[name]) for name in ("themes", "reach")})


@query
def theme_restart(given):
    """A theme run that breaks off twice, at the names and after the assignments, and is started again."""
    path, spark = shared_folder(given.spark), given.spark
    _labelled(given, path)

    def broken(prompts):
        raise RuntimeError("no namer")

    for _ in range(2):
        try:
            runs.build_themes(spark, path, name=broken)
        except RuntimeError:
            assert tables.read_table(spark, path, "themes").isEmpty()
    runs.build_themes(spark, path)
    return _themed(given, path)


@query
def script_vectors(given):
    """Word vectors of the texts in Cyrillic letters, in symbols only, and as they are: no item is lost."""
    latin, cyrillic = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщ"
    body = (
        F.when(F.col("id") % 3 == 0, F.translate(F.lower("body"), latin, cyrillic))
        .when(F.col("id") % 3 == 1, F.regexp_replace("body", r"[\p{L}\p{N}]", "☆"))
        .otherwise(F.col("body"))
    )
    vectors = themes.word_vectors(given.plain_items.withColumn("body", body))
    length = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda total, x: total + x * x)
    return vectors.select("id", F.round(length, 6).alias("squared_length"))


@query
def stream_ingest(given):
    """The same items landed as files and taken in by a stream."""
    path, spark = shared_folder(given.spark), given.spark
    landed = _normalized(given)
    landed.write.parquet(f"{path}/landed")
    raw = streaming.landed_files(spark, f"{path}/landed", landed.schema)
    for _ in range(2):  # started again, it finds nothing new
        streaming.start_ingest(raw, f"{path}/tables", f"{path}/checkpoint", lambda batch: batch, [F.col("arrival")]).awaitTermination()
    return tables.read_current(spark, f"{path}/tables").select("source", "external_id", "author", "status", "fb_type", "severity")


@query
def stream_daily_counts(given):
    """Drift out of the daily counts that a stream keeps."""
    path, spark = shared_folder(given.spark), given.spark
    landed = given.feedback_items.select(F.col("created_at").cast("timestamp").alias("created_at"), "theme_id")
    landed.write.parquet(f"{path}/landed")
    stream = streaming.landed_files(spark, f"{path}/landed", landed.schema, max_files=2)
    daily.start_daily_counts(stream, f"{path}/daily", f"{path}/checkpoint").awaitTermination()
    moved = drift.drift_from_daily(daily.read_daily_counts(spark, f"{path}/daily"), given.themes)
    return moved.withColumn("anchor", F.col("anchor").cast("string"))


@query
def drift_by_deltas(given):
    """Drift after a second theme run, out of counts that each run only changes where it moves items."""
    path, spark = shared_folder(given.spark), given.spark
    items = given.feedback_items.select("id", F.col("created_at").cast("timestamp").alias("created_at"))
    daily.add_change(spark, path, "items", items.withColumn("theme_id", F.lit(None).cast("bigint")))
    assigned, none = given.theme_runs, given.theme_runs.limit(0)
    before = none
    for run in (1, 2, 2):  # the second run comes again by mistake
        after = assigned.filter(F.col("run_id") == run)
        daily.add_change(spark, path, f"themes-{run}", daily.theme_changes(items, before, after))
        before = after
    named = given.themes.select((F.col("id") + 10).alias("id"), "name")
    moved = drift.drift_from_daily(daily.read_daily_counts(spark, path), named)
    return moved.withColumn("anchor", F.col("anchor").cast("string"))


@query
def first_rows(given):
    classified = given.feedback_items.filter("status = 'classified'")
    return ranking.first_rows(classified, 5, F.col("id")).select("id", "body", "fb_type")
