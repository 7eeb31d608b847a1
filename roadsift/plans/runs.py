"""Whole runs over the engine's tables: import, label, correct, reset, theme, score.

Each run reads tables and ends in an append, so no lineage grows from run to run, a lost executor costs a
recomputation at most, and a run that broke off can be started again.
"""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from roadsift.functions.keys import body_hash
from roadsift.operators import themes as th
from roadsift.operators.ingest import arrivals, filter_usable, next_import, numbered_rows, with_item_ids
from roadsift.operators.key_filter import KEY
from roadsift.operators.labels import due_retries, label_events, label_with, retries
from roadsift.operators.models import Answer
from roadsift.operators.scoring import rice
from roadsift.operators.small import hinted, is_small
from roadsift.operators.state import correction_events, latest_themes, reset_events, unlabeled
from roadsift.session import shared_folder, written
from roadsift.sources.key_filters import extend, known_keys
from roadsift.sources.tables import append, newest_run, read_current, read_table
from roadsift.streaming import daily


def _next(table: DataFrame, column: str) -> int:
    return table.agg(F.coalesce(F.max(column), F.lit(0)) + 1).first()[0]


def _by_slice(rows: DataFrame, slices: int) -> list[DataFrame]:
    """The rows (with ``body_hash``), written once, in so many parts; rows of equal text are in one part."""
    if slices == 1:
        return [written(rows)]
    path = shared_folder(rows.sparkSession)
    part = F.pmod(F.xxhash64("body_hash"), F.lit(slices)).alias("slice")
    rows.select("*", part).write.partitionBy("slice").parquet(path)
    stored = rows.sparkSession.read.schema(rows.select("*", part).schema).parquet(path)
    return [stored.filter(F.col("slice") == number).drop("slice") for number in range(slices)]


def import_feedback(
    spark: SparkSession,
    directory: str,
    normalized: DataFrame,
    order: Sequence[Column],
    stamp: Column | None = None,
    ids_in_order: bool = True,
) -> tuple[int, int]:
    """Stores the usable, not yet stored items of a batch; returns their number and the number of the import.

    ``order`` (rising) says which copy came first. The batch is written once; which of its rows are stored, and under which ids,
    is worked out on keys and row numbers, so texts are shuffled once and never sorted. Stored keys are read only where
    the key filters let keys of the batch pass: an import of new keys reads none. The filter of the import is published
    last; a run that breaks off before leaves an import that is read in full.
    """
    usable = filter_usable(normalized)
    batch = written(usable.withColumn("place", F.struct(*(order or [F.lit(0)]))))
    import_no, first_id = next_import(read_table(spark, directory, "items"))
    keys = written(batch.filter(F.col("source").isNotNull() & F.col("external_id").isNotNull()).select(*KEY).distinct())
    chosen = arrivals(batch, known_keys(spark, directory, keys))
    fresh = numbered_rows(batch, with_item_ids(chosen, first_id, ids_in_order))
    stamped = fresh.withColumn("ingested_at", F.current_timestamp() if stamp is None else stamp)
    counted = Observation()
    rows = stamped.withColumn("import_no", F.lit(import_no)).observe(counted, F.count(F.lit(1)).alias("inserted"))
    append(rows, directory, "items")
    inserted = counted.get["inserted"]
    if inserted:
        extend(spark, directory, import_no)
    return inserted, import_no


RETRY_SECONDS = 60


def _store_labels(
    spark: SparkSession, directory: str, asked: DataFrame, seq: int, answer: Answer | None, partitions: int | None, now: Column | None, wait: int
) -> None:
    """Labels the rows (id, body, attempt), each text asked once, and logs what came back and what is to be asked again."""
    labelled = label_with(asked.select("id", "body"), answer, partitions=partitions)
    if answer is None:  # rules are never limited
        append(label_events(labelled, seq), directory, "label_events")
        return
    labelled = written(labelled)
    append(label_events(labelled, seq), directory, "label_events")
    append(retries(asked, labelled, seq, F.current_timestamp() if now is None else now, wait), directory, "retries")


def label_new(
    spark: SparkSession,
    directory: str,
    answer: Answer | None = None,
    partitions: int | None = None,
    slices: int = 1,
    now: Column | None = None,
    wait: int = RETRY_SECONDS,
) -> int:
    """Labels every new item and returns the run's sequence number; rate-limited items stay new.

    The ids to label are written down first; if they are few, the items are scanned for them and not shuffled. The
    texts are written once, by slices of their hash: the model sees a text once, whatever the slices. Labels are
    stored slice by slice, so a run that breaks off keeps what it has paid for. Items that are limited are logged for
    ``label_due``. The keyword rules read the texts where they are: only ids and labels are moved, and stored at once.
    """
    items, events = read_table(spark, directory, "items"), read_table(spark, directory, "label_events")
    seq = _next_label_run(spark, directory)
    todo = written(unlabeled(items, events))
    if answer is None:
        few = is_small(todo)
        labelled = label_with((items.join(F.broadcast(todo), "id") if few else items).select("id", "body"))
        append(label_events(labelled if few else labelled.join(todo, "id"), seq), directory, "label_events")
        return seq
    wanted = items.select("id", "body", body_hash(F.col("body")).alias("body_hash")).join(hinted(todo, todo), "id")
    for part in _by_slice(wanted, slices):
        _store_labels(spark, directory, part.drop("body_hash").withColumn("attempt", F.lit(0)), seq, answer, partitions, now, wait)
    return seq


def label_import(
    spark: SparkSession,
    directory: str,
    import_no: int,
    answer: Answer | None = None,
    partitions: int | None = None,
    now: Column | None = None,
    wait: int = RETRY_SECONDS,
) -> int:
    """Labels the items of one import that no label run has seen yet. Only that import is read."""
    items = read_table(spark, directory, "items").filter(F.col("import_no") == import_no)
    seq = _next_label_run(spark, directory)
    _store_labels(spark, directory, items.select("id", "body", F.lit(0).alias("attempt")), seq, answer, partitions, now, wait)
    return seq


def label_due(
    spark: SparkSession, directory: str, answer: Answer, partitions: int | None = None, now: Column | None = None, wait: int = RETRY_SECONDS
) -> int | None:
    """Asks again for the items whose wait after a rate limit is over; None if there are none.

    Only the log of retries and the label runs since its oldest entry are read to find them, and no other text than theirs.
    An item is asked again after ``wait`` seconds, then after twice as many, and so on, until it has an answer.
    """
    log = read_table(spark, directory, "retries")
    oldest = log.agg(F.min("seq")).first()[0]
    if oldest is None:
        return None
    events = read_table(spark, directory, "label_events").filter(F.col("seq") >= oldest)
    due = written(due_retries(log, events, F.current_timestamp() if now is None else now))
    if due.isEmpty():
        return None
    seq = _next_label_run(spark, directory)
    asked = written(read_table(spark, directory, "items").select("id", "body").join(hinted(due, due), "id"))
    _store_labels(spark, directory, asked, seq, answer, partitions, now, wait)
    return seq


def _next_label_run(spark: SparkSession, directory: str) -> int:
    """Above every run that has logged anything; one that was limited throughout has retries only."""
    return max(_next(read_table(spark, directory, name), "seq") for name in ("label_events", "retries"))


def correct(spark: SparkSession, directory: str, edits: DataFrame) -> int:
    """Stores a reviewer's edits (item_id, fb_type, severity)."""
    seq = max(_next(read_table(spark, directory, name), "seq") for name in ("corrections", "label_events"))
    append(correction_events(edits, seq), directory, "corrections")
    return seq


def reset_labels(spark: SparkSession, directory: str) -> int:
    """Makes all items new that no human corrected."""
    seq = max(_next(read_table(spark, directory, name), "seq") for name in ("corrections", "label_events"))
    append(reset_events(read_current(spark, directory), seq), directory, "label_events")
    return seq


def build_themes(
    spark: SparkSession,
    directory: str,
    embed: Callable | None = None,
    k: int | None = None,
    min_size: int = 0,
    name: Callable[[DataFrame], DataFrame] | None = None,
    partitions: int | None = None,
    slices: int = 1,
) -> int:
    """Clusters the actionable items and returns the run id.

    With ``embed``, only texts without stored features are embedded, and the features are kept, slice by slice.
    ``name`` turns (theme_id, prompt) rows into (theme_id, reply) rows. Theme ids go on rising from run to run. The
    themes are stored last, and only runs that have them count; one that broke off leaves the run before it current
    and its numbers unused. A run over no items ends without themes.
    """
    items = written(th.actionable(read_current(spark, directory)).select("id", "body", "product_area"))
    if embed is None:
        vectors = th.word_vectors(items)
    else:
        misses = th.cache_misses(items, read_table(spark, directory, "feature_cache"))
        for texts in _by_slice(misses, slices):
            append(th.compute_features(texts, embed, partitions), directory, "feature_cache")
        vectors = th.vectorize(items, read_table(spark, directory, "feature_cache"))
    old, tried = read_table(spark, directory, "themes"), read_table(spark, directory, "theme_assignments")
    run_id = max(_next(old, "run_id"), _next(tried, "run_id"))
    first_id = max(_next(old, "id"), _next(tried, "theme_id"))
    append(th.assignments(th.cluster(vectors, k, min_size=min_size, features=False), run_id, first_id), directory, "theme_assignments")
    assigned = read_table(spark, directory, "theme_assignments").filter(F.col("run_id") == run_id)
    members = items.join(assigned.select(F.col("item_id").alias("id"), "theme_id"), "id")
    replies = name(th.naming_prompts(members, assigned.select("theme_id").distinct())) if name else None
    append(th.name_themes(members, replies).withColumn("run_id", F.lit(run_id)), directory, "themes")
    return run_id


def score_themes(spark: SparkSession, directory: str, efforts: DataFrame | None = None) -> int:
    """Scores the newest themes and returns the run id of the scores."""
    opportunities = read_table(spark, directory, "opportunities")
    run_id = _next(opportunities, "run_id")
    scored = rice(read_current(spark, directory), newest_run(read_table(spark, directory, "themes")), efforts)
    append(scored.withColumn("run_id", F.lit(run_id)), directory, "opportunities")
    return run_id


def update_daily_counts(spark: SparkSession, directory: str, out: str) -> list[str]:
    """Adds to the daily counts in ``out`` what was stored since the last update, import by import and theme run by theme run.

    An import's items come in without a theme; a finished theme run moves items from the themes of the run before to its
    own, so only the items that it moves are counted. Returns the names of the changes. For one updater at a time.
    """
    counted = frozenset().union(*(part.changes for part in daily.live_parts(spark, out)))
    items, assigned = read_table(spark, directory, "items"), read_table(spark, directory, "theme_assignments")
    added = []
    for number in sorted(row[0] for row in items.select("import_no").distinct().collect()):  # of partitions, not of rows
        change = f"import-{number}"
        if change not in counted:
            rows = items.filter(F.col("import_no") == number).select("created_at", F.lit(None).cast("bigint").alias("theme_id"))
            daily.add_change(spark, out, change, rows)
            added.append(change)
    finished = sorted(row[0] for row in read_table(spark, directory, "themes").select("run_id").distinct().collect())
    last = None
    for run_id in finished:
        change = f"themes-{run_id}"
        if change not in counted:
            before, after = (latest_themes(assigned.filter(F.col("run_id") == run)) for run in (-1 if last is None else last, run_id))
            daily.add_change(spark, out, change, daily.theme_changes(items.select("id", "created_at"), before, after))
            added.append(change)
        last = run_id
    return added
