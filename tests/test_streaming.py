from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from roadsift.operators import drift
from roadsift.plans import runs
from roadsift.session import shared_folder
from roadsift.sources import tables
from roadsift.streaming import daily, ingest

SCHEMA = "arrival long, source string, external_id string, author string, body string, rating int, created_at timestamp"


def land(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def row(at, key):
    return (at, "app", key, "ann", f"this will crash again, said user {at}", 3, None)


def take_in(spark, path):
    raw = ingest.landed_files(spark, f"{path}/landed", spark.createDataFrame([], SCHEMA).schema, max_files=1)
    ingest.start_ingest(raw, f"{path}/tables", f"{path}/state", lambda batch: batch, [F.col("arrival")]).awaitTermination()
    return tables.read_current(spark, f"{path}/tables")


def test_nothing_is_lost_and_nothing_doubled(spark):
    path = shared_folder(spark)
    land(spark, f"{path}/landed", [row(1, "a"), row(2, "b"), row(3, "a")])
    land(spark, f"{path}/landed", [row(4, "b"), row(5, "c"), (6, "app", "d", "ann", "short", 3, None)])
    assert take_in(spark, path).count() == 3
    land(spark, f"{path}/landed", [row(7, "c"), row(8, "e")])
    current = take_in(spark, path).collect()
    assert sorted(r.external_id for r in current) == ["a", "b", "c", "e"]
    assert {r.status for r in current} == {"classified"} and {r.fb_type for r in current} == {"bug"}
    assert tables.read_table(spark, f"{path}/tables", "label_events").count() == 4


def test_replay_without_a_checkpoint_is_harmless(spark):
    path = shared_folder(spark)
    land(spark, f"{path}/landed", [row(1, "a"), row(2, "b")])
    take_in(spark, path)
    raw = ingest.landed_files(spark, f"{path}/landed", spark.createDataFrame([], SCHEMA).schema)
    ingest.start_ingest(raw, f"{path}/tables", f"{path}/other", lambda batch: batch, [F.col("arrival")]).awaitTermination()
    assert tables.read_table(spark, f"{path}/tables", "items").count() == 2


def test_daily_counts_include_late_rows(spark):
    path, schema = shared_folder(spark), "created_at timestamp, theme_id long"
    themes = spark.createDataFrame([(1, "A"), (2, "B")], "id long, name string")
    start = datetime(2024, 3, 1)
    batches = [
        [(start + timedelta(days=at), 1 + at % 2) for at in range(20)],
        [(start, 1), (start + timedelta(days=8), 1), (None, 2), (start + timedelta(days=25), None)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/landed")
        stream = ingest.landed_files(spark, f"{path}/landed", spark.createDataFrame([], schema).schema)
        daily.start_daily_counts(stream, f"{path}/daily", f"{path}/state").awaitTermination()
    streamed = drift.drift_from_daily(daily.read_daily_counts(spark, f"{path}/daily"), themes)
    whole = drift.drift(spark.createDataFrame(batches[0] + batches[1], schema), themes)
    assert streamed.collect() == whole.collect() and whole.count() == 2


def test_items_left_by_a_broken_run_are_labelled_at_the_next_start(spark):
    path = shared_folder(spark)
    land(spark, f"{path}/landed", [row(1, "a"), row(2, "b")])
    schema = spark.createDataFrame([], SCHEMA)
    raw = ingest.landed_files(spark, f"{path}/landed", schema.schema)

    def answer(prompts):
        return [(None, "429") if "user 1" in prompt else ('{"type": "praise"}', None) for prompt in prompts]

    ingest.start_ingest(raw, f"{path}/tables", f"{path}/state", lambda batch: batch, [F.col("arrival")], answer).awaitTermination()
    current = tables.read_current(spark, f"{path}/tables")
    assert {r.external_id: r.status for r in current.collect()} == {"a": "new", "b": "classified"}
    assert {r.external_id: r.fb_type for r in take_in(spark, path).collect()} == {"a": "bug", "b": "praise"}


def counts(spark, out):
    return {(str(row.day), row.theme_id): row["items"] for row in daily.read_daily_counts(spark, out).collect()}


def test_changes_add_up_by_levels_and_count_once(spark, monkeypatch):
    monkeypatch.setattr(daily, "LEVEL", 2)
    out, schema = shared_folder(spark), "created_at timestamp, theme_id long"
    start = datetime(2024, 3, 1)
    for at in range(5):
        rows = spark.createDataFrame([(start + timedelta(days=at), 1), (start, at % 2), (None, 3)], schema)
        assert daily.add_change(spark, out, f"c{at}", rows)
        assert not daily.add_change(spark, out, f"c{at}", rows)
    parts = daily.live_parts(spark, out)
    assert sorted(part.level for part in parts) == [0, 2] and frozenset().union(*(part.changes for part in parts)) == {f"c{at}" for at in range(5)}
    assert counts(spark, out) == {("2024-03-01", 0): 3, ("2024-03-01", 1): 3, ("2024-03-02", 1): 1, ("2024-03-03", 1): 1, ("2024-03-04", 1): 1, ("2024-03-05", 1): 1, ("None", 3): 5}


def test_late_rows_count_and_are_listed(spark):
    out, schema = shared_folder(spark), "created_at timestamp, theme_id long"
    newest = datetime(2024, 3, 20)
    daily.add_change(spark, out, "a", spark.createDataFrame([(newest, 1), (newest - timedelta(days=19), 1)], schema))
    daily.add_change(spark, out, "b", spark.createDataFrame([(newest - timedelta(days=7), 1), (newest - timedelta(days=8), 1), (newest - timedelta(days=8), 2)], schema))
    assert sum(counts(spark, out).values()) == 5
    assert {(str(row.day), row.theme_id, row.late) for row in daily.read_late_counts(spark, out).collect()} == {("2024-03-12", 1, 1), ("2024-03-12", 2, 1)}
    assert daily.read_daily_counts(spark, shared_folder(spark)).collect() == []


def test_a_change_that_broke_off_is_not_read(spark, monkeypatch):
    out = shared_folder(spark)
    rows = spark.createDataFrame([(datetime(2024, 3, 1), 1)], "created_at timestamp, theme_id long")
    with monkeypatch.context() as patch:
        patch.setattr(daily, "LOG", "broken")
        with pytest.raises(Exception):
            daily.add_change(spark, out, "a", rows)
    assert counts(spark, out) == {}
    assert daily.add_change(spark, out, "a", rows) and counts(spark, out) == {("2024-03-01", 1): 1}


def test_theme_runs_change_only_what_they_move(spark):
    directory, out = shared_folder(spark), shared_folder(spark)
    start = datetime(2024, 3, 1)

    def take_in(numbers):
        rows = [(at, "s", f"k{at}", "ann", f"this will crash again, said user {at}", 1, start + timedelta(days=at)) for at in numbers]
        runs.import_feedback(spark, directory, spark.createDataFrame(rows, SCHEMA), [F.col("arrival")])

    def assign(run_id, theme_of):
        tables.append(spark.createDataFrame([(run_id, item, theme) for item, theme in theme_of.items()], "run_id long, item_id long, theme_id long"), directory, "theme_assignments")
        names = sorted(set(theme_of.values()))
        tables.append(spark.createDataFrame([(run_id, theme, f"t{theme}", "s") for theme in names], tables.TABLES["themes"]), directory, "themes")

    def check():
        themes = tables.newest_run(tables.read_table(spark, directory, "themes"))
        whole = drift.drift(tables.read_current(spark, directory), themes).collect()
        assert drift.drift_from_daily(daily.read_daily_counts(spark, out), themes).collect() == whole and whole

    take_in(range(12))
    assign(1, {at: 1 + at % 2 for at in range(10)})
    assert runs.update_daily_counts(spark, directory, out) == ["import-1", "themes-1"]
    check()
    take_in(range(12, 18))
    assign(2, {at: 3 + at % 3 for at in range(4, 18)})
    assert runs.update_daily_counts(spark, directory, out) == ["import-2", "themes-2"]
    assert runs.update_daily_counts(spark, directory, out) == []
    check()
    items = tables.read_table(spark, directory, "items").select("id", "created_at")
    same = daily.theme_changes(items, spark.createDataFrame([(1, 5), (2, 6)], "item_id long, theme_id long"), spark.createDataFrame([(1, 5), (2, 7)], "item_id long, theme_id long"))
    assert sorted((row.theme_id, row.sign) for row in same.collect()) == [(6, -1), (7, 1)]
