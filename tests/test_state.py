import pytest
from pyspark.sql import functions as F

from roadsift.operators import state
from roadsift.plans import runs
from roadsift.session import shared_folder
from roadsift.sources import buckets, tables
from roadsift.sources.tables import TABLES


@pytest.fixture
def logs(spark):
    def build(events=(), fixes=(), themes=()):
        labelled = [
            (item, seq, kind, *(("bug", "sync", "neutral", 2, 0.5) if kind == "label" else (None,) * 5), None)
            for item, seq, kind in events
        ]
        return (
            spark.createDataFrame(labelled, TABLES["label_events"]),
            spark.createDataFrame(list(fixes), TABLES["corrections"]),
            spark.createDataFrame(list(themes), TABLES["theme_assignments"]),
        )

    return build


def current(items, logs):
    return {row.id: row for row in state.current_items(items.select("id", "body"), *logs).collect()}


def test_status_follows_the_last_event(make_items, logs):
    items = make_items(*[{}] * 5)
    rows = current(items, logs([(1, 1, "label"), (2, 1, "fail"), (3, 1, "label"), (3, 2, "reset"), (4, 1, "fail"), (4, 2, "label")]))
    assert [rows[i].status for i in range(1, 6)] == ["classified", "failed", "new", "classified", "new"]
    assert rows[3].fb_type is None and rows[4].fb_type == "bug"


def test_correction_overrides_type_and_severity_only(make_items, logs):
    rows = current(make_items({}, {}), logs([(1, 1, "label"), (2, 1, "label")], [(1, 2, "pricing", 4), (1, 3, "other", 1)]))
    assert (rows[1].fb_type, rows[1].severity, rows[1].sentiment, rows[1].human_corrected) == ("other", 1, "neutral", 1)
    assert (rows[2].fb_type, rows[2].human_corrected) == ("bug", 0)


def test_reset_spares_corrected_items_and_keeps_themes(make_items, logs, spark):
    items = make_items(*[{}] * 4)
    events = [(1, 1, "label"), (2, 1, "fail"), (3, 1, "label"), (4, 1, "label")]
    before = logs(events, [(3, 2, "pricing", 4)], [(1, 4, 9)])
    resets = state.reset_events(state.current_items(items.select("id", "body"), *before), 5)
    after = (before[0].unionByName(resets), *before[1:])
    rows = current(items, after)
    assert [rows[i].status for i in range(1, 5)] == ["new", "new", "classified", "new"]
    assert (rows[3].fb_type, rows[4].fb_type, rows[4].theme_id) == ("pricing", None, 9)


def test_reset_row_for_a_corrected_item_is_void(make_items, logs):
    rows = current(make_items({}), logs([(1, 1, "label"), (1, 9, "reset")], [(1, 4, "pricing", 4)]))
    assert (rows[1].status, rows[1].fb_type, rows[1].sentiment) == ("classified", "pricing", "neutral")


def test_only_the_newest_theme_run_counts(make_items, logs):
    rows = current(make_items({}, {}), logs(themes=[(1, 1, 5), (1, 2, 6), (2, 1, 7)]))
    assert (rows[1].theme_id, rows[2].theme_id) == (7, None)


def test_corrections_outside_the_taxonomy_are_refused(spark):
    edits = spark.createDataFrame([(1, "bug", 4), (2, "rant", 4), (3, "bug", 5), (4, "bug", 0)], "item_id long, fb_type string, severity int")
    assert [r.item_id for r in state.correction_events(edits, 1).collect()] == [1]


def test_unlabeled(make_items, logs):
    events = logs([(1, 1, "label"), (2, 1, "fail"), (3, 1, "label"), (3, 2, "reset")])[0]
    assert sorted(r.id for r in state.unlabeled(make_items(*[{}] * 4), events).collect()) == [3, 4]


def test_rate_limited_items_are_taken_up_again(spark, make_items):
    directory = shared_folder(spark)
    items = make_items(*[{"body": f"text number {i} of the items"} for i in range(6)])
    tables.append(items, directory, "items")

    def answer(limited):
        return lambda prompts: [(None, "429 slow down") if limited and "number 3" in p else ('{"type": "bug"}', None) for p in prompts]

    runs.label_new(spark, directory, answer(True))
    assert [r.id for r in tables.read_current(spark, directory).filter("status = 'new'").collect()] == [4]
    runs.label_new(spark, directory, answer(False), slices=3)
    events = tables.read_table(spark, directory, "label_events")
    assert events.count() == 6 and events.filter("seq = 2").count() == 1
    runs.label_new(spark, directory, answer(False))
    assert tables.read_table(spark, directory, "label_events").count() == 6


def test_views(spark, make_items):
    directory = shared_folder(spark)
    tables.append(make_items({}, {}), directory, "items")
    tables.register_views(spark, directory)
    assert spark.sql("SELECT count(*) FROM feedback_items LEFT JOIN themes ON themes.id = theme_id").first()[0] == 2
    assert spark.sql("SELECT * FROM opportunities WHERE rice_score > :low", args={"low": 1}).count() == 0


def above(plan, scanned):
    """The operators that the rows of a scan pass through: the lines of less and less indentation above the scan's."""
    lines = plan.splitlines()
    at = next(number for number, line in enumerate(lines) if "FileScan" in line and scanned in line)
    depth, found = len(lines[at]) - len(lines[at].lstrip(" :+-*0123456789()")), []
    for line in reversed(lines[:at]):
        own = len(line) - len(line.lstrip(" :+-*0123456789()"))
        if own < depth:
            found.append(line)
            depth = own
    return found


@pytest.fixture
def store(spark):
    """A store with two imports, labels, a correction, a reset and themes; and what is stored after the first half."""
    directory = shared_folder(spark)
    schema = "arrival long, source string, external_id string, body string, author string, rating int, created_at timestamp"

    def take_in(numbers):
        rows = [(at, "s", f"k{at}", f"this will crash again, said user {at}", "ann", 1, None) for at in numbers]
        runs.import_feedback(spark, directory, spark.createDataFrame(rows, schema), [F.col("arrival")])
        runs.label_new(spark, directory)

    def later():
        take_in(range(20, 32))
        runs.correct(spark, directory, spark.createDataFrame([(3, "pricing", 4), (25, "other", 1)], "item_id long, fb_type string, severity int"))
        runs.reset_labels(spark, directory)
        tables.append(spark.createDataFrame([(1, at, at % 3) for at in range(0, 32, 2)], TABLES["theme_assignments"]), directory, "theme_assignments")
        tables.append(spark.createDataFrame([(1, at, "t", "s") for at in range(3)], TABLES["themes"]), directory, "themes")

    take_in(range(20))
    runs.correct(spark, directory, spark.createDataFrame([(5, "bug", 4)], "item_id long, fb_type string, severity int"))
    return directory, later


def test_buckets_give_the_state_of_the_tables(spark, store):
    directory, later = store

    def both():
        return (sorted(map(str, read(spark, directory).drop("ingested_at").collect())) for read in (tables.read_current, buckets.read_current))

    one, other = both()
    assert one == other and len(one) == 20
    assert buckets.write_copy(spark, directory) == 1
    one, other = both()
    assert one == other
    later()
    one, other = both()
    assert one == other and len(one) == 32 and sum("status='new'" in row for row in one) == 29
    assert buckets.write_copy(spark, directory) == 2
    one, other = both()
    assert one == other
    for table in spark.catalog.listTables():  # as in another session, which has declared nothing
        if table.name.startswith("roadsift_"):
            spark.sql(f"DROP TABLE `{table.name}`")
    assert sorted(map(str, buckets.read_current(spark, directory).drop("ingested_at").collect())) == one


def test_a_copy_that_broke_off_is_not_read(spark, store, monkeypatch):
    directory, later = store
    buckets.write_copy(spark, directory)
    later()
    with monkeypatch.context() as patch:
        patch.setattr(buckets, "COPIES", "bucketed/broken")
        patch.setattr(buckets, "LOG", "broken")
        with pytest.raises(Exception):
            buckets.write_copy(spark, directory)
    assert buckets.newest_copy(spark, directory).version == 1
    assert buckets.read_current(spark, directory).count() == 32


def test_no_text_is_shuffled_or_sorted(spark, store):
    directory, later = store
    buckets.write_copy(spark, directory)
    plan = buckets.read_current(spark, directory)._jdf.queryExecution().executedPlan().toString()
    path = above(plan, "body")
    assert any("ShuffledHashJoin" in line or "BroadcastHashJoin" in line for line in path)
    assert not any("Exchange" in line or "Sort " in line for line in path)
    whole = tables.read_current(spark, directory)._jdf.queryExecution().executedPlan().toString()
    assert any("Exchange" in line for line in above(whole, "body"))


def test_bucketed_joins_shuffle_nothing_at_all(spark, logs, make_items):
    path = shared_folder(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        items = make_items(*[{}] * 40).select("id", "body")
        events, fixes, themes = logs([(at, 1, "label") for at in range(1, 40, 2)], [(3, 2, "pricing", 4)], [(1, at, at % 4) for at in range(40)])
        read = []
        for name, rows, key in (("items", items, "id"), ("events", events, "item_id"), ("fixes", fixes, "item_id")):
            buckets.write_bucketed(rows, f"{path}/{name}", key, 8)
            schema = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in rows.schema)
            read.append(buckets.read_bucketed(spark, f"{path}/{name}", schema, key, 8))
        found = state.current_items_of_buckets(read[0], tuple(read[1:]), (events.limit(0), fixes.limit(0)), themes)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert not any("Exchange" in line or "Sort " in line for line in above(plan, "body"))
        assert not any("Exchange" in line for line in above(plan, "item_id"))  # the bucketed logs are aggregated where they lie
        want = state.current_items(items, events, fixes, themes)
        assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rules_label_texts_where_they_are(spark, make_items, monkeypatch):
    def refused(*_):
        raise AssertionError("the texts are written")

    monkeypatch.setattr(runs, "_by_slice", refused)
    bodies = ["a crash of the app", "how to do this", "nothing to say", "the best of all"]
    for limit in (0, 100):
        monkeypatch.setattr("roadsift.operators.small.MAX_SMALL_ROWS", limit)
        directory = shared_folder(spark)
        tables.append(make_items(*[{"body": body} for body in bodies]), directory, "items")
        assert runs.label_new(spark, directory) == 1
        tables.append(make_items({"id": 9, "body": "a bug"}), directory, "items")
        assert runs.label_new(spark, directory) == 2  # the items before have their labels
        events = tables.read_table(spark, directory, "label_events").select("item_id", "seq", "fb_type").collect()
        assert sorted(map(tuple, events)) == [(1, 1, "bug"), (2, 1, "question"), (3, 1, "other"), (4, 1, "praise"), (9, 2, "bug")]
