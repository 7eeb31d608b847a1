import re
import uuid

import pytest
from pyspark.sql import functions as F

from roadsift.functions.keys import body_hash
from roadsift.operators import labels, themes
from roadsift.operators.models import one_of_each_text
from roadsift.plans import runs
from roadsift.schemas import FEEDBACK_TYPES
from roadsift.session import shared_folder, written
from roadsift.sources import tables


def parse(spark, *texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, reply string")
    return labels.parse_label_replies(frame).orderBy("id").collect()


def test_severity_typing(spark):
    given = ["3", '"3"', "3.7", '"3.7"', "true", "null", '"x"', "9", "-1", '" 2 "', "1e9", "NaN", "[3]", '"99"', "0.5"]
    want = [3, 3, 3, 2, 1, 2, 2, 4, 1, 2, 4, 2, 2, 4, 1]
    assert [row.severity for row in parse(spark, *[f'{{"severity": {v}}}' for v in given])] == want
    assert parse(spark, "{}")[0].severity == 2


def test_confidence_typing(spark):
    given = ["0.9", '"0.9"', "1.7", "-1", "null", "false", '"high"', '"1e-1"', "NaN"]
    want = [0.9, 0.9, 1.0, 0.0, 0.5, 0.0, 0.5, 0.1, 0.5]
    assert [row.confidence for row in parse(spark, *[f'{{"confidence": {v}}}' for v in given])] == want
    assert parse(spark, "{}")[0].confidence == 0.5


def test_domains_and_defaults(spark):
    long_area = "x" * 80
    good, bad, empty, twice = parse(
        spark,
        f'{{"type": "pricing", "area": "{long_area}", "sentiment": "positive"}}',
        '{"type": "rant", "area": null, "sentiment": "angry"}',
        "{}",
        '{"type": "bug", "type": "praise"}',
    )
    assert (good.fb_type, good.product_area, good.sentiment) == ("pricing", "x" * 50, "positive")
    assert (bad.fb_type, bad.product_area, bad.sentiment) == ("other", "unknown", "neutral")
    assert (empty.fb_type, empty.product_area, empty.error) == ("other", "unknown", None)
    assert twice.fb_type == "praise"


def test_unreadable_replies_give_the_safe_label(spark):
    for row in parse(spark, "no json", '{"type": "bug"', '{"a":1} tail }'):
        assert (row.fb_type, row.product_area, row.sentiment, row.severity, row.confidence) == ("other", "unknown", "neutral", 2, 0.0)
        assert row.error


def test_no_reply_is_no_label(spark):
    (row,) = parse(spark, None)
    assert row.fb_type is None and row.error is None


def test_keyword_rules_in_order(make_items):
    bodies = ["It will CRASH, how to fix?", "How do I share", "I love it, the best", "fine", "app not opening"]
    rows = labels.keyword_labels(make_items(*[{"body": b} for b in bodies])).orderBy("id").collect()
    assert [r.fb_type for r in rows] == ["bug", "question", "praise", "other", "bug"]
    assert (rows[1].product_area, rows[1].severity, rows[1].confidence) == ("onboarding", 1, 0.6)


def test_error_classes(spark):
    cases = [
        ("429 Too Many Requests", None, "rate_limit"), ("oops", 503, "transient"), ("bad JSON", None, "permanent"),
        ("limit 1500", None, "transient"), (None, None, None), (None, 404, "permanent"), ("Tokens PER day", 500, "rate_limit"),
    ]
    frame = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, message string, code int")
    got = frame.orderBy("i").select(labels.error_class(F.col("message"), F.col("code"))).collect()
    assert [row[0] for row in got] == [case[2] for case in cases]


def test_run_events(spark):
    replies = spark.createDataFrame(
        [(1, '{"type": "bug"}', None), (2, "junk", None), (3, None, "429"), (4, None, "503 overloaded"), (5, None, None)],
        "id long, reply string, error string",
    )
    events = labels.label_events(labels.parse_label_replies(labels.answered(replies)), 3).orderBy("item_id").collect()
    assert [(e.item_id, e.kind, e.fb_type, e.seq) for e in events] == [(1, "label", "bug", 3), (2, "fail", None, 3), (4, "fail", None, 3)]


def test_hook_is_called_once_per_distinct_body(spark, make_items, tmp_path):
    log = str(tmp_path / "calls")

    def answer(prompts):
        with open(log, "a") as file:
            file.write("".join(f"{len(p)}\n" for p in prompts))
        return [('{"type": "question"}', None) for _ in prompts]

    items = make_items({"body": "same text"}, {"body": "same text"}, {"body": "other text!"})
    rows = labels.label_with(items, answer, partitions=2).collect()
    assert sorted(r.id for r in rows) == [1, 2, 3] and {r.fb_type for r in rows} == {"question"}
    with open(log) as file:
        assert len(file.readlines()) == 2


def test_prompt_holds_taxonomy_and_whole_body(make_items):
    body = "b" * 5000
    prompt = labels.label_prompts(make_items({"body": body})).first().prompt
    assert body in prompt and all(f"- {name}: " in prompt for name in FEEDBACK_TYPES)


@pytest.mark.parametrize("n", [2, 5])
def test_work_batch_is_oldest_first_and_stable(make_items, n):
    from datetime import datetime

    items = make_items(*[{"status": "new", "ingested_at": datetime(2024, 1, 9 - at // 2)} for at in range(6)], {"status": "failed"})
    first = [r.id for r in labels.work_batch(items, n).collect()]
    assert first == [5, 6, 3, 4, 1, 2][:n] == [r.id for r in labels.work_batch(items, n).collect()]


def test_texts_are_asked_once_and_not_sorted(spark):
    items = written(spark.createDataFrame([(at, f"text {at % 4}") for at in range(40)], "id long, body string"))
    hashed = items.select("id", "body", body_hash(F.col("body")).alias("body_hash"))
    once = one_of_each_text(hashed)
    assert sorted(row.body for row in once.collect()) == [f"text {at}" for at in range(4)]
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert "Sort " not in plan and "SortMergeJoin" not in plan and "SortAggregate" not in plan
    missing = themes.cache_misses(items, spark.createDataFrame([(row.body_hash, [1.0]) for row in hashed.filter("id < 2").collect()], "body_hash string, features array<float>"))
    assert sorted(row.body for row in missing.collect()) == ["text 2", "text 3"]


def test_limited_items_are_asked_when_they_are_due_and_nothing_twice(spark, tmp_path):
    directory = shared_folder(spark)
    rows = [(at, "s", f"k{at}", f"this will crash again, said user {at:02d}", "ann", 1, None) for at in range(12)]
    schema = "arrival long, source string, external_id string, body string, author string, rating int, created_at timestamp"
    runs.import_feedback(spark, directory, spark.createDataFrame(rows, schema), [F.col("arrival")])
    asked = []
    folder = str(tmp_path)

    def answer(name, limited):
        def reply(prompts):
            numbers = [int(re.search(r"said user ([0-9]+)", prompt).group(1)) for prompt in prompts]
            with open(f"{folder}/{name}-{uuid.uuid4().hex}", "w") as out:
                out.write(" ".join(map(str, numbers)))
            return [(None, "429") if number in limited else ('{"type": "bug"}', None) for number in numbers]

        return reply

    def turn(name, limited, seconds, run):
        result = run(answer(name, limited), F.timestamp_seconds(F.lit(seconds)))
        asked.append(sorted(int(number) for path in tmp_path.glob(f"{name}-*") for number in path.read_text().split()))
        return result

    due = lambda reply, now: runs.label_due(spark, directory, reply, now=now, wait=60)
    assert due(answer("none", ()), F.timestamp_seconds(F.lit(0))) is None
    assert turn("a", set(range(6)), 0, lambda reply, now: runs.label_new(spark, directory, reply, now=now, wait=60)) == 1
    assert turn("b", {0, 1}, 59, due) is None
    assert turn("c", {0, 1}, 60, due) == 2
    assert turn("d", set(), 179, due) is None  # 60 + 2 * 60
    assert turn("e", {0}, 180, due) == 3
    assert turn("f", set(), 5000, due) == 4
    assert turn("g", set(), 50000, due) is None
    assert asked == [list(range(12)), [], list(range(6)), [], [0, 1], [0], []]
    events = {row.item_id: row.seq for row in tables.read_table(spark, directory, "label_events").collect()}
    assert events == {0: 4, 1: 3, **{at: 2 for at in range(2, 6)}, **{at: 1 for at in range(6, 12)}}
