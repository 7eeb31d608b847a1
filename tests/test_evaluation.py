from roadsift.operators import evaluation


def test_verdict_truth(spark):
    given = ["true", "false", "null", None, "0", "1", '"false"', '"no"', '""', "[]", '{"a": 1}', "0.5"]
    texts = [f'{{"type_correct": {v}}}' if v else "{}" for v in given]
    frame = spark.createDataFrame([(i, "bug", t) for i, t in enumerate(texts)], "item_id long, fb_type string, reply string")
    rows = evaluation.parse_verdicts(frame).orderBy("item_id").collect()
    assert [r.type_correct for r in rows] == [True, False, False, False, False, True, False, True, False, False, True, True]
    assert {r.suggested_type for r in rows} == {"bug"} and {r.error for r in rows} == {None}


def test_failed_verdicts_keep_the_assigned_type(spark):
    frame = spark.createDataFrame([(1, "bug", "no"), (2, "praise", None)], "item_id long, fb_type string, reply string")
    rows = evaluation.parse_verdicts(frame).orderBy("item_id").collect()
    assert [(r.type_correct, r.suggested_type) for r in rows] == [(None, "bug"), (None, "praise")]
    assert all(r.error and r.reasoning.startswith("judge error") for r in rows)


def test_certification(spark, make_items):
    items = make_items({"fb_type": "bug"}, {"fb_type": "praise"}, {"fb_type": "bug"}, {"fb_type": "bug"}, {"fb_type": None})
    golden = spark.createDataFrame(
        [("1", "bug"), ("2", " bug "), ("3", "bug"), ("4", " "), ("5", "bug"), ("99", "bug"), ("x", "bug")], "id string, gold_type string"
    )
    verdicts = spark.createDataFrame([(1, True), (2, True), (3, None), (4, True), (5, False), (99, True)], "item_id long, type_correct boolean")
    certified = evaluation.certify(golden, items, verdicts)
    assert {r.id: r.result for r in certified.collect()} == {1: "MATCH", 2: "MISMATCH", 5: "MATCH"}
    row = evaluation.agreement(certified).first()
    assert (row.agree, row.counted, row.agreement) == (2, 3, 2 / 3)
    assert evaluation.agreement(certified.limit(0)).first().agreement is None


def test_sampled_accuracy(spark, make_items):
    items = make_items(*[{}] * 4, {"status": "new"})
    verdicts = spark.createDataFrame([(1, True, "bug"), (2, False, "other"), (3, None, "bug")], "item_id long, type_correct boolean, suggested_type string")
    judged = evaluation.judged_sample(evaluation.sample_items(items, 10), verdicts)
    row = evaluation.sampled_accuracy(judged).first()
    assert (row.correct, row.wrong, row.errors, row.accuracy) == (1, 1, 2, 0.5)
    assert {r.id: r.note for r in judged.collect()}[2] == "FLAG -> suggests other"


def test_sample_is_repeatable_and_follows_the_seed(make_items):
    items = make_items(*[{}] * 60)
    pick = lambda seed, frame: sorted(r.id for r in evaluation.sample_items(frame, 10, seed).collect())
    assert pick(1, items) == pick(1, items.repartition(7)) != pick(2, items)


def test_golden_sample_takes_the_first_of_each_type(make_items):
    items = make_items(*[{"fb_type": ["bug", "praise", None][at % 3]} for at in range(12)], {"fb_type": "bug", "status": "new"})
    rows = evaluation.golden_sample(items, per_type=2).collect()
    assert [(r.id, r.gold_type) for r in rows] == [(1, "bug"), (2, "praise"), (4, "bug"), (5, "praise")]


def test_golden_accuracy(spark, make_items):
    items = make_items({"fb_type": "bug", "severity": 2}, {"fb_type": "bug", "severity": 3}, {"fb_type": "praise", "severity": 1})
    golden = spark.createDataFrame([("1", "bug", "2"), ("2", "pricing", "x"), ("3", "praise", "4")], "id string, gold_type string, gold_severity string")
    rows = {r.fb_type: (r.rows, r.type_accuracy, r.severity_accuracy) for r in evaluation.golden_accuracy(golden, items).collect()}
    assert rows == {"bug": (2, 0.5, 1.0), "praise": (1, 1.0, 0.0), None: (3, 2 / 3, 0.5)}


def test_correction_rate(make_items):
    row = evaluation.correction_rate(make_items({"human_corrected": 1, "theme_id": 1}, {}, {"status": "new", "human_corrected": 1}, {})).first()
    assert (row.correction_rate, row.themed_share) == (1 / 3, 0.25)
    empty = evaluation.correction_rate(make_items({"status": "new"}).limit(0)).first()
    assert (empty.correction_rate, empty.themed_share) == (None, None)


def test_judge_hook_keeps_errors(make_items):
    items = make_items({"body": "good body"}, {"body": "bad body", "fb_type": None})

    def answer(prompts):
        return [(None, "quota") if "bad body" in p else ('{"type_correct": false, "suggested_type": "praise"}', None) for p in prompts]

    rows = evaluation.judge_with(items, answer, partitions=2).orderBy("item_id").collect()
    assert [(r.type_correct, r.suggested_type, r.reasoning, r.error) for r in rows] == [
        (False, "praise", "", None), (None, None, "judge error: quota", "quota"),
    ]
