"""The overview tables, and the shape of plans that must hold at scale."""

import re

import pytest
from pyspark.sql import functions as F

from roadsift.operators import citations, drift, ingest, ranking, scoring, themes
from roadsift.plans import overview
from roadsift.session import shared_folder
from roadsift.sources import documents, tables


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored(spark, make_items):
    """Items read from a file, so that scans show what they read."""
    rows = [{"theme_id": at % 3, "severity": 1 + at % 4, "confidence": 0.5, "body": f"some text number {at:09d}"} for at in range(60)]
    path = shared_folder(spark)
    make_items(*rows).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def three(spark):
    return spark.createDataFrame([(i, f"t{i}", "s") for i in range(3)], "id long, name string, summary string")


def read_columns(plan):
    return set(re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1).replace(",", ":").split(":")[::2])


def test_scores_and_drift_read_no_texts(stored, three):
    assert read_columns(plan_of(scoring.theme_stats(stored))) == {"severity", "confidence", "theme_id"}
    assert "body" not in plan_of(drift.drift(stored, three))


def test_filters_reach_the_scan(stored):
    plan = plan_of(themes.actionable(stored).select("id"))
    assert "EqualTo(status,classified)" in plan and "Not(EqualTo(fb_type,praise))" in plan


def test_items_are_not_shuffled_for_a_checked_pool(spark, stored, three):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        bounded = plan_of(citations.with_siblings(stored, stored, three).select("id", "body", "siblings"))
        unbounded = plan_of(citations.with_siblings(stored, stored).select("id", "body", "siblings"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    texts_shuffled = r"Exchange hashpartitioning\((id|theme_id)#\d+L?, \d+\)[^\n]*\n[^\n]*(Project|Filter)[^\n]*body"
    assert not re.search(texts_shuffled, bounded)
    assert re.search(texts_shuffled, unbounded)
    assert bounded.count("BroadcastHashJoin") == 2 and "CartesianProduct" not in bounded + unbounded


def test_ranks_are_limited_before_the_shuffle(stored):
    picked = ranking.top_per_group(stored.select("theme_id", "severity", "id"), "theme_id", [F.desc("severity"), F.col("id")], 5)
    assert plan_of(picked).count("WindowGroupLimit") == 4
    keyed = ingest.first_per_key(stored.select("id", "source", "external_id", "body"), [F.col("id")])
    assert "WindowGroupLimit" in plan_of(keyed)


def test_top_rows_need_no_full_sort(stored):
    assert "TakeOrderedAndProject" in plan_of(overview.review_queue(stored))


def test_hot_group_gives_the_same_ranks(spark):
    """Nearly all rows in one group, whatever their spread over tasks."""
    rows = spark.range(20000).select(F.when(F.col("id") < 19990, 1).otherwise(2).alias("g"), (F.col("id") * 7919 % 20011).alias("v"), "id")
    for frame in (rows.coalesce(1), rows.repartition(13)):
        got = ranking.top_per_group(frame, "g", [F.col("v"), F.col("id")], 3, salts=5).orderBy("g", "rank").collect()
        want = [sorted((i * 7919 % 20011, i) for i in ids)[:3] for ids in (range(19990), range(19990, 20000))]
        assert [(r.v, r.id) for r in got] == want[0] + want[1]


def test_kpis_and_funnel(make_items, spark):
    items = make_items({"theme_id": 1}, {"fb_type": "praise"}, {"fb_type": None}, {"status": "new", "theme_id": 2})
    row = overview.kpis(items, spark.range(3)).first()
    assert (row.total, row.classified, row.actionable, row.themed, row.opportunities, row.themed_share) == (4, 3, 1, 2, 3, "50% of all feedback")
    assert [r["items"] for r in overview.funnel(overview.kpis(items, spark.range(3))).collect()] == [4, 3, 1, 2]
    empty = overview.kpis(items.limit(0), spark.range(0)).first()
    assert (empty.total, empty.themed_share) == (0, "0%")


def test_mixes_and_labels(make_items):
    items = make_items({"severity": 4}, {"severity": 4}, {"severity": 9}, {"severity": 1, "status": "new"})
    assert [(r.severity, r["items"], r.label) for r in overview.severity_mix(items).collect()] == [(4, 2, "4 · critical"), (9, 1, None)]
    assert [(r.rating, r["items"]) for r in overview.histogram(items, "rating").collect()] == [(None, 4)]


def test_review_queue_order(make_items):
    items = make_items(
        {"human_corrected": 1, "confidence": 0.1}, {"confidence": 0.9, "severity": 1}, {"confidence": 0.2, "severity": 1},
        {"confidence": 0.2, "severity": 4}, {"confidence": None}, {"status": "new", "confidence": 0.0},
    )
    assert [r.id for r in overview.review_queue(items).collect()] == [5, 4, 3, 2, 1]


def test_headers_and_drilldown(make_items, three):
    items = make_items({"theme_id": 1, "severity": 2}, {"theme_id": 1, "severity": 3}, {"theme_id": 1}, {})
    assert [r.header for r in overview.theme_headers(items, three).collect()] == ["t0 — 0 items", "t1 — 3 items", "t2 — 0 items"]
    assert [r.id for r in overview.theme_drilldown(items, three).collect()] == [2, 1, 3]


def test_documents_are_kept_and_read_back(spark, three):
    directory = shared_folder(spark)
    for text in ("draft\n", "final\n"):
        documents.write_docs(spark.createDataFrame([("theme", 1, text), ("review", 1, "r")], "target_kind string, target_id long, markdown string"), directory)
    assert [r.markdown for r in documents.read_docs(spark, directory, "theme").collect()] == ["final\n"]
    opportunities = spark.createDataFrame([(1, 2.0), (2, 1.0)], "theme_id long, rice_score double")
    joined = documents.with_documents(opportunities, tables.read_table(spark, directory, "documents"))
    assert {r.theme_id: r.draft_prd for r in joined.collect()} == {1: "final\n", 2: None}
    path = shared_folder(spark)
    documents.write_text(documents.read_docs(spark, directory), path)
    assert {(r.target_kind, r.target_id, r.markdown) for r in documents.read_text(spark, path).collect()} == {("theme", 1, "final\n"), ("review", 1, "r")}
