from datetime import datetime

import pytest

from roadsift.operators import drift, scoring


@pytest.fixture
def themes(spark):
    return spark.createDataFrame([(1, "Crashes", "s"), (2, "Empty", "s"), (3, "Slow", "s")], "id long, name string, summary string")


def test_rice_of_a_known_theme(make_items, themes):
    rows = [{"theme_id": 1, "severity": 3 if at < 18 else 2, "confidence": 0.85} for at in range(32)]
    scored = {r.theme_id: r for r in scoring.rice(make_items(*rows), themes).collect()}
    assert (scored[1].reach, scored[1].impact, scored[1].confidence, scored[1].effort, scored[1].rice_score) == (32, 2.56, 0.85, 2.0, 34.8)
    assert (scored[2].reach, scored[2].impact, scored[2].confidence, scored[2].rice_score) == (0, 0.0, 0.0, 0.0)


def test_reset_items_count_in_reach_but_not_in_averages(make_items, themes):
    items = make_items({"theme_id": 1, "severity": 4, "confidence": 1.0}, {"theme_id": 1}, {"theme_id": 3})
    scored = {r.theme_id: r for r in scoring.rice(items, themes).collect()}
    assert (scored[1].reach, scored[1].impact) == (2, 4.0)
    assert (scored[3].reach, scored[3].impact, scored[3].rice_score) == (1, 0.0, 0.0)


def test_effort_overrides(spark, make_items, themes):
    efforts = spark.createDataFrame([(1, 4.0)], "theme_id long, effort double")
    items = make_items({"theme_id": 1, "severity": 4, "confidence": 1.0}, {"theme_id": 3, "severity": 4, "confidence": 1.0})
    scored = {r.theme_id: r for r in scoring.rice(items, themes, efforts).collect()}
    assert (scored[1].effort, scored[1].rice_score, scored[3].effort, scored[3].rice_score) == (4.0, 1.0, 2.0, 2.0)


def test_roadmap_order_lines_and_cleared_themes(spark, themes):
    opportunities = spark.createDataFrame(
        [(3, 10, 2.9, 0.88, 2.0, 12.8), (1, 32, 2.56, 0.85, 2.0, 34.8), (2, 11, 3.0, 0.85, 2.0, 12.8), (9, 1, 1.0, 1.0, 2.0, 99.0)],
        "theme_id long, reach long, impact double, confidence double, effort double, rice_score double",
    )
    assert [r.theme_id for r in scoring.roadmap(opportunities, themes).collect()] == [1, 2, 3]
    assert scoring.top_opportunity(opportunities, themes).first().name == "Crashes"
    assert scoring.roadmap_text(opportunities, themes).first().roadmap.splitlines()[:2] == [
        "1. Crashes — reach 32, impact 2.56/4, effort 2.0w, RICE 34.8",
        "2. Empty — reach 11, impact 3.0/4, effort 2.0w, RICE 12.8",
    ]
    assert [r.name for r in scoring.score_printout(opportunities, themes).collect()] == ["Crashes", "Slow", "Empty"]


def on(day, theme=1):
    return {"created_at": datetime(2024, 3, day, 12) if day else None, "theme_id": theme}


def test_window_edges(make_items, themes):
    items = make_items(on(28, None), on(21), on(22), on(14), on(15), on(27, 3))
    rows = {r.theme_id: r for r in drift.drift(items, themes).collect()}
    assert (rows[1].recent, rows[1].previous, rows[1].change, rows[1].direction) == (1, 2, -1, "Cooling")
    assert (rows[3].recent, rows[3].previous, rows[3].direction) == (1, 0, "Rising")
    assert str(rows[1].anchor) == "2024-03-28" and 2 not in rows


def test_no_dates(make_items, themes):
    (row,) = drift.drift(make_items(on(None), on(None)), themes).collect()
    assert (row.recent, row.previous, row.change, row.direction, row.anchor) == (0, 0, 0, "Flat", None)


def test_brief(spark, make_items, themes):
    items = make_items(on(28), on(27), on(20), on(20, 3), on(19, 3))
    top = spark.createDataFrame([("Crashes", 34.8)], "name string, rice_score double")
    sections = drift.brief_sections(drift.drift(items, themes), top)
    row = sections.first()
    assert (row.total_recent, row.rising, row.cooling) == (2, "- **Crashes** (+1)", "- **Slow** (-2)")
    assert row.movement == "- Crashes: 1 → 2 (+1)\n- Slow: 2 → 0 (-2)"
    text = drift.brief_markdown(sections, "All well.").first().markdown
    assert text.startswith("# State of Feedback — week ending 2024-03-28\n\n*2 actionable items this week.*\n\n## Summary\nAll well.\n\n## Rising")
    assert "Summary" not in drift.brief_markdown(sections).first().markdown


def test_brief_without_movement(spark, make_items, themes):
    top = spark.createDataFrame([], "name string, rice_score double")
    row = drift.brief_sections(drift.drift(make_items({}), themes), top).first()
    assert (row.rising, row.cooling, row.movement, row.total_recent, row.top_theme) == ("- (none)", "- (none)", "", 0, None)
