import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roadsift.operators import citations
from roadsift.plans import packs


@pytest.fixture
def pool(make_items):
    severities = {7: 4, 50: 4, 140: 4, 149: 4, 166: 4, 179: 4, 46: 3, 26: 3, 9: 2}
    return make_items(*[{"id": i, "severity": s, "theme_id": 35, "body": f"body of {i}"} for i, s in severities.items()], {"id": 1, "severity": 4})


@pytest.fixture
def themes(spark):
    return spark.createDataFrame([(35, "Crashes", "All of them")], "id long, name string, summary string")


def test_cited_ids(spark):
    texts = ["#1 #1 [#2] # 3 #x9 PR#77", "none", "#007 #" + "9" * 30]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, markdown string")
    got = [r[0] for r in frame.orderBy("i").select(citations.cited_ids(F.col("markdown"))).collect()]
    assert got == [["1", "2", "77"], [], ["7", "9" * 30]]


def test_check(spark):
    frame = spark.createDataFrame([("#1 #1 [#2] # 3 #x9 PR#77", [1, 2, 5]), ("#3", None)], "markdown string, ids array<bigint>")
    rows = citations.check_citations(frame, F.col("ids")).collect()
    assert (rows[0].cited, rows[0].valid, rows[0].hallucinated) == (["1", "2", "77"], ["1", "2"], ["77"])
    assert (rows[1].valid, rows[1].hallucinated) == ([], ["3"])


@pytest.mark.parametrize("bounded", [True, False])
def test_siblings(pool, themes, bounded):
    rows = citations.siblings(pool, themes if bounded else None).collect()
    of = lambda target: [r.sibling_id for r in sorted(rows, key=lambda r: r.rank) if r.id == target]
    assert of(149) == [7, 50, 140, 166, 179, 26]
    assert of(9) == [7, 50, 140, 149, 166, 179]
    assert of(1) == []


@pytest.mark.parametrize("limit", [100_000, 0])
def test_pool_is_worst_first_and_bounded(make_items, themes, limit, monkeypatch):
    monkeypatch.setattr("roadsift.operators.small.MAX_SMALL_ROWS", limit)
    items = make_items(*[{"id": at, "theme_id": at % 2, "severity": [None, 1, 2, 3, 4][at % 5]} for at in range(1, 200)]).repartition(9)
    rows = citations.evidence_pool(items, themes, 30).collect()
    for theme in (0, 1):
        ids = sorted((at for at in range(1, 200) if at % 2 == theme), key=lambda at: (-(at % 5), at))[:30]
        assert [r.id for r in sorted(rows, key=lambda r: r.rank) if r.theme_id == theme] == ids


def test_theme_documents_accept_the_shown_pool_only(spark, pool, themes):
    documents = spark.createDataFrame([(35, "see [#7] and #9"), (36, "see #7")], "theme_id long, markdown string")
    rows = {r.theme_id: r for r in citations.check_theme_documents(documents, pool, themes, pool_size=3).collect()}
    assert (rows[35].valid, rows[35].hallucinated, rows[36].hallucinated) == (["7"], ["9"], ["7"])


def test_review_report(spark, pool, themes):
    documents = spark.createDataFrame([(149, " # PRD\n[#149] [#46] [#7] [#1000] [#9] \n")], "item_id long, markdown string")
    checked = citations.check_review_documents(documents, pool, themes)
    (row,) = citations.verification_report(checked, "item_id").collect()
    assert row.markdown == (
        "# PRD\n[#149] [#46] [#7] [#1000] [#9]\n"
        "\n---\n## Citation Verification (automated guardrail)\n- Citations found: **5**\n"
        "- Valid (point to a real review): **2**\n- Hallucinated: **3** - flagged: [9, 46, 1000]\n"
        "\n## Evidence - verbatim from source (rendered from the database, not the model)\n"
        '- **[#7]** (bug, sev 4): "body of 7"\n- **[#149]** (bug, sev 4): "body of 149"\n'
    )
    counters = citations.report_counters(citations.verification_report(checked, "item_id"), "item_id").first()
    assert (counters.n_cited, counters.n_valid, counters.n_hallucinated) == (5, 2, 3)


def test_report_without_valid_citations(spark, pool):
    documents = spark.createDataFrame([(1, "nothing")], "item_id long, markdown string")
    text = citations.verification_report(citations.check_review_documents(documents, pool), "item_id").first().markdown
    assert "- Hallucinated: **0** - none\n\n## Evidence" in text and text.endswith("not the model)\n")


def test_counters_in_both_wordings(spark):
    old = "- Citations found: **15**\n- Valid (point to a real review in this theme): **15**\n- Hallucinated (id not in this theme): **0** — none"
    new = "- Citations found: **1**\n- Valid (point to a real review): **1**\n- Hallucinated: **0** - none"
    frame = spark.createDataFrame([(1, old), (2, new), (3, "draft")], "id int, markdown string")
    rows = citations.report_counters(frame, "id").orderBy("id").collect()
    assert [(r.n_cited, r.n_valid, r.n_hallucinated) for r in rows] == [(15, 15, 0), (1, 1, 0), (None, None, None)]


@pytest.mark.parametrize("limit", [10, 0])
def test_quotes(spark, make_items, limit, monkeypatch):
    monkeypatch.setattr("roadsift.operators.small.MAX_SMALL_ROWS", limit)
    items = make_items({"body": 'it says "no" to me' + "x" * 40000 + " the end"}, {"body": "fine"})
    text = 'A [#1] "to me" and [#2] "fine", [#1] "the end", [#2] "bad"; [#9] "fine"\n#1 "it says" #2 no quote'
    rows = citations.check_quotes(spark.createDataFrame([(5, text)], "doc int, markdown string"), items, "doc").collect()
    assert {(r.item_id, r.quote): r.found for r in rows} == {
        ("1", "to me"): True, ("2", "fine"): True, ("1", "the end"): True, ("2", "bad"): False, ("9", "fine"): False, ("1", "it says"): True,
    }


def test_packs(spark, pool, themes):
    opportunities = spark.createDataFrame([(35, 9, 2.56, 0.85, 2.0, 34.8)], "theme_id long, reach long, impact double, confidence double, effort double, rice_score double")
    text = packs.theme_pack(opportunities, themes, pool, n=2).first().pack
    assert text.startswith("Theme to write about: Crashes\nWhat it is about: All of them\nSize: 9 items; mean severity (1 to 4): 2.56; score: 34.8\n")
    assert text.endswith("[#7] (bug, sev 4): body of 7\n[#50] (bug, sev 4): body of 50\n")
    by_id = {r.id: r.pack for r in packs.review_pack(pool, themes, guidance="go").collect()}
    assert '"""body of 149"""\n\nRelated' in by_id[149] and by_id[149].count("[#") == 7
    assert "Related" not in by_id[1] and by_id[1].endswith("go\n")


def test_memo(spark):
    roadmap = spark.createDataFrame([("1. A",)], "roadmap string")
    opinions = spark.createDataFrame([(2, "Finance", "no"), (1, "Growth", "yes")], "position int, role string, opinion string")
    text = packs.memo_markdown(roadmap, opinions, "We do A.").first().markdown
    assert text == "# Prioritization Boardroom — Decision Memo\n\n## Roadmap considered\n1. A\n\n# Panel debate\n## Growth\nyes\n\n## Finance\nno\n\n---\nWe do A.\n"


def test_an_item_quoted_by_thousands_is_scanned_once_per_part(spark, make_items, monkeypatch):
    body = "".join(chr(97 + at * at % 23) + (" " if at % 5 == 0 else "") for at in range(400)) + "é漢字 и слово"
    items = make_items({"id": 1, "body": body}, {"id": 2, "body": "another text that is long enough"})
    quoted = sorted({body[at : at + 1 + at % 9] for at in range(len(body))} | {f"not there {at}" for at in range(300)} | {"и слово", "漢字"})
    rows = [(at, f'[#{1 + (at % 50 == 0)}] "{quote}"') for at, quote in enumerate(quoted)]
    documents = spark.createDataFrame(rows, "doc int, markdown string")
    found = {row["doc"]: row["found"] for row in citations.check_quotes(documents, items, "doc", quotes_a_scan=100).collect()}
    bodies = {1: body, 2: "another text that is long enough"}
    assert found == {at: quote in bodies[1 + (at % 50 == 0)] for at, quote in enumerate(quoted)}
    scans = []
    monkeypatch.setattr(citations, "held_in", lambda body, quoted: scans.append(len(quoted)) or set())
    batch = pa.RecordBatch.from_pylist([{"item_id": "1", "quotes": quoted, "body": body}, {"item_id": "2", "quotes": ["x"], "body": None}])
    assert sum(part.num_rows for part in citations._scanned(iter([batch]))) == len(quoted) + 1 and scans == [len(quoted), 1]


def test_quotes_and_texts_meet_in_one_shuffle(spark, make_items, monkeypatch):
    monkeypatch.setattr("roadsift.operators.small.MAX_SMALL_ROWS", 0)
    items = make_items({"id": 1, "body": "some text"}, {"id": 1, "body": "other words"}, {"id": 2, "body": None}, {"id": 3, "body": "uncited"})
    said = '[#1] "some" #1 "some" #01 "other" #1 "text other" #2 "x"'
    documents = spark.createDataFrame([(1, 7, said), (1, 7, said), (None, 7, '#1 "some"')], "doc int, no int, markdown string")
    for size in (5000, 1):
        checked = citations.check_quotes(documents, items, "doc", "no", quotes_a_scan=size)
        one = [(1, 7, "1", "other", True), (1, 7, "1", "some", True), (1, 7, "1", "text other", False), (1, 7, "2", "x", False)]
        assert sorted(tuple(row) for row in checked.filter("doc = 1").collect()) == one
        assert [tuple(row) for row in checked.filter("doc IS NULL").collect()] == [(None, 7, "1", "some", True)]
    plan = citations.check_quotes(documents, items, "doc", "no")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
