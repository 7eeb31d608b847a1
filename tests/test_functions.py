import json
import random
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from roadsift.functions import dates, keys, numbers, replies, text


def test_strip_removes_what_python_strips(column):
    cases = ["  a ", "\t\n b c \r\n", "　x ", "\x1c\x85y\xa0", "", " \t ", "no blanks", None]
    assert column(cases, "string", lambda x: text.strip(x)) == [c.strip() if c is not None else None for c in cases]


def test_whitespace_is_complete():
    assert set(text.WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_cut_counts_code_points(column):
    assert column(["a😀b😀c"], "string", lambda x: text.cut(x, 4)) == ["a😀b😀"]


def test_title_words_break_at_any_non_letter(column):
    cases = ["ui/ux it's", "OFFLINE sync", "a1b", "", "über-öl"]
    assert column(cases, "string", lambda x: text.title_words(x)) == [c.title() for c in cases]


def test_signed(column):
    assert column([5, 0, -2], "bigint", lambda x: text.signed(x)) == ["+5", "+0", "-2"]


def test_score_text_stays_plain(column):
    assert column([34.8, 14.0, 123456789.5, 0.0], "double", lambda x: text.score_text(x)) == ["34.8", "14.0", "123456789.5", "0.0"]


def test_missing_words_and_defaults(column):
    assert column(["NA", "null", "nan", "Nancy", "", None], "string", lambda x: text.missing_to_null(x)) == [None] * 3 + ["Nancy", None, None]
    assert column(["", None, "ann"], "string", lambda x: text.or_default(x, "anonymous")) == ["anonymous", "anonymous", "ann"]


def test_evidence_lines(spark):
    frame = spark.createDataFrame([(7, "bug", 3, "100% broken"), (8, None, None, "x" * 400)], "id long, t string, s int, b string")
    args = [F.col(name) for name in ("id", "t", "s", "b")]
    line, quoted, picker = frame.orderBy("id").select(
        text.evidence_line(*args, 5), text.verbatim_line(*args), text.picker_line(*args)
    ).collect()[0]
    assert (line, quoted) == ("[#7] (bug, sev 3): 100% ", '- **[#7]** (bug, sev 3): "100% broken"')
    assert picker == "#7 · bug · sev 3 · 100% broken"
    second = frame.filter("id = 8").select(text.verbatim_line(*args)).first()[0]
    assert second == '- **[#8]** (None, sev None): "' + "x" * 280 + '"'


def test_guidance_is_empty_when_blank(column):
    blank, given_text = column(["  \n", " go "], "string", lambda x: text.guidance_block(x))
    assert blank == "" and given_text.endswith("\ngo\n")


@pytest.mark.parametrize("digits", [1, 2])
def test_round_even_follows_python_away_from_ties(column, digits):
    draw = random.Random(5)
    values = [draw.randint(0, 10**6) / 997 for _ in range(2000)]
    assert column(values, "double", lambda x: numbers.round_even(x, digits)) == [round(v, digits) for v in values]


def test_round_even_at_exact_ties(column):
    assert column([0.5, 1.5, 2.5, 62.5], "double", lambda x: numbers.round_even(x)) == [0.0, 2.0, 2.0, 62.0]


def test_clamp_keeps_missing(column):
    assert column([None, -1.0, 0.5, 7.0], "double", lambda x: numbers.clamp(x, 0.0, 1.0)) == [None, 0.0, 0.5, 1.0]


def test_theme_count(column):
    assert column([50, 81, 99, 110, 117, 135, 500], "bigint", lambda x: numbers.theme_count(x)) == [4, 4, 6, 6, 6, 8, 8]


def test_whole_rating(column):
    assert column(["4.7", "5", None, "abc", ""], "string", lambda x: numbers.whole_rating(x)) == [4, 5, None, None, None]


def test_percent_text(spark):
    frame = spark.createDataFrame([(5, 8), (0, 0)], "a long, b long")
    assert [r[0] for r in frame.select(numbers.percent_text(F.col("a"), F.col("b"))).collect()] == ["62%", None]


def test_iso_date_shifts_offsets_and_forgives(column):
    cases = ["2024-03-01T00:30:00+02:00", "2024-03-01", "2024-03-01 23:59:59", "not a date", None]
    days = [str(day) if day else None for day in column(cases, "string", lambda x: dates.iso_date(x))]
    assert days == ["2024-02-29", "2024-03-01", "2024-03-01", None, None]


def test_content_id_tells_parts_apart(spark):
    rows = [("ab", "c"), ("a", "bc"), (None, "c"), ("", "c"), ("ab", "c")]
    frame = spark.createDataFrame(rows, "a string, b string")
    ids = [r[0] for r in frame.select(keys.content_id("csv-", F.col("a"), F.col("b"))).collect()]
    assert ids[0] == ids[4] and len(set(ids)) == 4


SPANS = [
    '{"a":3}', 'Sure: {"a":"3"} bye', '{"a":1} tail }', '{"a":1}, {"b":2}', "{'a':1}", '{"a":01}', '{"a":1,}', "{}",
    "} {", "none", "", '{"a": {"b": 1}}', '{"a":1', '{"a":1,"a":"2"}', '{"a": NaN}', '{"a": "x\\ny"}', "[1]", '{"a":tru}',
]


def reference_record(reply):
    start, end = reply.find("{"), reply.rfind("}")
    try:
        return json.loads(reply[start : end + 1])
    except ValueError:
        return None


def test_json_records_are_read_like_python_reads_them(spark):
    frame = spark.createDataFrame(list(enumerate(SPANS)), "i int, reply string")
    rows = replies.with_record(frame, "reply", "a").orderBy("i").collect()
    for row, reply in zip(rows, SPANS, strict=True):
        want = reference_record(reply)
        assert (row["_record"] is None) == (not isinstance(want, dict)), reply


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=string.ascii_letters + '{}[]":,0123456789 \\ntrue', max_size=30), min_size=50, max_size=80))
def test_json_records_on_random_text(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, reply string")
    rows = replies.with_record(frame, "reply", "a").orderBy("i").collect()
    for row, reply in zip(rows, texts, strict=True):
        assert (row["_record"] is None) == (not isinstance(reference_record(reply), dict)), reply
