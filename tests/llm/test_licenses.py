import re

import pytest

from roadsift.llm import licenses

MIT = """/*
 * The MIT License
 *
 * Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal
 * in the Software without restriction, including without limitation the rights
 * to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
 * copies of the Software, and to permit persons to whom the Software is
 * furnished to do so, subject to the following conditions:
 *
 * The above copyright notice and this permission notice shall be included in all
 * copies or substantial portions of the Software.
 */ code()"""


@pytest.fixture(scope="module")
def scanner():
    return licenses.Scanner(licenses.SENTENCES, licenses.RULES, licenses.ANCHORS)


def test_each_rules_own_sentences_are_found(scanner):
    for licence, names in licenses.RULES:
        for glue in (".\n", ". ", ".\n\n# "):
            text = "Some words before.\n" + glue.join(licenses.SENTENCES[name].upper() for name in names) + ".\nAnd after."
            found = scanner.matches(text)
            assert licence in {match[0] for match in found}, (licence, names, glue)


def test_wrapped_paragraphs_and_comment_marks(scanner):
    # The title stands alone in a comment line, so the paragraph's sentences begin behind it.
    assert [match[0] for match in scanner.matches(MIT)] == ["MIT"]
    assert "mit-grant" in scanner.matches(MIT)[0][1]


def test_order_and_gaps_count(scanner):
    source, binary, use = (licenses.SENTENCES[f"bsd-{name}"] for name in ("source", "binary", "redistribute"))
    assert [match[0] for match in scanner.matches(f"{use}: {source}. {binary}.")] == ["BSD-2-Clause"]
    assert scanner.matches(f"{source}. {binary}. {use}:") == []
    assert scanner.matches(f"{use}: {source}. {'far ' * 200}. {binary}.") == []


def test_near_misses_and_plain_mentions_are_left_alone(scanner):
    for text in ("The license of this text is unknown.", "Released under the MIT License plate.", "We like the Apache License, Version 2.0.", "", "licen"):
        assert scanner.matches(text) == []


def test_spans_and_repeats(scanner):
    text = "é words. Released under the MIT License. More.\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License."
    found = scanner.matches(text)
    assert [match[0] for match in found] == ["MIT", "CC-BY-NC-4.0", "MIT"]
    assert text[found[1][2] : found[1][3]] == "Licensed under CC BY-NC 4.0"


def test_whole_table_equals_plain_search(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = []
    for row in docs.collect():
        for name in ("apache-2-notice", "mit-notice", "gpl-3-notice", "cc-by-nc-4-notice"):
            # A known sentence begins a text, a line or follows the end of a sentence, and ends before white space or the end.
            want += [(row["doc_id"], name)] * len(re.findall(rf"(?:^|[.!?;:\n])\s*{re.escape(licenses.SENTENCES[name])}(?=[.!?;:]+(?:\s|$)|\n|$)", row["text"]))
    assert len(want) > 10
    assert sorted((row["doc_id"], row["rule"]) for row in licenses.matches(docs).collect()) == sorted(want)


def test_odd_rows(odd_docs, no_docs, make_docs):
    assert licenses.matches(odd_docs).collect() == [] and licenses.matches(no_docs).collect() == []
    docs = make_docs((None, "Released under the MIT License."), (1, "x\n" * 100_000 + "Released under the MIT License"), (1, "Released under the MIT License"))
    assert sorted((row["doc_id"] or 0, row["license"], row["places"]) for row in licenses.by_document(docs).collect()) == [(0, "MIT", 1), (1, "MIT", 2)]
