import pytest

#: Columns whose names the operators use inside.
CLASHING = ["row", "hash", "fp", "at", "size", "kept", "rank", "token_ids", "score", "copies", "u", "value"]


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text[, source[, lang]]), with further columns whose names clash with the operators' own."""

    def build(*rows):
        filled = [(row + (None,) * (4 - len(row)))[:4] for row in rows]
        schema = "doc_id bigint, text string, source string, lang string" + "".join(f", `{name}` string" for name in CLASHING)
        return spark.createDataFrame([(*row, *CLASHING) for row in filled], schema)

    return build


@pytest.fixture
def odd_docs(make_docs):
    """Nulls everywhere, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"wort{at % 977}x{at}" for at in range(30_000))
    return make_docs(
        (1, "One two three four five six."), (2, "one TWO three four five six."), (3, None), (4, ""), (5, " \n\t "), (6, long, "a", "de"),
        (7, long + " end", "a", "de"), (None, "One two three four five six."), (None, None), (8, "x"), (9, "x"), (9, "x"), (10, "été été ÉTÉ", None, "fr"),
        (11, "1234 5678 !!"), (12, "漢字かな交じり文", "b", None), (13, "\U0001f600 \x00   end", "b", ""),
    )


@pytest.fixture
def no_docs(make_docs):
    return make_docs().limit(0)
