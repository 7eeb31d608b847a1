import random

import duckdb
import pytest

from roadsift.llm import token_rollups as rollups
from roadsift.llm.sql import ORACLES

SCHEMA = "doc_id bigint, source string, lang string, tokenizer string, tokens bigint, operation string, change_no bigint, sign string, documents string"


@pytest.fixture
def changes(spark):
    return lambda *rows: spark.createDataFrame([(*row, "x", "x") for row in rows], SCHEMA)


def replayed(batches):
    """Totals by keeping each document's entry in a dict."""
    entries: dict = {}
    for batch in batches:
        latest: dict = {}
        for doc_id, source, lang, tokenizer, tokens, operation, change_no in batch:
            rank = (change_no, operation, tokens or 0, source or "", lang or "")
            if rank >= latest.get((doc_id, tokenizer), ((-1,),))[0]:
                latest[doc_id, tokenizer] = (rank, operation, (source, lang, tokens or 0))
        for key, (_, operation, entry) in latest.items():
            if operation == "delete":
                entries.pop(key, None)
            elif operation == "insert" or key in entries:
                entries[key] = entry
    totals: dict = {}
    for (_, tokenizer), (source, lang, tokens) in entries.items():
        documents, sum_tokens = totals.get((source, lang, tokenizer), (0, 0))
        totals[source, lang, tokenizer] = (documents + 1, sum_tokens + tokens)
    return {(*group, *counts) for group, counts in totals.items()}


def random_batch(draw, size):
    return [(draw.choice([None, *range(12)]), draw.choice([None, "a", "b"]), draw.choice([None, "en"]), draw.choice(["t1", "t2"]), draw.choice([None, 0, 3, 7]), draw.choice(rollups.OPERATIONS), at) for at in range(size)]


def test_batches_equal_a_replay(spark, changes, tmp_path):
    draw = random.Random(11)
    batches = [random_batch(draw, 25) for _ in range(4)]
    folder = str(tmp_path / "r")
    for at, batch in enumerate(batches):
        assert rollups.apply_batch(spark, folder, f"b{at}", changes(*batch))
        assert not rollups.apply_batch(spark, folder, f"b{at}", changes(*batch))
        assert {tuple(row) for row in rollups.totals(spark, folder).collect()} == replayed(batches[: at + 1])
    into = rollups.compact(spark, folder, str(tmp_path / "c"))
    assert {tuple(row) for row in rollups.totals(spark, into).collect()} == replayed(batches)
    assert not rollups.apply_batch(spark, into, "b1", changes(*batches[1]))
    more = random_batch(draw, 25)
    rollups.apply_batch(spark, into, "more", changes(*more))
    assert {tuple(row) for row in rollups.totals(spark, into).collect()} == replayed([*batches, more])


def test_a_batch_that_breaks_off_is_not_read(spark, changes, tmp_path, monkeypatch):
    folder = str(tmp_path / "r")
    rollups.apply_batch(spark, folder, "one", changes((1, "a", "en", "t", 5, "insert", 0)))
    with monkeypatch.context() as broken:
        broken.setattr(rollups, "_commit", lambda *given: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            rollups.apply_batch(spark, folder, "two", changes((1, "a", "en", "t", 9, "revise", 0)))
    assert [tuple(row) for row in rollups.totals(spark, folder).collect()] == [("a", "en", "t", 1, 5)]
    assert rollups.apply_batch(spark, folder, "two", changes((1, "a", "en", "t", 9, "revise", 0)))
    assert [tuple(row) for row in rollups.totals(spark, folder).collect()] == [("a", "en", "t", 1, 9)]


def test_empty_batches_and_tables(spark, changes, no_docs, odd_docs, tmp_path):
    folder = str(tmp_path / "r")
    assert rollups.totals(spark, folder).collect() == []
    assert rollups.apply_batch(spark, folder, "none", changes((1, "a", "en", "t", 5, "insert", 0)).limit(0))
    assert rollups.totals(spark, folder).collect() == []
    assert rollups.counted(no_docs).collect() == []
    counts = {(row["doc_id"], row["tokenizer"]): row["tokens"] for row in rollups.counted(odd_docs).collect()}
    assert counts[3, "words-1"] == counts[4, "words-1"] == 0 and counts[1, "words-1"] == 6 and counts[1, "pieces-1"] == 7 and counts[6, "words-1"] == 30_000


def test_null_and_repeated_ids_count_as_the_sql_counts_them(spark, make_docs, no_docs):
    docs = make_docs(
        (None, "one two three", "a", "en"), (None, "one two three", "a", "en"), (None, "one two three", "b", "en"), (None, "four, five!", "a", None),
        (2, "x y", "a", "en"), (2, "x y", "a", "en"), (2, "x y z", "b", "de"), (3, "gone", "a", "en"), (3, "gone too", None, "en"),
        (4, "low-quality, text?", "a", "en"), (4, "low-quality, text?", "a", "en"), (5, None, "a", "en"),
    )
    labels = spark.createDataFrame([(3, 1, 1), (4, 0, 0), (3, 0, 0), (None, 0, 1), (9, 0, 1)], "doc_id bigint, quality int, toxic int")
    connection = duckdb.connect()
    for docs_at in (docs, docs.repartition(3), no_docs):
        connection.register("documents", docs_at.select("doc_id", "text", "source", "lang").toArrow())
        connection.register("labels", labels.toArrow())
        want = {tuple(row) for row in connection.execute(ORACLES["op7_token_rollups"]).fetchall()}
        assert {tuple(row) for row in rollups.maintained(docs_at, labels).collect()} == want
    assert sum(row["documents"] for row in rollups.maintained(docs, labels).filter("tokenizer = 'words-1'").collect()) == 10
