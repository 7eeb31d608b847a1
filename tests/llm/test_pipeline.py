import zlib
from collections import Counter

import duckdb
import public_tokenizers
import pytest
import tiktoken
from test_simhash import plain_components, plain_fingerprint

import corpus_pipeline
from checks.compare import canonical, types
from roadsift.llm import bpe, crf, language, queries
from roadsift.llm.sql import ORACLES

DIRECTORY = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark):
    docs = [row.asDict() for row in spark.read.parquet(f"{DIRECTORY}/documents.parquet").collect()]
    learned = [(row["text"], row["lang"]) for row in docs if zlib.crc32(str(row["doc_id"]).encode()) % 4 != 2]
    model = crf.fit(language.sample(spark.createDataFrame(docs)))
    assert {label for _, label in learned} == set(model.labels)
    sums, numbers = crf.Labeler(model).sums([row["text"] for row in docs])
    docs = [row for row, own, n in zip(docs, sums, numbers) if n and own.max() / n >= language.LEAST_SCORE]
    first: dict = {}
    for row in sorted(docs, key=lambda row: row["doc_id"]):
        first.setdefault("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row["text"]), row)
    marks = {row["doc_id"]: plain_fingerprint(row["text"]) for row in first.values()}
    least = plain_components(sorted(set(marks.values())))
    stays: dict = {}
    for row in first.values():
        group = least[marks[row["doc_id"]]]
        stays[group] = min(stays.get(group, row["doc_id"]), row["doc_id"])
    left = {row["doc_id"]: row for row in first.values() if row["doc_id"] in set(stays.values())}
    kept = spark.read.parquet(f"{DIRECTORY}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, DIRECTORY)
    assert sorted(row["doc_id"] for row in kept.collect()) == sorted(left)
    connection = duckdb.connect()
    connection.register("documents", kept.toArrow())
    copies = connection.sql(f"SELECT doc_id, CASE WHEN size > 0 THEN taken // size END FROM ({ORACLES['op3_source_mixing']})").fetchall()
    got = corpus_pipeline.run(spark, DIRECTORY).collect()
    often = Counter(row["doc_id"] for row in got)
    assert all(often[doc_id] == n for doc_id, n in copies if n is not None) and set(often) <= set(left)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(corpus_pipeline.VOCABULARY)), special_tokens={})
    for row in got:
        assert list(memoryview(row["token_ids"]).cast("I")) == library.encode_ordinary(left[row["doc_id"]]["text"]) and row["n_tokens"] == len(row["token_ids"]) // 4


def test_stages_hand_documents_on(odd_docs, spark, no_docs):
    docs, empty = odd_docs.selectExpr("*", "1L AS n_chars"), no_docs.selectExpr("*", "1L AS n_chars")
    for name, stage in corpus_pipeline.STAGES:
        columns = stage(spark, docs, DIRECTORY).columns
        assert columns == corpus_pipeline.COLUMNS or name == corpus_pipeline.STAGES[-1][0]
        assert stage(spark, docs, DIRECTORY).count() <= 3 * docs.count() and stage(spark, empty, DIRECTORY).count() == 0


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_agrees_with_its_sql(spark, name):
    got = queries.QUERIES[name](spark, DIRECTORY).toArrow()
    connection = duckdb.connect()
    for table in ("documents", "pages", "labels"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DIRECTORY}/{table}.parquet'")
    want = connection.sql(ORACLES[name]).to_arrow_table()
    assert types(got) == types(want) and canonical(got) == canonical(want)


def test_every_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))
