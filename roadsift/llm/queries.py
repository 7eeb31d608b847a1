"""The registered queries of the corpus operators; each reads its whole table."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from roadsift.llm import bpe, divergence, exact_dedup, fingerprints, infilling, language, licenses, mixing, packing, simhash, token_rollups, url_filter, warc
from roadsift.llm.sql import ORACLES  # noqa: F401  for the driver contract

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def _table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


VOCABULARY = "byte_bpe_multi_50k.tiktoken"
PACKING_VOCABULARY = "byte_bpe_50k.json"


@query
def op1_document_fingerprints(spark, directory):
    return fingerprints.fingerprints_with_neighbours(_table(spark, directory, "documents"))


@query
def op2_simhash_near_dedup(spark, directory):
    return simhash.near_duplicates(_table(spark, directory, "documents"))


@query
def op3_source_mixing(spark, directory):
    return mixing.decisions(_table(spark, directory, "documents"))


@query
def op4_language_id(spark, directory):
    return language.identified(_table(spark, directory, "documents"))


@query
def op5_exact_dedup(spark, directory):
    return exact_dedup.decisions(_table(spark, directory, "documents"), keep="largest")


@query
def op8_byte_level_bpe(spark, directory):
    return bpe.digests(_table(spark, directory, "documents"), public_tokenizers.path(VOCABULARY))


@query
def op6_warc_archive(spark, directory):
    return warc.round_trip(_table(spark, directory, "pages"))


#: The listed hosts and paths.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query
def op10_url_filter(spark, directory):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judged(_table(spark, directory, "pages"), rules)


@query
def op7_token_rollups(spark, directory):
    return token_rollups.maintained(_table(spark, directory, "documents"), _table(spark, directory, "labels"))


@query
def op9_license_scan(spark, directory):
    return licenses.matches(_table(spark, directory, "documents"))


@query
def op13_fill_in_middle(spark, directory):
    return infilling.digests(_table(spark, directory, "documents"))


@query
def op11_best_fit_packing(spark, directory):
    return packing.layout(_table(spark, directory, "documents"), public_tokenizers.path(PACKING_VOCABULARY))


@query
def op12_source_divergence(spark, directory):
    return divergence.audit(_table(spark, directory, "documents"))
