"""URL filtering: a blocked Bloom filter passes possible hits to an exact join with the listed URLs.

A listed entry is a host and a path; it fits URLs of its host and all subdomains whose path starts with the entry's. So a
URL has one candidate key per host suffix and listed path length. The keys of all entries fill a Bloom filter whose
bits for a key lie in one block of 512; candidates that pass it are joined with the entries on the exact key, which
removes the false positives. The longest entry wins; among equally long ones that of the longer host, then a block.

A URL's host runs from behind the first ``://`` to the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; its path
from there to ``?``, ``#`` or the end. Null, and no ``://``, have both empty. A URL that no entry fits gets ``default``.

Scale: the filter is built in Spark, block by block, and its size is fixed by the number of entries up to
``MOST_BLOCKS``; beyond that it lets more through, and the join stays exact. Candidates are judged once per distinct
URL. The entries are broadcast only if there are few (counted), otherwise the join is an ordinary one.

Defined results: null ids are rows like any other; repeated rows are judged alike; empty tables give empty results; entries
without a host fit nothing; other columns are left alone.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadsift.llm.texts import UPPER
from roadsift.session import written

#: The filter: 64-byte blocks, so many keys to a block, so many bits set per key, and at most 64 MiB in all.
KEYS_PER_BLOCK = 32
BITS_PER_KEY = 8
MOST_BLOCKS = 1 << 20
#: Entries that are broadcast; more are joined with a shuffle.
FEW = 100_000

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def suffixes(host: Column, most: int) -> Column:
    """The host and the hosts above it, as far as they have at most so many labels."""
    labels = F.split(host, r"\.")
    last = F.slice(labels, F.greatest(F.lit(1), F.size(labels) - most + 1), F.lit(most))
    return F.transform(F.sequence(F.lit(1), F.size(last)), lambda at: F.array_join(F.slice(last, at, F.size(last)), "."))


def _key(host: Column, path: Column) -> Column:
    """Neither part of a URL can hold a line feed once it is escaped, so keys of different parts differ."""
    return F.concat_ws("\n", F.replace(host, F.lit("\n"), F.lit("%0A")), F.replace(path, F.lit("\n"), F.lit("%0A")))


def _bits(key_hash: Column) -> Column:
    """The positions of a key in its block."""
    return F.transform(F.sequence(F.lit(0), F.lit(BITS_PER_KEY - 1)), lambda at: F.pmod(F.xxhash64(key_hash, at), F.lit(512)).cast("int"))


def bloom_filter(entries: DataFrame, count: int) -> np.ndarray:
    """The filter of the entries' keys as (blocks, 512) bits, packed; its size depends on the count alone."""
    blocks = min(MOST_BLOCKS, max(1, -(-count // KEYS_PER_BLOCK)))
    placed = entries.select(F.xxhash64("key").alias("h")).select(F.pmod("h", F.lit(blocks)).cast("int").alias("block"), F.explode(_bits(F.col("h"))).alias("bit"))
    words = placed.select("block", (F.col("bit") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, bit % 64)").alias("mask"))
    bits = np.zeros((blocks, 8), np.int64)
    filled = words.groupBy("block", "word").agg(F.bit_or("mask").alias("mask")).toArrow()  # bounded by MOST_BLOCKS
    bits[filled.column("block").to_numpy(), filled.column("word").to_numpy()] = filled.column("mask").to_numpy()
    return bits


def possible(bits: np.ndarray, block: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Whether all of each key's bits are set; ``positions`` has a row per key."""
    words = bits[block[:, None], positions // 64]
    return ((words >> (positions % 64)) & 1).astype(bool).all(axis=1)


def prepared(rules: DataFrame) -> DataFrame:
    """The rules (host, path, verdict) with their key, length and text; of equal ones a block goes before an allow."""
    host = F.translate(F.coalesce("host", F.lit("")), UPPER, UPPER.lower())
    listed = rules.select(host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").filter("host <> ''")
    best = listed.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # "block" sorts behind "allow"
    text = F.concat("host", "path")
    return best.select(_key(F.col("host"), F.col("path")).alias("key"), text.alias("rule"), F.length("path").alias("path_length"), F.size(F.split("host", r"\.")).alias("labels"), F.struct(F.length(text).alias("length"), F.length("host").alias("host_length"), "verdict", text.alias("rule")).alias("rank"))


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict per row of ``pages``."""
    listed = written(prepared(rules))
    count, labels = listed.agg(F.count(F.lit(1)), F.coalesce(F.max("labels"), F.lit(1))).first()
    lengths = [row[0] for row in listed.select("path_length").distinct().orderBy("path_length").collect()]  # bounded: a URL's length
    bits = pages.sparkSession.sparkContext.broadcast(bloom_filter(listed, count))
    blocks = len(bits.value)

    @F.pandas_udf("boolean")
    def may_be_listed(block: pd.Series, positions: pd.Series) -> pd.Series:
        if not len(block):
            return pd.Series([], dtype=bool)
        return pd.Series(possible(bits.value, block.to_numpy(), np.stack(positions.to_numpy())))

    rows = pages.select(pages["page_id"].alias("page_id"), pages["url"].alias("url"), host_of(pages["url"]).alias("host"), path_of(pages["url"]).alias("path"))
    urls = rows.filter("host <> ''").select("host", "path").distinct()
    heads = F.array(*(F.when(F.length("path") >= length, F.substring("path", 1, length)) for length in lengths)) if lengths else F.array().cast("array<string>")
    candidates = urls.withColumn("of", F.explode(suffixes(F.col("host"), labels))).withColumn("head", F.explode(F.array_compact(heads)))
    hashed = candidates.select("host", "path", _key(F.col("of"), F.col("head")).alias("key")).withColumn("h", F.xxhash64("key"))
    passed = hashed.filter(may_be_listed(F.pmod("h", F.lit(blocks)).cast("int"), _bits(F.col("h"))))
    entries = listed.select("key", "rank")
    hits = passed.join(F.broadcast(entries) if count <= FEW else entries, "key")
    best = hits.groupBy("host", "path").agg(F.max("rank").alias("rank"))
    return rows.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("rank.rule").alias("rule"), F.coalesce("rank.verdict", F.lit(default)).alias("verdict"))
