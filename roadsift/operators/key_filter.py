"""Blocked Bloom filters of (source, external_id), as tables that Spark aggregates and joins.

A filter is a row per block: eight 64-bit words, in each of which a key of the block sets one bit. A key meets one block
only, so looking keys up is an equi-join of (filter, block) and a test of eight bits, all in columns. Filters hold
KEYS_A_BLOCK keys a block on average; about one in ten thousand other keys then passes.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["source", "external_id"]
WORDS = 8
KEYS_A_BLOCK = 24
_BITS = 6  # a word has 2^6 bits


def blocks_for(keys: int) -> int:
    """How many blocks a filter of so many keys has."""
    return max(1, -(-keys // KEYS_A_BLOCK))


def _block(blocks: int | Column) -> Column:
    return F.pmod(F.xxhash64(*KEY), blocks if isinstance(blocks, Column) else F.lit(blocks).cast("long"))


def _bits() -> list[Column]:
    """For each word the bit that the key sets."""
    mixed = F.xxhash64(*reversed(KEY), F.lit(1))
    places = [F.shiftrightunsigned(mixed, _BITS * at).bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int") for at in range(WORDS)]
    return [F.call_function("shiftleft", F.lit(1).cast("long"), place) for place in places]


def filter_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """block, w0 … w7: the filter of the keys, combined within tasks before the shuffle."""
    rows = keys.select(_block(blocks).alias("block"), *(bit.alias(f"w{at}") for at, bit in enumerate(_bits())))
    return rows.groupBy("block").agg(*(F.bit_or(f"w{at}").alias(f"w{at}") for at in range(WORDS)))


def possible_hits(keys: DataFrame, filters: DataFrame, sizes: Sequence[tuple[str, int]]) -> DataFrame:
    """source, external_id and filter for each filter (of blocks with its name, ``sizes`` having its name and number of
    blocks) that may hold a key; no key that one holds is missing."""
    names = F.array(*(F.struct(F.lit(name).alias("filter"), F.lit(blocks).cast("long").alias("blocks")) for name, blocks in sizes))
    asked = keys.select(*KEY, F.explode(names).alias("of")).select(*KEY, "of.filter", _block(F.col("of.blocks")).alias("block"), *(bit.alias(f"b{at}") for at, bit in enumerate(_bits())))
    found = asked.join(filters, ["filter", "block"])
    for at in range(WORDS):
        found = found.filter(F.col(f"w{at}").bitwiseAND(F.col(f"b{at}")) != 0)
    return found.select(*KEY, "filter")
