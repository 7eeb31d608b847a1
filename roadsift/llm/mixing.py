"""Mixing sources to target weights by Pareto order sampling.

A document's size is its number of words. Sources, in code point order with null last, weigh 1, 2, 3 and so on again, and
share all words by weight; no target exceeds three times its source's size, what is above goes to the others by weight.
A document is expected target / source size times (weighted by its ``value`` where the caller gives one): the whole
part is certain copies, the rest p is the probability of one more. For these each document draws u, its rank is
[u / (1 - u)] / [p / (1 - p)], and the first in rank order are taken up to the fixed size, which is counted in words: the last
document is taken if that comes nearer to the target. u is a hash of the seed and the id, so reruns agree.

Scale: no sort of the documents. The place in rank order where a source reaches its target is found in two histograms of
4096 bins, summed within tasks, and exactly among the rows of one bin in 2^24. All that is joined to the documents
is one row per source.

Defined results: a null text has size 0; null ids draw by their text's hash; repeated rows of an id draw alike and are taken
together; sources of size 0 have target 0; an empty table gives an empty result; other columns are left alone.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadsift.llm.texts import whole_rows, words
from roadsift.session import written

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
SEED = 7
BINS = 4096


def drawn(docs: DataFrame, seed: int) -> Column:
    """A number in (0, 1) by the hash of the id, or of the text where there is none."""
    known_by = F.coalesce(docs["doc_id"].cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(docs["text"], F.lit("")))))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), known_by)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``sizes`` (source, source_size, with one row per source) with the ``target`` of each."""
    in_order = Window.orderBy(F.asc_nulls_last("source"))
    place = (F.row_number().over(in_order) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.get(F.array(*map(F.lit, weights)), place)).withColumn("cap", F.col("source_size") * most)
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    everything = Window.partitionBy()
    full = F.coalesce(F.sum("cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    # Sources whose cap comes first are filled; the level of the first that is not filled holds for it and all after it.
    leveled = weighed.withColumn("level", (F.sum("source_size").over(everything) - full) / left)
    capped = F.col("cap") / F.col("weight") <= F.col("level")
    level = F.max(F.when(~capped, F.col("level"))).over(everything)
    return leveled.withColumn("target", F.when(capped, F.col("cap").cast("double")).otherwise(level * F.col("weight"))).select("source", "source_size", "target")


def _items(docs: DataFrame, seed: int, value: str | None) -> dict[str, Column]:
    return {
        "doc_id": docs["doc_id"],
        "source": docs["source"],
        "size": words(docs["text"]),
        "u": drawn(docs, seed),
        "value": F.lit(1.0) if value is None else F.coalesce(docs[value].cast("double"), F.lit(0.0)),
    }


def _ranked(items: DataFrame, plan: DataFrame, most: int) -> DataFrame:
    """The items with their source's plan, certain copies, rank and bin."""
    expected = F.least(F.lit(float(most)), F.when(F.col("worth") > 0, F.col("value") * F.col("target") / F.col("worth")).otherwise(0.0))
    plan = plan.withColumnRenamed("source", "of_source")
    joined = items.join(plan, items["source"].eqNullSafe(plan["of_source"])).drop("of_source").withColumn("expected", expected)
    p = F.col("expected") - F.floor("expected")
    rank = F.when(p > 0, (F.col("u") / (1 - F.col("u"))) / (p / (1 - p)))
    ranked = joined.withColumn("certain", F.floor("expected")).withColumn("rank", rank)
    return ranked.withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * (BINS * BINS)))


def _crossing(ranked: DataFrame, level: Column) -> DataFrame:
    """(source, crossed, before): for each source the first value of ``level`` at which its words reach what is to be
    drawn, and the words before it."""
    summed = ranked.filter("rank IS NOT NULL").groupBy("source", "rest", "before", level.alias("crossed")).agg(F.sum("size").alias("own"))
    so_far = F.col("before") + F.sum("own").over(Window.partitionBy("source").orderBy("crossed"))
    reached = summed.withColumn("so_far", so_far).filter((F.col("rest") > 0) & (F.col("so_far") >= F.col("rest")))
    first = reached.groupBy("source").agg(F.min(F.struct("crossed", (F.col("so_far") - F.col("own")).alias("before"))).alias("first"))
    return written(first.select("source", "first.crossed", "first.before"))


def _within(ranked: DataFrame, crossing: DataFrame, level: Column) -> DataFrame:
    """The rows at their source's crossing."""
    crossing = crossing.withColumnRenamed("source", "of_source")
    rows = ranked.drop("before").withColumn("level", level)
    return rows.join(crossing, rows["source"].eqNullSafe(crossing["of_source"]) & (F.col("level") == F.col("crossed"))).drop("of_source", "level", "crossed")


def _plan(items: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """One row per source: source_size, target, worth, and where in rank order its sample ends (last_bin, last)."""
    sizes = items.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("value") * F.col("size")).alias("worth"))
    sizes = written(sizes)
    worth = sizes.select(F.col("source").alias("of_source"), "worth")
    aims = targets(sizes.select("source", "source_size"), weights, most)
    plan = written(aims.join(worth, aims["source"].eqNullSafe(worth["of_source"])).drop("of_source"))
    ranked = _ranked(items, plan, most)
    certain = written(ranked.groupBy("source").agg(F.sum(F.col("certain") * F.col("size")).alias("sure")).withColumnRenamed("source", "of_source"))
    rested = ranked.join(certain, ranked["source"].eqNullSafe(certain["of_source"])).drop("of_source")
    rested = rested.withColumn("rest", F.col("target") - F.col("sure")).withColumn("before", F.lit(0).cast("long"))
    coarse = F.floor(F.col("bin") / BINS)
    near = _within(rested, _crossing(rested, coarse), coarse)
    fine = _crossing(near, F.col("bin"))
    last = _within(near, fine, F.col("bin"))
    in_rank = Window.partitionBy("source").orderBy("rank", F.asc_nulls_first("doc_id"))
    own = F.sum("size").over(Window.partitionBy("source", "rank", "doc_id"))
    so_far = F.col("before") + F.sum("size").over(in_rank)  # rows alike in rank and id come together
    over = so_far - F.col("rest")
    taken = last.withColumn("fits", (over <= 0) | (over <= F.col("rest") - (so_far - own)) & (so_far - own < F.col("rest"))).filter("fits")
    ends = taken.groupBy("source").agg(F.max(F.struct("rank", "doc_id")).alias("last"))
    ends = fine.select("source", F.col("crossed").alias("last_bin")).join(ends.withColumnRenamed("source", "of_source"), F.col("source").eqNullSafe(F.col("of_source")), "left").drop("of_source")
    ends = ends.withColumnRenamed("source", "of_source")
    return written(plan.join(ends, plan["source"].eqNullSafe(ends["of_source"]), "left").drop("of_source"))


def _with_copies(items: DataFrame, plan: DataFrame, most: int) -> DataFrame:
    """The items with ``copies``. A source that no crossing ends takes all its extra copies, or none is to be drawn."""
    ranked = _ranked(items, plan, most)
    here = F.struct("rank", "doc_id")
    extra = (F.col("bin") < F.col("last_bin")) | (F.col("bin") == F.col("last_bin")) & (here <= F.col("last"))
    return ranked.withColumn("copies", (F.col("certain") + F.coalesce(extra, F.lit(False)).cast("long")).cast("long"))


def decisions(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED, value: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target (its source's words) and taken (its words in the mix) per row of ``docs``."""
    items = written(docs.select(*(column.alias(name) for name, column in _items(docs, seed, value).items())))
    mixed = _with_copies(items, _plan(items, weights, most), most)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED, value: str | None = None) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them."""
    columns = _items(docs, seed, value)
    plan = _plan(written(docs.select(*(column.alias(name) for name, column in columns.items()))), weights, most)
    columns.pop("size")  # decided already: the texts are not counted again
    rows = whole_rows(docs, **columns)
    often = _with_copies(rows, plan, most).filter("copies > 0")
    return often.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("row.*")
