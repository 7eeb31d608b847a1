"""Exact deduplication by 128-bit content hash, with the bytes compared inside the groups; DataFrame functions only.

Texts are equal when identical after lower-casing A-Z. A null text counts as empty, so null and empty texts are one
group. Rows without an id yield to any row with one. A row given twice (same id, equal text) counts twice in the group
and stays once. An empty table gives an empty result, and other columns, whatever their names, are left alone.

Scale: texts meet once, as keys of an aggregate that combines the copies within each task first, so a group with a third
of all rows sends one row per task. What follows is narrow (id, hash), and the join that gives each document its group is
an ordinary one that adaptive execution splits where a hash is hot.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadsift.llm.texts import lowered, whole_rows
from roadsift.session import written


def content_hash(body: Column) -> Column:
    """128 bits of the normalised text."""
    return F.unhex(F.md5(body))


def groups(docs: DataFrame, keep: str = "smallest", digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per distinct normalised text: ``hash``, ``body``, ``keep_id``, ``group_size``.

    ``body`` is null unless another text has the same hash: only then is the text needed to tell them apart.
    """
    pick = {"smallest": F.min, "largest": F.max}[keep]
    body = lowered(docs["text"])
    rows = docs.select(digest(body).alias("hash"), body.alias("body"), docs["doc_id"].alias("doc_id"))
    texts = rows.groupBy("hash", "body").agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    by_hash = written(texts.groupBy("hash").agg(F.count(F.lit(1)).alias("texts"), pick("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")))
    alone = by_hash.filter("texts = 1").select("hash", F.lit(None).cast("string").alias("body"), "keep_id", "group_size")
    collided = by_hash.filter("texts > 1").select("hash")
    if collided.isEmpty():
        return alone
    told_apart = rows.join(collided, "hash", "left_semi").groupBy("hash", "body").agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return alone.unionByName(written(told_apart))


def decisions(docs: DataFrame, keep: str = "smallest", digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    return (
        _judged(docs, keep, digest)
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select("doc_id", "keep_id", "group_size", (F.col("stays") & (F.col("copy") == 1)).alias("kept"), "text_sha256")
    )


def deduplicated(docs: DataFrame, keep: str = "smallest", digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """The rows of ``docs`` that stay, one for each distinct text, with all their columns.

    Where a kept row is given twice and its copies differ in other columns, the first by their JSON form stays.
    """
    body = lowered(docs["text"])
    rows = whole_rows(docs, doc_id=docs["doc_id"], hash=digest(body), text_sha256=F.sha2(body, 256))
    judged = _judged(docs, keep, digest).filter(~F.col("stays") | (F.col("copies") > 1))
    # Grows with the input, so it is joined by one plan at every size: shuffled, and hashed rather than the texts sorted.
    settled = written(judged.select("doc_id", "hash", "text_sha256", "stays")).hint("shuffle_hash")

    def same(left: DataFrame, right: DataFrame) -> Column:
        return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["hash"] == right["hash"]) & (left["text_sha256"] == right["text_sha256"])

    plain = rows.join(settled, same(rows, settled), "left_anti").select("row.*")
    twice = settled.filter("stays")
    if twice.isEmpty():
        return plain
    repeated = rows.join(twice, same(rows, twice), "left_semi").groupBy("doc_id", "hash", "text_sha256")
    return plain.union(repeated.agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*"))


def _judged(docs: DataFrame, keep: str, digest: Callable[[Column], Column]) -> DataFrame:
    """Each (doc_id, text) with the number of its rows, its group, and whether it is the one that stays."""
    classes = groups(docs, keep, digest)
    body = lowered(docs["text"])
    narrow = docs.select(docs["doc_id"].alias("doc_id"), digest(body).alias("hash"), F.sha2(body, 256).alias("text_sha256"), body.alias("body"))
    keys = ["doc_id", "hash", "text_sha256"]
    alone = classes.filter("body IS NULL").drop("body")
    rivals = classes.filter("body IS NOT NULL")
    judged = narrow.groupBy(keys).agg(F.count(F.lit(1)).alias("copies")).join(alone, "hash")
    if not rivals.isEmpty():
        among = narrow.join(rivals.select("hash").distinct(), "hash", "left_semi").groupBy(*keys, "body").agg(F.count(F.lit(1)).alias("copies"))
        judged = judged.unionByName(among.join(rivals, ["hash", "body"]).drop("body"))
    return judged.withColumn("stays", F.col("doc_id").eqNullSafe(F.col("keep_id")))
