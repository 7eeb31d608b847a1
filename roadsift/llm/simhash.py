"""Near-duplicates by SimHash, found with vantage-point trees over the fingerprints.

A text is lower-cased (A-Z only) and cut into words at ASCII white space; its shingles are all runs of three words,
repeats included, or the whole sequence if it has fewer. A bit of the 64-bit fingerprint is set if more than half of
the shingles' XXH64 values (seed 42) have it set. Texts without words, null among them, have fingerprint zero. Two
fingerprints link when they differ in two bits or fewer, and linked documents form one component.

Search: a tree of vantage points, fitted to a bounded sample of the distinct fingerprints, cuts the space into shards.
A node with vantage v and radius m sends points with d(v, x) > m to its outer shard and points with d(v, x) <= m + r
to its inner one, r being the linking distance: by the triangle inequality, a pair that the sphere separates lies
within r of it, so the outer partner is in both shards and the pair is met in the inner one. No link is lost, whatever
the tree. Within a shard the same cut goes on, in memory, down to blocks that are compared pair by pair.

Scale: copies fold into one row per fingerprint before any search. A shard reports a spanning forest of its links, at
most one row per fingerprint, never the pairs. Components over shards come from contracting these forests by joins.

Defined results: null ids are rows like any other, but an id is preferred as the component's; tied and repeated rows
are in one component; an empty table gives an empty result; other columns are left alone.
"""

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadsift.llm.texts import text_key, utf8, whole_rows
from roadsift.session import written

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Shingles whose bits are counted at a time; bounds the memory for a very long text.
STRIDE = 65_536
#: The tree is fitted to about this many distinct fingerprints (8 bytes each) and sent to every task.
SAMPLE = 262_144
#: Fingerprints that a shard should hold. Too small a sample for that gives larger shards, never lost links.
SHARD = 20_000
#: Points within a task that are compared pair by pair rather than divided further.
BLOCK = 512
#: Links gathered within a task before they are folded into labels.
BUFFER = 500_000


# Fingerprints


def fingerprint(text: bytes) -> int:
    """The fingerprint of one text in UTF-8."""
    words = text.lower().split()  # for bytes both know ASCII only
    if not words:
        return 0
    width = min(SHINGLE, len(words))
    total = len(words) - width + 1
    counts = np.zeros(64, np.int64)
    for start in range(0, total, STRIDE):
        piece = words[start : min(start + STRIDE, total) + width - 1]
        shingles = map(b" ".join, zip(*(piece[at:] for at in range(width))))
        values = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(piece) - width + 1)
        counts += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def _signed(values) -> np.ndarray:
    return np.asarray(values, np.uint64).view(np.int64)


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.fromiter((fingerprint(text.as_py()) for text in batch.column("text")), np.uint64, batch.num_rows)
        others = [name for name in batch.schema.names if name != "text"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, others), pa.array(_signed(values))], names=[*others, "fp"])


def fingerprints(docs: DataFrame, **computed: Column) -> DataFrame:
    """doc_id, computed columns and ``fp``, the fingerprint's 64 bits as a long, per row; reads whole texts."""
    own = docs.select(docs["doc_id"].alias("doc_id"), *(column.alias(name) for name, column in computed.items()))
    texts = docs.select(docs["doc_id"].alias("doc_id"), *(column.alias(name) for name, column in computed.items()), utf8(docs["text"]).alias("text"))
    return texts.mapInArrow(_fingerprint_batches, ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in own.schema) + ", fp bigint")


# Vantage-point trees


#: The work in a set of n points is taken to grow as n to this power when cuts are weighed.
POWER = 1.5


def _cut(points: np.ndarray, radius: int) -> tuple[np.uint64, int] | None:
    """The vantage point and radius that divide the points most cheaply, or None if no cut saves work."""
    best, choice = 0.97 * float(len(points)) ** POWER, None
    for vantage in points[:: max(1, len(points) // 4)][:4]:
        within = np.cumsum(np.bincount(np.bitwise_count(points ^ vantage), minlength=65 + radius)).astype(float)
        cost = within[radius : 65 + radius] ** POWER + (len(points) - within[:65]) ** POWER
        at = int(cost.argmin())
        if cost[at] < best:
            best, choice = cost[at], (vantage, at)
    return choice


def fit_tree(sample: np.ndarray, leaf: int, radius: int = RADIUS) -> list[tuple]:
    """Nodes (vantage, radius, inner, outer), or (shard,) for a leaf; the first is the root."""
    nodes: list[tuple] = [()]
    todo, shards = [(0, np.unique(sample))], 0
    while todo:
        at, points = todo.pop()
        chosen = _cut(points, radius) if len(points) > leaf else None
        if chosen is None:
            nodes[at] = (shards,)
            shards += 1
            continue
        distance = np.bitwise_count(points ^ chosen[0])
        nodes[at] = (*chosen, len(nodes), len(nodes) + 1)
        todo += [(len(nodes), points[distance <= chosen[1] + radius]), (len(nodes) + 1, points[distance > chosen[1]])]
        nodes += [(), ()]
    return nodes


def route(nodes: list[tuple], points: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, its points): the shard each point lies in, and those whose inner side it may have a link to."""
    todo = [(0, points)]
    while todo:
        at, some = todo.pop()
        if not len(some):
            continue
        if len(nodes[at]) == 1:
            yield nodes[at][0], some
            continue
        vantage, most, inner, outer = nodes[at]
        distance = np.bitwise_count(some ^ vantage)
        todo += [(inner, some[distance <= most + radius]), (outer, some[distance > most])]


class Forest:
    """Components of the links met so far, as the smallest index in each."""

    def __init__(self, size: int):
        self.labels = np.arange(size)
        self.pending: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def link(self, left: np.ndarray, right: np.ndarray) -> None:
        self.pending.append((left, right))
        self.held += len(left)
        if self.held > BUFFER:
            self.fold()

    def fold(self) -> np.ndarray:
        if self.pending:
            left, right = (np.concatenate(side) for side in zip(*self.pending, strict=True))
            self.pending, self.held = [], 0
            while True:
                a, b = self.labels[left], self.labels[right]
                apart = a != b
                if not apart.any():
                    break
                a, b = a[apart], b[apart]
                np.minimum.at(self.labels, np.maximum(a, b), np.minimum(a, b))
                while not np.array_equal(jumped := self.labels[self.labels], self.labels):
                    self.labels = jumped
        return self.labels


def components_within(points: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For distinct points, the index of the first point in each one's component."""
    forest = Forest(len(points))
    todo = [np.arange(len(points))]
    while todo:
        at = todo.pop()
        own = points[at]
        chosen = _cut(own, radius) if len(at) > BLOCK else None
        if chosen is not None:
            distance = np.bitwise_count(own ^ chosen[0])
            todo += [at[distance <= chosen[1] + radius], at[distance > chosen[1]]]
            continue
        for start in range(0, len(at), BLOCK):
            near = np.bitwise_count(own[start : start + BLOCK, None] ^ own[None, start:]) <= radius
            left, right = np.nonzero(np.triu(near, 1))
            forest.link(at[start + left], at[start + right])
    return forest.fold()


# Links and components


def shard_links(distinct: DataFrame, radius: int = RADIUS, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """(fp, other): links of each shard's forest over the distinct fingerprints in ``fp``."""
    total = distinct.count()
    thin = -(-total // sample) or 1
    chosen = distinct.filter(F.pmod(F.xxhash64("fp"), F.lit(thin)) == 0).select("fp").toArrow()
    points = np.sort(chosen.column("fp").to_numpy().view(np.uint64))
    nodes = fit_tree(points, max(8, shard // thin), radius)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _gathered(batches):
            for number, some in route(nodes, group, radius):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), number, np.int64)), pa.array(some.view(np.int64))], names=["shard", "fp"])

    def forest(rows: pd.DataFrame) -> pd.DataFrame:
        own = np.sort(rows["fp"].to_numpy().view(np.uint64))
        first = components_within(own, radius)
        linked = first != np.arange(len(own))
        return pd.DataFrame({"fp": own[linked].view(np.int64), "other": own[first[linked]].view(np.int64)})

    return distinct.select("fp").mapInArrow(routed, "shard bigint, fp bigint").groupBy("shard").applyInPandas(forest, "fp bigint, other bigint")


def _gathered(batches: Iterator[pa.RecordBatch], most: int = SAMPLE) -> Iterator[np.ndarray]:
    """The fingerprints of several batches at a time, so that large trees are walked seldom."""
    held: list[np.ndarray] = []
    for batch in batches:
        held.append(batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
        if sum(map(len, held)) >= most:
            yield np.concatenate(held)
            held = []
    if held:
        yield np.concatenate(held)


def components(links: DataFrame) -> DataFrame:
    """(fp, root) for every fingerprint that has a link; equal roots mean one component.

    Each round every vertex joins its neighbour of least priority, priorities being hashed anew per round, and the
    links between the joined vertices go on. The vertices shrink by a fixed share per round, so rounds are logarithmic.
    """
    left = written(links.select(F.col("fp").alias("a"), F.col("other").alias("b")))
    steps: list[DataFrame] = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = F.struct(F.xxhash64("b", F.lit(len(steps))).alias("p"), F.col("b").alias("v"))
        own = F.struct(F.xxhash64("a", F.lit(len(steps))).alias("p"), F.col("a").alias("v"))
        nearest = both.select("a", F.least(order, own).alias("best")).groupBy("a").agg(F.min("best").alias("best"))
        step = written(nearest.select("a", F.col("best.v").alias("root")))
        steps.append(step)
        moved = left.join(step, "a").select("b", F.col("root").alias("x")).join(step.withColumnRenamed("a", "b"), "b").filter("x <> root")
        left = written(moved.select(F.least("x", "root").alias("a"), F.greatest("x", "root").alias("b")).distinct())
    if not steps:
        return left.select(F.col("a").alias("fp"), F.col("b").alias("root"))
    found = steps[0].select(F.col("a").alias("fp"), "root")
    for step in steps[1:]:
        onward = step.select(F.col("a").alias("root"), F.col("root").alias("next"))
        found = found.join(onward, "root", "left").select("fp", F.coalesce("next", "root").alias("root"))
    return found


def near_duplicates(docs: DataFrame, radius: int = RADIUS, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (its smallest doc_id)."""
    narrow = written(fingerprints(docs))
    rooted = _rooted(narrow, radius, sample, shard)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labelled = written(rooted.select("fp", "root").join(least, "root").select("fp", "component_id"))
    return narrow.join(labelled, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _rooted(narrow: DataFrame, radius: int = RADIUS, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """(fp, least, root): each distinct fingerprint with its smallest doc_id and its component."""
    distinct = written(narrow.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(shard_links(distinct, radius, sample, shard))
    return distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def thinned(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of ``docs`` for each component, with all its columns; see ``one_of_each``."""
    narrow = written(fingerprints(docs, key=text_key(docs["text"])))
    return one_of_each(docs, narrow.join(_rooted(narrow, radius).select("fp", "root"), "fp").select("doc_id", "key", "root"))


def one_of_each(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """The first row of each group; ``grouped`` has doc_id, ``key`` (the text's) and ``root`` (the group) per row of ``docs``.

    First is the smallest id, rows without an id last, then the smallest hash of the text, so each row is judged by its
    own id and text. Where that row is given several times and differs in other columns, the first by its JSON form stays.
    """
    names = ["doc_id", "key", "root"]
    pairs = grouped.groupBy(names).agg(F.count(F.lit(1)).alias("copies"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "key"))
    judged = pairs.join(grouped.groupBy("root").agg(first.alias("first")), "root")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    settled = written(judged.select("doc_id", "key", stays.alias("stays"), "copies").filter("NOT stays OR copies > 1")).hint("shuffle_hash")
    rows = whole_rows(docs, doc_id=docs["doc_id"], key=text_key(docs["text"]))

    def same(left: DataFrame, right: DataFrame) -> Column:
        return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["key"] == right["key"])

    plain = rows.join(settled, same(rows, settled), "left_anti").select("row.*")
    twice = settled.filter("stays")
    if twice.isEmpty():
        return plain
    repeated = rows.join(twice, same(rows, twice), "left_semi").groupBy("doc_id", "key")
    return plain.union(repeated.agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*"))
