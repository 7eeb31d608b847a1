"""Feature vectors, clustering into themes, and theme names."""

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadsift.functions.keys import body_hash
from roadsift.functions.numbers import theme_count
from roadsift.functions.replies import with_record
from roadsift.functions.text import cut, or_default, ordered_lines, title_words
from roadsift.operators import kmeans
from roadsift.operators.models import one_of_each_text
from roadsift.operators.ranking import attach, top_per_group
from roadsift.schemas import NAMING_SAMPLE_CHARS, NAMING_SAMPLE_SIZE
from roadsift.session import written

# Starts of the clustering, name lengths and the fallback texts.
SEEDS = range(42, 52)
NAME_CHARS, SUMMARY_CHARS = 60, 200
UNNAMED = "Unnamed"
DEFAULT_GROUP_AREA = "general"
NAME_SUFFIX = " issues"
FALLBACK_SUMMARY = "(auto-named by product area — LLM naming unavailable)"

FEW_CLUSTERS = 10_000  # rows that may be sent to every task
BLOCK_BYTES = 32 << 20  # of centroids sent to every task at a time

WORD_BREAK = r"[^\p{L}\p{N}]+"

NAMING_HEAD = "What do these items of one cluster have in common? Say it in a name of few words and in one sentence.\n\nItems:\n"
NAMING_TAIL = '\n\nAnswer with this JSON and nothing else: {"name": "...", "summary": "..."}'


def actionable(items: DataFrame) -> DataFrame:
    """Classified items other than praise; those without a type are not actionable."""
    return items.filter((F.col("status") == "classified") & (F.col("fb_type") != "praise"))


def cache_misses(items: DataFrame, cache: DataFrame) -> DataFrame:
    """(body_hash, body) of the distinct texts that have no features yet.

    The hashes are compared first, so only the bodies of misses are shuffled.
    """
    hashed = items.select("id", "body", body_hash(F.col("body")).alias("body_hash"))
    missing = hashed.select("id", "body_hash").join(cache.select("body_hash"), "body_hash", "left_anti")
    return one_of_each_text(hashed, missing)


def compute_features(
    misses: DataFrame, embed: Callable[[list[str]], Sequence[Sequence[float]]], partitions: int | None = None
) -> DataFrame:
    """(body_hash, features) rows to append to the cache. ``embed`` gets a batch of texts at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = embed(list(batch["body"]))
            yield pd.DataFrame(
                {"body_hash": batch["body_hash"].to_numpy(), "features": [np.asarray(v, dtype="float32") for v in vectors]}
            )

    spread = misses.repartition(partitions, "body_hash") if partitions else misses
    return spread.mapInPandas(run, "body_hash string, features array<float>")


def unit_vectors(vectors: DataFrame, features: str = "features", p: float = 2.0) -> DataFrame:
    """Scales an array column to unit length, as an ML vector. Zero vectors have no direction and are dropped."""
    as_vector = vectors.withColumn(features, array_to_vector(features))
    scaled = Normalizer(p=p, inputCol=features, outputCol="_unit").transform(as_vector)
    lengths = F.aggregate(vector_to_array("_unit"), F.lit(0.0), lambda total, x: total + F.abs(x))
    return scaled.filter(lengths > 0).drop(features).withColumnRenamed("_unit", features)


def vectorize(items: DataFrame, cache: DataFrame) -> DataFrame:
    """(id, features) unit vectors of items whose text is in the cache. The bodies are hashed, never shuffled."""
    hashed = items.select("id", body_hash(F.col("body")).alias("body_hash"))
    return unit_vectors(hashed.join(cache, "body_hash").select("id", "features"))


def word_vectors(items: DataFrame, size: int = 1024) -> DataFrame:
    """(id, features) unit TF-IDF vectors of the whole texts, for work without an embedding model.

    Words are runs of letters and digits of any script; a text without any is taken by its characters. Only empty
    texts have no vector. The counts are written down, so a text is taken apart once.
    """
    bodies = items.select("id", F.lower(F.coalesce("body", F.lit(""))).alias("_body"))
    split = bodies.select("id", "_body", F.array_remove(F.split("_body", WORD_BREAK), "").alias("_split"))
    characters = F.array_remove(F.split("_body", ""), "")
    words = split.select("id", F.when(F.size("_split") > 0, F.col("_split")).otherwise(characters).alias("_words"))
    counted = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=size).transform(words)
    counts = written(counted.select("id", "_counts", (F.size("_words") > 0).alias("_any")))
    if counts.isEmpty():  # nothing to weigh the words by
        return items.sparkSession.createDataFrame([], T.StructType([items.schema["id"], T.StructField("features", VectorUDT())]))
    weighted = IDF(inputCol="_counts", outputCol="_weighted").fit(counts).transform(counts)
    scaled = Normalizer(inputCol="_weighted", outputCol="features").transform(weighted)
    return scaled.filter("_any").select("id", "features")


def cluster(
    vectors: DataFrame,
    k: int | None = None,
    seeds: Iterable[int] = SEEDS,
    min_size: int = 0,
    max_iter: int = 20,
    features: bool = True,
) -> DataFrame:
    """(id, cluster) and, unless told otherwise, features: the cheapest of one k-means run per seed; equal vectors give equal clusters on any layout.

    Vectors are written down once; all seeds share each pass over them. ``k`` follows the number of vectors unless given,
    and never exceeds it. Clusters below ``min_size`` lose their items.
    """
    kept = ["features"] if features else []
    ids = F.col("id").cast("bigint").alias("id")
    flat = written(vectors.select(ids, vector_to_array("features").alias("features")) if features else kmeans.packed(vectors))
    size, wanted = flat.agg(F.count(F.lit(1)).alias("n")).select("n", theme_count(F.col("n"))).first()
    k = min(k or wanted, size)
    if k < 2:  # none or all in one cluster
        return vectors.select("id", F.lit(0).alias("cluster"), *kept).filter(F.lit(size >= max(1, min_size)))
    clustered = kmeans.assigned(flat, kmeans.fit(flat, k, list(seeds), max_iter))
    clustered = clustered.select("id", "cluster", *(array_to_vector(name).alias(name) for name in kept))
    if min_size > 1:
        kept = clustered.groupBy("cluster").count().filter(F.col("count") >= min_size).select("cluster")
        small = F.broadcast(kept) if k <= FEW_CLUSTERS else kept
        clustered = clustered.join(small, "cluster", "left_semi").select("id", "cluster", *kept)
    return clustered


def assignments(clustered: DataFrame, run_id: int, first_id: int = 1) -> DataFrame:
    """Log rows linking items to the themes of a run; theme ids follow the cluster numbers."""
    return clustered.select(
        F.lit(run_id).cast("bigint").alias("run_id"),
        F.col("id").alias("item_id"),
        (F.col("cluster") + F.lit(first_id)).cast("bigint").alias("theme_id"),
    )


def silhouette(clustered: DataFrame) -> float:
    """Mean cosine silhouette; one pass, no pairs."""
    evaluator = ClusteringEvaluator(featuresCol="features", predictionCol="cluster", distanceMeasure="cosine")
    return evaluator.evaluate(clustered)


def centroids(vectors: DataFrame, group: str = "theme_id", features: str = "features") -> DataFrame:
    """(group, centroid) mean of an array column per group; vector sums are combined within tasks."""
    means = vectors.groupBy(group).agg(Summarizer.mean(array_to_vector(features)).alias("_mean"))
    return means.select(group, vector_to_array("_mean").alias("centroid"))


def _center_blocks(centers: DataFrame, group: str) -> Iterator[list[tuple[int, list[float]]]]:
    """The centroids in blocks of bounded size, in order of their ids."""
    size, width = centers.agg(F.count(F.lit(1)), F.max(F.size("centroid"))).first()
    rows = max(1, BLOCK_BYTES // (8 * max(1, width or 1)))
    last = None
    for _ in range(0, size, rows):
        left = centers if last is None else centers.filter(F.col(group) > last)
        block = [(row[0], row[1]) for row in left.select(group, "centroid").orderBy(group).limit(rows).collect()]
        last = block[-1][0]
        yield block


def nearest_centroid(
    vectors: DataFrame, centers: DataFrame, group: str = "theme_id", digits: int = 6, features: str = "features"
) -> DataFrame:
    """(id, theme_id, distance) of the closest centre by squared distance; the lower theme id wins a tie.

    ``centers`` holds (group, centroid). They go to the tasks in blocks of bounded size, each compared with all vectors;
    of several blocks the best is kept by id. Arrow batches reach numpy as one flat buffer, without a Python object per
    row.
    """
    known = vectors.filter(F.col(features).isNotNull()).select(F.col("id").cast("bigint").alias("id"), features)
    found = [_nearest_of(known, block, digits) for block in _center_blocks(written(centers.select(group, "centroid")), group)]
    if len(found) == 1:
        return found[0]
    if not found:
        return vectors.sparkSession.createDataFrame([], NEAREST)
    every = reduce(DataFrame.unionByName, found)
    best = every.groupBy("id").agg(F.min(F.struct("distance", "theme_id")).alias("best"))
    return best.select("id", "best.theme_id", "best.distance")


NEAREST = "id bigint, theme_id bigint, distance double"


def _nearest_of(known: DataFrame, block: list[tuple[int, list[float]]], digits: int) -> DataFrame:
    theme_ids = np.array([theme for theme, _ in block], dtype="int64")
    matrix = known.sparkSession.sparkContext.broadcast(np.array([center for _, center in block], dtype="float64"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values = batch.column(0), batch.column(1)
            points = values.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(ids), -1)
            distances = np.stack([((points - center) ** 2).sum(axis=1) for center in matrix.value], axis=1).round(digits)
            best = distances.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(theme_ids[best]), pa.array(distances[np.arange(len(ids)), best])],
                names=["id", "theme_id", "distance"],
            )

    return known.mapInArrow(run, NEAREST)


def theme_samples(
    members: DataFrame, themes: DataFrame | None = None, n: int = NAMING_SAMPLE_SIZE, chars: int = NAMING_SAMPLE_CHARS
) -> DataFrame:
    """(theme_id, sample): the first members' opening characters as a list, for naming.

    ``themes``, one row per theme, lets the texts be fetched without a shuffle.
    """
    picked = top_per_group(members.select("id", "theme_id"), "theme_id", [F.col("id")], n)
    lines = attach(picked, members, ["body"], themes, n).withColumn("_line", F.concat(F.lit("- "), cut(F.col("body"), chars)))
    return lines.groupBy("theme_id").agg(ordered_lines("_line", "rank").alias("sample"))


def naming_prompts(members: DataFrame, themes: DataFrame | None = None) -> DataFrame:
    """(theme_id, prompt) for a namer."""
    prompt = F.concat(F.lit(NAMING_HEAD), F.col("sample"), F.lit(NAMING_TAIL))
    return theme_samples(members, themes).select("theme_id", prompt.alias("prompt"))


def top_areas(members: DataFrame) -> DataFrame:
    """(theme_id, area): the most frequent product area; the one seen first wins a tie."""
    area = or_default(F.col("product_area"), DEFAULT_GROUP_AREA).alias("area")
    counts = (
        members.select("theme_id", area, "id")
        .groupBy("theme_id", "area")
        .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    )
    return counts.groupBy("theme_id").agg(F.max_by("area", F.struct("n", -F.col("first_id"))).alias("area"))


def name_themes(members: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """(id, name, summary) per theme: from a namer's reply if it can be read, else from the top area.

    ``members`` are items with their theme; ``replies(theme_id, reply)`` are optional.
    """
    fallback = F.concat(title_words(F.col("area")), F.lit(NAME_SUFFIX))
    areas = top_areas(members)
    if replies is None:
        return areas.select(
            F.col("theme_id").alias("id"), fallback.alias("name"), F.lit(FALLBACK_SUMMARY).alias("summary")
        )
    answers = with_record(replies, "reply", "name", "summary").select("theme_id", "_record")
    record, read = F.col("_record"), F.col("_record").isNotNull()
    return areas.join(answers, "theme_id", "left").select(
        F.col("theme_id").alias("id"),
        F.when(read, cut(F.coalesce(record["name"], F.lit(UNNAMED)), NAME_CHARS)).otherwise(fallback).alias("name"),
        F.when(read, cut(F.coalesce(record["summary"], F.lit("")), SUMMARY_CHARS))
        .otherwise(F.lit(FALLBACK_SUMMARY))
        .alias("summary"),
    )
