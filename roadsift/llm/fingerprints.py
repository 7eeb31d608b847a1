"""MinHash fingerprints of documents, and near-duplicates found by signature bands.

Words are cut at white space and lower-cased; a shingle is five words in a row, or all of a shorter text. Shingles are
hashed to 64 bits, 128 universal hash permutations x -> a x + b (mod 2^64, a odd) are applied in numpy, and the least value
of each, its upper 32 bits, is the signature. The share of equal positions estimates the Jaccard similarity. The
fingerprint is the signature in hex. Null and empty texts have no shingle and share one signature, of all ones; equal
texts have equal fingerprints.

Scale: signatures are made where the texts are, in blocks of bounded memory. The neighbour in id order comes from a range
partition of the rows, walked in order by each task with only the previous row in hand; a range's last row meets the
next range's first, which is sent along. Bands are joined in Spark over distinct texts. A bucket of few texts gives its pairs;
one with very many, such as those that share a passage, gives two pairs for each text, and those of its texts that are not yet
linked go on into smaller buckets until each is linked or told apart.

Defined results: null ids come last in id order and are walked by one task, as are the rows of one id; repeated rows follow each
other, and links are between distinct texts, so copies are not linked one by one; ties in id go by the texts' hashes; a
single row is its own next document; an empty table gives an empty result; other columns, whatever their names, are
left alone.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadsift.llm.batches import bounded
from roadsift.llm.simhash import components, one_of_each
from roadsift.llm.texts import text_key, utf8
from roadsift.session import written

SHINGLE = 5
PERMUTATIONS = 128
SEED = 20240229
#: Bands of the signature; with 4 rows a pair of similarity 0.8 meets in one of 32 with probability 1 - 5e-8.
BANDS = 32
SIMILARITY = 0.8
#: A bucket of at most so many texts is compared pair by pair; a larger one is split by so many further signature rows, in
#: so many ways for each text: a pair of similarity 0.8 meets again in one of the ways with probability 0.985.
WHOLE, FURTHER, WAYS = 32, 4, 8
#: Pairs whose signatures agree in a smaller share are not looked at: 0.2 below the similarity, or 5.6 standard errors.
LIKELY = 0.6
#: Steps of such splitting before what is left is compared pair by pair at any size.
DEPTH = 3
#: Shingles permuted at a time, so that the block stays in the processor's cache.
BLOCK = 1024

_DRAW = np.random.default_rng(SEED)
_A = _DRAW.integers(0, 2**63, PERMUTATIONS, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_B = _DRAW.integers(0, 2**63, PERMUTATIONS, np.uint64)[:, None] * np.uint64(2)
#: Weights that make a shingle's hash depend on the order of its words.
_PLACES = _DRAW.integers(0, 2**63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the distinct shingles, sorted."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    total = len(words) - width + 1
    mixed = np.full(total, width, np.uint64)
    for at in range(width):
        mixed += hashed[at : at + total] * _PLACES[at]
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least upper 32 bits under each permutation."""
    least = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), BLOCK):
        permuted = _A * hashes[start : start + BLOCK]
        permuted += _B
        np.minimum(least, permuted.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def likeness(left: np.ndarray, right: np.ndarray) -> float:
    """The share of equal positions."""
    return float(np.count_nonzero(left == right)) / PERMUTATIONS


def written_out(sign: np.ndarray) -> str:
    return sign.astype(">u4").tobytes().hex()


def edited_text(text: str, following: str) -> str:
    """The text with its last floor(n/2) characters replaced by the first as many, or all, of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


# Fingerprints beside those of the edited and of the next text


#: Id ranges per shuffle partition, so that partitions get about equal numbers of rows.
RANGES = 4


def fingerprints_with_neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next per row of ``docs``.

    The next document is the one of next smaller id; after the last comes the first. Equal ids follow each other in the
    order of their texts' hashes, rows without an id come last. A single document follows itself.
    """
    spark = docs.sparkSession
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), utf8(docs["text"]).alias("text"))
    cuts = own.approxQuantile("doc_id", [at / (RANGES * count) for at in range(1, RANGES * count)], 0.1 / count)
    bounds = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(len(bounds) - np.searchsorted(bounds, ids.to_numpy(), side="left"))

    at = F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(range_of(F.coalesce("doc_id", F.lit(0))))
    keyed = own.select("doc_id", "text", at.alias("at"), F.md5("text").alias("tie"))
    firsts = keyed.groupBy("at").agg(F.max(F.struct("doc_id", "tie")).alias("first")).orderBy("at").collect()  # a row per range
    before = [(row["at"], *row["first"], firsts[number - 1]["at"]) for number, row in enumerate(firsts)]  # the first range's is the last
    ranges = spark.createDataFrame(before, "at int, first_id bigint, first_tie string, before int")
    is_first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("tie") == F.col("first_tie"))
    here = F.struct("at", F.lit(False).alias("guest"))
    there = F.struct(F.col("before").alias("at"), F.lit(True).alias("guest"))
    dealt = keyed.join(F.broadcast(ranges), "at").withColumn("to", F.explode(F.when(is_first, F.array(here, there)).otherwise(F.array(here))))
    walk = dealt.select("doc_id", "text", "tie", "to.at", "to.guest").repartition(count, "at")
    ordered = walk.sortWithinPartitions("at", "guest", F.desc_nulls_last("doc_id"), F.desc("tie")).select("doc_id", "text", "at", "guest")
    return ordered.mapInArrow(_walk, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares each row with the one behind it in its range; the first guest is what follows the range's last row."""
    schema = None
    held = None  # (range, id, text, signature) of the row that waits for the next one
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    for batch in bounded(batches, "text"):
        schema = schema or pa.schema(list(zip(names, [batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()])))
        out: list[tuple] = []
        for doc_id, text, at, guest in zip(*(column.to_pylist() for column in batch.columns)):
            if guest and held is None:
                continue
            text = text.decode()
            sign = signature(shingle_hashes(text))
            if held is not None:
                out.append(_compared(*held[1:], text, sign))
            held = None if guest else (at, doc_id, text, sign)
        yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*out) if out else [[]] * 7, schema)], schema=schema)


def _compared(doc_id, text: str, sign: np.ndarray, following: str, following_sign: np.ndarray) -> tuple:
    edited = edited_text(text, following)
    edited_sign = sign if edited == text else signature(shingle_hashes(edited))
    digest = hashlib.sha256(edited.encode()).hexdigest()
    return doc_id, len(text), digest, written_out(sign), written_out(edited_sign), likeness(sign, edited_sign), likeness(sign, following_sign)


# Near-duplicates


def _signature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches, "text"):
        words, signs = [], []
        for value in batch.column("text"):
            text = value.as_py().decode()
            words.append(hashlib.md5(" ".join(text.lower().split()).encode()).digest())
            signs.append(signature(shingle_hashes(text)).astype(">u4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(words, pa.binary()), pa.array(signs, pa.binary())], names=["key", "words", "sign"])


def signatures(docs: DataFrame) -> DataFrame:
    """``key`` of the text, ``words`` (a hash of its words) and ``sign``, the signature's bytes, per row."""
    return docs.select(text_key(docs["text"]).alias("key"), utf8(docs["text"]).alias("text")).mapInArrow(_signature_batches, "key binary, words binary, sign binary")


def _buckets(level: int, bands: int) -> Column:
    """The buckets a text enters: the bands' at level 0, below that those of further signature rows."""
    if level == 0:
        width = PERMUTATIONS // bands
        rows = [range(at * width, (at + 1) * width) for at in range(bands)]
    else:
        draw = np.random.default_rng((SEED, level))
        rows = [draw.choice(PERMUTATIONS, FURTHER, replace=False) for _ in range(WAYS)]
    values = [[F.substring("sign", 4 * int(at) + 1, 4) for at in some] for some in rows]
    return F.array(*(F.xxhash64("bucket", F.lit(at), *some) for at, some in enumerate(values)))


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = (np.frombuffer(b"".join(batch.column(name).to_pylist()), np.uint32).reshape(-1, PERMUTATIONS) for name in ("sign", "other_sign"))
        yield batch.select(["key", "other"]).filter(pa.array((left == right).sum(axis=1) >= LIKELY * PERMUTATIONS))


def _verified(docs: DataFrame, distinct: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """(key, other, jaccard) of the pairs whose true similarity reaches ``similarity``; texts are read for likely pairs only."""
    signs = distinct.select("key", "sign")
    signed = pairs.join(signs, "key").join(signs.select(F.col("key").alias("other"), F.col("sign").alias("other_sign")), "other")
    pairs = written(signed.select("key", "other", "sign", "other_sign").mapInArrow(_likely, "key binary, other binary"))
    needed = pairs.select("key").union(pairs.select("other")).distinct()
    named = docs.select(text_key(docs["text"]).alias("key"), utf8(docs["text"]).alias("text"))
    texts = written(named.join(needed, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(bounded(batches, "text"), "other_text"):
            scores = [jaccard(a.as_py().decode(), b.as_py().decode()) for a, b in zip(batch.column("text"), batch.column("other_text"))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("other"), pa.array(scores, pa.float64())], names=["key", "other", "jaccard"])

    right = texts.select(F.col("key").alias("other"), F.col("text").alias("other_text"))
    both = pairs.join(texts, "key").join(right, "other").select("key", "other", "text", "other_text")
    return both.mapInArrow(verified, "key binary, other binary, jaccard double").filter(F.col("jaccard") >= similarity)


def links(docs: DataFrame, signed: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS) -> DataFrame:
    """(key, other, jaccard): links between distinct texts, ``signed`` being their written signatures.

    Texts of equal words are linked to the one of least key, which alone goes on. In a bucket of at most ``WHOLE`` texts
    all pairs are verified. In a larger one each text is verified against two representatives, the least and one drawn by
    hash; those linked to one of them leave it, and the others are dealt by further signature rows into smaller
    buckets, ``WAYS`` for each text. What is still too large after ``DEPTH`` such steps is compared pair by pair.
    """
    distinct = written(signed.groupBy("words").agg(F.min("key").alias("key"), F.first("sign").alias("sign")))
    twins = signed.select("words", F.col("key").alias("own")).join(distinct.select("words", F.col("key").alias("other")), "words")
    found = written(twins.filter("own <> other").select(F.col("own").alias("key"), "other", F.lit(1.0).alias("jaccard")).distinct())
    entered = distinct.withColumn("bucket", F.lit(0).cast("long"))
    for level in range(DEPTH + 1):
        members = entered.select("key", F.explode(_buckets(level, bands)).alias("bucket"))
        by_hash = F.struct(F.xxhash64("key", "bucket").alias("hash"), "key")
        sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("key").alias("least"), F.min(by_hash).alias("drawn"))
        shared = written(members.join(sizes.filter("size > 1"), "bucket").select("key", "bucket", "size", "least", F.col("drawn.key").alias("drawn")))
        if shared.isEmpty():
            break
        listed = shared.filter(F.col("size") <= WHOLE).groupBy("bucket").agg(F.array_sort(F.collect_list("key")).alias("keys"))
        placed = listed.select("keys", F.posexplode("keys").alias("at", "other"))
        small = placed.select(F.explode(F.expr("slice(keys, at + 2, size(keys))")).alias("key"), "other")
        large = shared.filter(F.col("size") > WHOLE)
        met = large.select("key", "bucket", F.explode(F.array("least", "drawn")).alias("with")).filter("key <> with")
        met = met.select("key", "bucket", F.greatest("key", "with").alias("a"), F.least("key", "with").alias("b"))
        new = written(_verified(docs, distinct, small.union(met.select("a", "b")).distinct(), similarity))
        found = found.union(new)
        if large.isEmpty():
            break
        settled = met.join(new.select(F.col("key").alias("a"), F.col("other").alias("b")), ["a", "b"]).select("key", "bucket")
        representatives = large.filter("key = least OR key = drawn").select("key", "bucket")
        left = written(large.select("key", "bucket").join(settled.union(representatives).distinct(), ["key", "bucket"], "left_anti"))
        if left.isEmpty():
            break
        if level == DEPTH:
            others = left.select(F.col("key").alias("other"), "bucket")
            found = found.union(written(_verified(docs, distinct, left.join(others, "bucket").filter("other < key").select("key", "other").distinct(), similarity)))
        entered = left.join(distinct.select("key", "sign"), "key")
    return found.distinct()


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS) -> DataFrame:
    """(doc_id, other_id, jaccard): links of documents to smaller ids, verified on their shingles; see ``links``.

    Rows without an id take no part; texts without shingles are alike. Rows of equal texts are linked to the smallest id.
    """
    owned = docs.filter(docs["doc_id"].isNotNull())
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = links(owned, written(signatures(owned).dropDuplicates(["key"])), similarity, bands)
    ids = written(owned.select(text_key(owned["text"]).alias("key"), owned["doc_id"].alias("id")).distinct())
    least = ids.groupBy("key").agg(F.min("id").alias("least"))
    a, b = least.select("key", F.col("least").alias("x")), least.select(F.col("key").alias("other"), F.col("least").alias("y"))
    between = found.join(a, "key").join(b, "other").select(F.greatest("x", "y").alias("doc_id"), F.least("x", "y").alias("other_id"), "jaccard")
    within = ids.join(least, "key").select(F.col("id").alias("doc_id"), F.col("least").alias("other_id"), F.lit(1.0).alias("jaccard"))
    both = between.union(within).filter("other_id < doc_id").groupBy("doc_id", "other_id").agg(F.max("jaccard").alias("jaccard"))
    return both.select(F.col("doc_id").cast(kind).alias("doc_id"), "other_id", "jaccard")


def thinned(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS) -> DataFrame:
    """One row of ``docs`` for each group of linked texts, with all its columns; see ``simhash.one_of_each``."""
    signed = written(signatures(docs).dropDuplicates(["key"]))
    found = links(docs, signed, similarity, bands)
    roots = components(found.select(F.col("key").alias("fp"), "other")).select(F.col("fp").alias("key"), "root")
    grouped = docs.select(docs["doc_id"].alias("doc_id"), text_key(docs["text"]).alias("key")).join(roots, "key", "left")
    return one_of_each(docs, written(grouped.select("doc_id", "key", F.coalesce("root", "key").alias("root"))))


def jaccard(left: str, right: str) -> float:
    """The similarity of two texts' shingle sets; texts without shingles are alike."""
    a, b = shingle_hashes(left), shingle_hashes(right)
    common = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - common
    return common / union if union else 1.0
