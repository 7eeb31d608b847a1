"""Language of documents by a linear-chain conditional random field over their words.

The model (``crf``) learns from a bounded sample of labelled documents and labels every word of every whole text; a
document's language is the one with the largest sum of word probabilities, its score their mean. Documents whose
crc32(doc_id as text) leaves 2 when divided by 4 are held out of learning. Only the text is an input of a prediction.

Sample: up to ``PER_LANGUAGE`` documents of each language value, those of smallest hashed id, and from each a window of up to
``WINDOW`` characters at a hashed place. Every value is learned; of more than 15 the documents, and then the windows, are fewer,
so that characters x languages stay within ``SAMPLE_CELLS`` as long as each has one window of ``LEAST_WINDOW``. A model of
``FEATURES`` x labels weights goes to the executors; nothing is shuffled to predict.

Defined results: ``und`` with score 0 for a null text, one without a letter, or where nothing was learned; rows without an id are
predicted, never learned from, and not held out; ties go to the first language in order; repeated rows are alike; an empty
table gives an empty result; other columns are left alone.
"""

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadsift.llm import crf
from roadsift.llm.batches import bounded
from roadsift.llm.texts import whole_rows
from roadsift.session import written

PER_LANGUAGE = 200
WINDOW = 2_000
#: Bound on the sample's characters times its languages, and the shortest window.
SAMPLE_CELLS = 100_000_000
LEAST_WINDOW = 200
UNKNOWN = "und"
#: A document whose best language has a smaller share of its words is rejected by ``recognised``.
LEAST_SCORE = 0.3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample_size(languages: int, per_language: int = PER_LANGUAGE, window: int = WINDOW) -> tuple[int, int]:
    """How many documents of each language are learned from, and the characters of each."""
    characters = SAMPLE_CELLS // max(1, languages) ** 2
    window = min(window, max(LEAST_WINDOW, characters // 5))
    return min(per_language, max(1, characters // window)), window


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, window: int = WINDOW) -> list[tuple[str, str]]:
    """(text, language) of the bounded sample to learn from."""
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["lang"].alias("lang"), docs["text"].alias("text"))
    rows = rows.filter("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").filter(~held_out(F.col("doc_id")))
    rows = rows.withColumn("drawn", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30))
    # Rows beyond a generous threshold are dropped before ranking, so that no task ranks a whole language.
    counts = written(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")))
    per_language, window = sample_size(counts.count(), per_language, window)
    likely = rows.join(counts, "lang").filter(F.col("drawn") < F.lit(3.0 * per_language) / F.col("rows"))
    place = 1 + F.floor(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) / float(1 << 30) * F.greatest(F.lit(1), F.length("text") - window + 1)).cast("int")
    cut = likely.select("lang", "drawn", "doc_id", F.substring(F.col("text"), place, F.lit(window)).alias("text"))
    ranked = cut.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("drawn", "doc_id", "text")))
    return [(row["text"], row["lang"]) for row in ranked.filter(F.col("n") <= per_language).select("text", "lang").collect()]


_LABELERS: dict[str, crf.Labeler] = {}


def predictions(docs: DataFrame, model: crf.Model) -> DataFrame:
    """``row`` (all columns of ``docs``), lang_pred and score per row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = whole_rows(docs, text=docs["text"])
    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    name = uuid.uuid4().hex  # a worker serves several models

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _LABELERS:
            _LABELERS.clear()
            _LABELERS[name] = crf.Labeler(shared.value)
        labeler = _LABELERS[name]
        for batch in bounded(batches, "text", 4 << 20):
            sums, numbers = labeler.sums([text or "" for text in batch.column("text").to_pylist()])
            known = (numbers > 0) & (sums.shape[1] > 0)
            best = sums.argmax(axis=1) if sums.shape[1] else np.zeros(len(sums), int)
            languages = [labeler.model.labels[b] if k else UNKNOWN for b, k in zip(best, known)]
            scores = [min(1.0, sums[at, b] / numbers[at]) if k else 0.0 for at, (b, k) in enumerate(zip(best, known))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(languages, pa.string()), pa.array(scores, pa.float64())], names=["row", "lang_pred", "score"])

    return rows.mapInArrow(predict, schema)


def word_spans(docs: DataFrame, model: crf.Model) -> DataFrame:
    """``row`` (all columns of ``docs``) and ``spans``: start, end (in code points) and lang of each run of words of one
    language, in order. A text without letters, or a null one, has none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = whole_rows(docs, text=docs["text"])
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())])
    schema = T.StructType([rows.schema["row"], T.StructField("spans", T.ArrayType(span))])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
    name = uuid.uuid4().hex

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _LABELERS:
            _LABELERS.clear()
            _LABELERS[name] = crf.Labeler(shared.value)
        for batch in bounded(batches, "text"):
            spans = [[dict(zip(("start", "end", "lang"), found)) for found in _LABELERS[name].spans(text or "")] for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(spans, kind)], names=["row", "spans"])

    return rows.mapInArrow(label, schema)


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score per row of ``docs``, by a model learned from its own labelled rows."""
    model = crf.fit(sample(docs))
    own = docs.select("doc_id", "text")
    found = predictions(own, model).select(F.col("row.doc_id").alias("doc_id"), "lang_pred", "score")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def recognised(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language is recognised, with all their columns."""
    found = predictions(docs, crf.fit(sample(docs)))
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)).select("row.*")
