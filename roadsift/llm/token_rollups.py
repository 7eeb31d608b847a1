"""Delta-maintained token counts by source, language and tokenizer version.

Changes come in batches of inserts, deletes and revised counts per (doc_id, entry, tokenizer); ``entry`` tells documents with the
same id, or without one, apart. A ledger of signed rows holds what counts: an insert or revision that differs from the
ledger adds -1 times the old row and +1 times the new one, a delete -1 times the old row. A row that stands for several
equal documents has their number, its ``copies``, in place of 1. A batch's signed rows, summed by source, language and tokenizer, are its delta;
totals are the sums of the deltas. A batch is committed by a small file with its name that appears by a rename and names the
folder of its rows, so a batch that breaks off leaves nothing that is read, and one that comes again changes nothing.
One writer at a time is assumed.

An insert of a document that is there replaces it; a delete or revision of one that is not there does nothing. Of several
changes of a document in a batch the last by ``change_no`` counts, then by operation and count. Changes that differ
only in being repeated count once. Null ids and entries are like any other, as are null sources and languages; null counts
are 0. Tables of documents (``counted``) may repeat ids and rows and have null ids: every row counts. An empty batch is
committed like any other and changes nothing; before the first batch there are no totals.

Scale: the ledger is narrow, and a batch meets it in one aggregate by key; deltas have a row per group and batch, and are
combined within tasks, so a source with a third of all rows sends one row per task. ``compact`` folds the
committed batches into one.
"""

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadsift.llm.files import moved, opened
from roadsift.llm.texts import utf8
from roadsift.session import shared_folder

KEYS = ["doc_id", "entry", "tokenizer"]
GROUPS = ["source", "lang", "tokenizer"]
LEDGER = "doc_id bigint, entry string, source string, lang string, tokenizer string, tokens bigint, sign bigint"
DELTAS = "source string, lang string, tokenizer string, documents bigint, tokens bigint"
CHANGE = "change_no: bigint, operation: string, tokens: bigint, source: string, lang: string, copies: bigint"
KEPT = "tokens: bigint, source: string, lang: string, copies: bigint"
OPERATIONS = ("insert", "revise", "delete")

#: Tokenizer versions: what is counted as a token.
VERSIONS = {"words-1": r"[^\x20\x09-\x0D]+", "pieces-1": r"\p{L}+|\p{N}+|[^\p{L}\p{N}\x20\x09-\x0D]+"}


def counted(docs: DataFrame, versions: dict[str, str] = VERSIONS, text: Column | None = None) -> DataFrame:
    """doc_id, entry (a hash of the row's source, language and text), copies (equal rows), source, lang, tokenizer and tokens:
    a row per different row of ``docs`` and tokenizer version.

    The tokens are those of ``text``, a column of ``docs`` or made from them, if it is given.
    """
    counted_text = F.coalesce(docs["text"] if text is None else text, F.lit(""))
    counts = [F.struct(F.lit(name).alias("tokenizer"), F.regexp_count(counted_text, F.lit(pattern)).cast("long").alias("tokens")) for name, pattern in versions.items()]
    origin = F.struct(docs["source"].alias("source"), docs["lang"].alias("lang"))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.md5(F.concat(utf8(F.to_json(origin)), utf8(docs["text"]))).alias("entry"), origin.alias("origin"), F.array(*counts).alias("counts"))
    different = rows.groupBy("doc_id", "entry").agg(F.count(F.lit(1)).alias("copies"), F.max(F.struct("origin", "counts")).alias("row"))
    return different.select("doc_id", "entry", "copies", "row.origin.source", "row.origin.lang", F.inline("row.counts"))


def committed(spark: SparkSession, folder: str) -> dict[str, str]:
    """The folder of each committed batch, by name."""
    store, base = opened(folder)
    found = {}
    for path in store.children(f"{base}/commits"):
        with store.reader(path) as source:
            entry = json.loads(source.read())
        found[entry["batch"]] = entry["rows"]
    return found


def _read(spark: SparkSession, folder: str, kind: str, schema: str) -> DataFrame:
    batches = committed(spark, folder).values()
    paths = [f"{folder}/{kind}/{rows}" for rows in sorted(set(batches))]  # compacted batches share one
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _current(ledger: DataFrame) -> DataFrame:
    """The ledger's rows that count, with the number of their copies as ``sign``."""
    return ledger.groupBy(*KEYS, "source", "lang", "tokens").agg(F.sum("sign").alias("sign")).filter("sign > 0")


def apply_batch(spark: SparkSession, folder: str, batch: str, changes: DataFrame) -> bool:
    """Commits the changes (doc_id, source, lang, tokenizer, tokens, operation; and, where given, entry, copies and a
    change_no for their order); False if the batch was committed before."""
    if batch in committed(spark, folder):
        return False

    def given_or(name: str, kind: str, value: object) -> Column:
        return (changes[name] if name in changes.columns else F.lit(value)).cast(kind).alias(name)

    given = changes.select(
        changes["doc_id"].cast("long").alias("doc_id"), given_or("entry", "string", None), *(changes[name].alias(name) for name in GROUPS),
        F.coalesce(changes["tokens"].cast("long"), F.lit(0)).alias("tokens"), given_or("copies", "long", 1), changes["operation"].alias("operation"), given_or("change_no", "long", 0),
    )
    change = F.struct("change_no", "operation", "tokens", "source", "lang", "copies")
    kept = F.struct("tokens", "source", "lang", F.col("sign").alias("copies"))
    # Changes and ledger meet in one aggregate, so the counts behind the changes are worked out once.
    none = [F.lit(None).cast(f"struct<{fields}>") for fields in (CHANGE, KEPT)]
    sides = given.select(*KEYS, change.alias("new"), none[1].alias("old")).unionByName(_current(_read(spark, folder, "ledger", LEDGER)).select(*KEYS, none[0].alias("new"), kept.alias("old")))
    both = sides.groupBy(*KEYS).agg(F.max("new").alias("new"), F.max("old").alias("old")).filter("new IS NOT NULL")
    there = F.col("old").isNotNull()
    differs = ~F.struct("new.tokens", "new.source", "new.lang", "new.copies").eqNullSafe(F.col("old"))
    operation = F.col("new.operation")
    leaves = there & ((operation == "delete") | differs)
    enters = (operation == "insert") & (~there | differs) | (operation == "revise") & there & differs
    minus = F.struct("doc_id", "entry", "old.source", "old.lang", "tokenizer", "old.tokens", (-F.col("old.copies")).alias("sign"))
    plus = F.struct("doc_id", "entry", "new.source", "new.lang", "tokenizer", "new.tokens", F.col("new.copies").alias("sign"))
    signed = both.select(F.explode(F.array_compact(F.array(F.when(leaves, minus), F.when(enters, plus)))).alias("r")).select("r.*")
    rows = uuid.uuid4().hex
    signed.write.parquet(f"{folder}/ledger/{rows}")
    stored = spark.read.schema(LEDGER).parquet(f"{folder}/ledger/{rows}")
    _summed(stored).write.parquet(f"{folder}/deltas/{rows}")
    _commit(folder, batch, rows)
    return True


def _summed(signed: DataFrame) -> DataFrame:
    return signed.groupBy(*GROUPS).agg(F.sum("sign").alias("documents"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"))


def _commit(folder: str, batch: str, rows: str) -> None:
    store, base = opened(folder)
    store.create_dir(f"{base}/commits")
    name = uuid.uuid5(uuid.NAMESPACE_URL, batch).hex
    with store.writer(f"{base}/.{rows}") as out:
        out.write(json.dumps({"batch": batch, "rows": rows}).encode())
    moved(store, f"{base}/.{rows}", f"{base}/commits/{name}")


def totals(spark: SparkSession, folder: str) -> DataFrame:
    """source, lang, tokenizer, documents and tokens over the committed batches; groups that are empty again are left out."""
    deltas = _read(spark, folder, "deltas", DELTAS)
    return deltas.groupBy(*GROUPS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).filter("documents <> 0 OR tokens <> 0")


def compact(spark: SparkSession, folder: str, into: str) -> str:
    """Folds all committed batches into one, in the new folder ``into``; they stay known there as committed."""
    rows = uuid.uuid4().hex
    net = _read(spark, folder, "ledger", LEDGER).groupBy(*KEYS, "source", "lang", "tokens").agg(F.sum("sign").alias("sign")).filter("sign <> 0")
    net.write.parquet(f"{into}/ledger/{rows}")
    stored = spark.read.schema(LEDGER).parquet(f"{into}/ledger/{rows}")
    _summed(stored).write.parquet(f"{into}/deltas/{rows}")
    for batch in committed(spark, folder):
        _commit(into, batch, rows)
    return into


def maintained(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Totals after four batches: all documents come in, those labelled toxic go, those of low quality are counted anew
    without punctuation, and the second batch comes again by mistake. A label holds for all rows of its id."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    marks = labels.groupBy(labels["doc_id"].alias("doc_id")).agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    apply_batch(spark, folder, "documents", counted(docs).withColumn("operation", F.lit("insert")))
    toxic = marks.filter("toxic = 1").select("doc_id")
    gone = _current(_read(spark, folder, "ledger", LEDGER)).join(toxic, "doc_id", "left_semi").withColumn("operation", F.lit("delete"))
    apply_batch(spark, folder, "toxic", gone)
    # Counted before they are picked: the counts are shuffled, not the texts.
    cleaned = counted(docs, text=F.regexp_replace(docs["text"], r"[^\p{L}\p{N}\x20\x09-\x0D]+", " "))
    low = marks.filter("quality = 0").select("doc_id")
    apply_batch(spark, folder, "cleaned", cleaned.join(low, "doc_id", "left_semi").withColumn("operation", F.lit("revise")))
    apply_batch(spark, folder, "toxic", gone)
    return totals(spark, folder)
