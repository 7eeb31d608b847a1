"""How the sources of a language diverge in the terms they use, by three-dimensional cube partitioning.

A term is a run of letters A to Z (in lower case) and characters beyond ASCII. Each language keeps the terms that enough of its
documents hold; every occurring (language, source) group, and the language as a whole, gives each kept term a smoothed share
p = 1 + floor(10^9 (count + 5) / (N + 5 V)), V being the kept terms of the language and N the group's occurrences of them.
Two sources diverge by the sum of |p - q| over all kept terms. A group's own terms are those with p above the language's.

Cube: the groups of a language are dealt into blocks, and so are its terms. A cell (group block, group block, term block) is
a task of its own; it gets the two slices of shares that it needs, so a slice is sent to as many cells as there are group
blocks, and works out the divergences of its pairs over its terms. The partial sums are added along the term axis.
Terms that a cell's slices do not hold are not sent: for them both shares are the groups' shares of count 0, so they are
added by number at the end. All shares and sums are whole numbers, and the order of additions does not matter.

Scale: texts do not travel; each task counts its terms first and sends a row per (language, source, term), so neither a hot
source nor a frequent term fills a task. Cells are bounded by their blocks, whatever the number of terms or groups. What
comes out is, as asked for, a row for each two sources of a language.

Defined results: null text, language and source count as empty ones; repeated rows are documents of their own; groups
without kept terms have shares all the same; ids do not matter; an empty table gives an empty result; other columns,
whatever their names, are left alone.
"""

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadsift.llm.batches import bounded
from roadsift.llm.texts import utf8
from roadsift.session import written

# Documents a kept term is in, what is added to each count, the scale of shares, and the ranks of own terms.
LEAST_DOCUMENTS = 30
ADDED = 5
SCALE = 1_000_000_000
OWN_TERMS = 50

#: Groups and terms that a block should hold: a cell works on a matrix of at most some 2 x 64 x 2048 shares.
GROUPS_A_BLOCK = 64
TERMS_A_BLOCK = 2048
#: Counts gathered within a task before they are sent on, and bytes of text that are split at a time.
HELD = 200_000
PIECE = 1 << 20

_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
_BREAK = re.compile(rb"[^A-Za-z\x80-\xff]")


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in their order; a long text is split in pieces that end between terms."""
    start = 0
    while start < len(text):
        gap = _BREAK.search(text, start + PIECE)
        end = gap.start() if gap else len(text)
        yield _TERM.findall(text[start:end].lower())  # for bytes lower() knows A-Z only
        start = end


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and documents that hold it."""
    none = F.lit("")
    narrow = docs.select(F.coalesce(docs["lang"], none).alias("lang"), F.coalesce(docs["source"], none).alias("source"), utf8(docs["text"]).alias("text"))
    names = ["lang", "source", "term", "n", "documents"]

    def sent(occurrences: dict[tuple, Counter], holding: dict[tuple, Counter]) -> Iterator[pa.RecordBatch]:
        for (lang, source), found in occurrences.items():
            terms = pa.array(list(found), pa.binary()).cast(pa.string())
            numbers = [pa.array(list(found.values()), pa.int64()), pa.array(map(holding[lang, source].__getitem__, found), pa.int64(), size=len(found))]
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(found)), pa.repeat(pa.scalar(source), len(found)), terms, *numbers], names=names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occurrences: defaultdict[tuple, Counter] = defaultdict(Counter)
        holding: defaultdict[tuple, Counter] = defaultdict(Counter)
        entries = 0
        for batch in bounded(batches, "text"):
            for lang, source, text in zip(*(batch.column(name).to_pylist() for name in ("lang", "source", "text"))):
                of_group, own = occurrences[lang, source], set()
                before = len(of_group)
                for terms in _pieces(text):
                    of_group.update(terms)
                    own.update(terms)
                holding[lang, source].update(own)
                entries += len(of_group) - before
                if entries >= HELD:
                    yield from sent(occurrences, holding)
                    occurrences.clear()
                    holding.clear()
                    entries = 0
        yield from sent(occurrences, holding)

    partial = narrow.mapInArrow(count, "lang string, source string, term string, n bigint, documents bigint")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE (count + ADDED) / (total + ADDED kept)); whole numbers throughout, beyond 64 bits too."""
    above = (count + ADDED).cast("decimal(38,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", above.cast("decimal(38,0)"), (total + ADDED * kept).cast("decimal(38,0)")) + 1


class Shares:
    """The kept terms, groups and shares of a corpus, each written once.

    ``groups``: lang, source, total (N), kept (V), none (the share of count 0). ``languages``: lang, kept, total, sources.
    ``shares``: lang, source, term, share for each kept term that the group holds. ``overall``: lang, term, share.
    """

    def __init__(self, docs: DataFrame, least_documents: int = LEAST_DOCUMENTS):
        none = F.lit("")
        occurring = docs.select(F.coalesce(docs["lang"], none).alias("lang"), F.coalesce(docs["source"], none).alias("source")).distinct()
        counts = written(term_counts(docs))
        per_language = counts.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("documents").alias("documents"))
        vocabulary = written(per_language.filter(F.col("documents") >= least_documents).select("lang", "term", "all"))
        held = written(counts.join(vocabulary.select("lang", "term"), ["lang", "term"]).select("lang", "source", "term", "n"))
        kept = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("all").alias("total"))
        groups = written(occurring.join(held.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left"))
        sources = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
        zero = F.lit(0).cast("long")
        self.languages = written(sources.join(kept, "lang", "left").select("lang", "sources", F.coalesce("kept", zero).alias("kept"), F.coalesce("total", zero).alias("total")))
        sized = groups.select("lang", "source", F.coalesce("total", zero).alias("total")).join(self.languages.select("lang", "kept"), "lang")
        share_of_none = F.when(F.col("kept") > 0, _share(zero, F.col("total"), F.col("kept"))).otherwise(zero)
        self.groups = written(sized.withColumn("none", share_of_none))
        self.shares = written(held.join(self.groups, ["lang", "source"]).select("lang", "source", "term", _share(F.col("n"), F.col("total"), F.col("kept")).alias("share")))
        self.overall = vocabulary.join(self.languages, "lang").select("lang", "term", _share(F.col("all"), F.col("total"), F.col("kept")).alias("share"))


def _cell(rows: pa.Table) -> pa.Table:
    """One cell: |p - q| summed over its terms for each pair of its two group blocks, and the number of its terms.

    A row without a term introduces a group with its share of count 0; the others are the slices. Of a pair of groups
    within one block the one that comes first by name is first.
    """
    lang, first, second = (rows.column(name)[0].as_py() for name in ("lang", "first", "second"))
    told = pc.is_null(rows.column("term"))
    groups = rows.filter(told).sort_by([("block", "ascending"), ("source", "ascending")])
    names = groups.column("source").combine_chunks()
    slices = rows.filter(pc.invert(told))
    terms = slices.column("term").combine_chunks().dictionary_encode()
    width = len(terms.dictionary)
    matrix = np.repeat(groups.column("share").to_numpy().astype(np.int32)[:, None], width, axis=1)
    matrix[pc.index_in(slices.column("source"), names).to_numpy(), terms.indices.to_numpy()] = slices.column("share").to_numpy()
    of_first = int((groups.column("block").to_numpy() == first).sum())
    pairs, sums = [], []
    for at in range(of_first):
        start = at + 1 if first == second else of_first
        pairs.append(np.stack([np.full(len(names) - start, at), np.arange(start, len(names))]))
        sums.append(np.abs(matrix[start:] - matrix[at]).sum(axis=1, dtype=np.int64))
    a, b = np.concatenate([*pairs, np.zeros((2, 0), np.int64)], axis=1)
    apart = np.concatenate([*sums, np.zeros(0, np.int64)])
    columns = [pa.repeat(pa.scalar(lang, pa.string()), len(a)), names.take(pa.array(a)), names.take(pa.array(b)), pa.array(apart), pa.array(np.full(len(a), width, np.int64))]
    return pa.Table.from_arrays(columns, names=["lang", "a", "b", "apart", "terms"])


def pair_divergences(shares: Shares, groups_a_block: int = GROUPS_A_BLOCK, terms_a_block: int = TERMS_A_BLOCK) -> DataFrame:
    """lang, source, item (another source of the language) and value: both rows of each pair."""
    blocks = shares.languages.select(
        "lang",
        F.ceil(F.col("sources") / groups_a_block).cast("int").alias("group_blocks"),
        F.greatest(F.lit(1), F.ceil(F.col("kept") / terms_a_block)).cast("int").alias("term_blocks"),
    )
    block = F.pmod(F.xxhash64("source"), F.col("group_blocks")).cast("int").alias("block")
    other = F.explode(F.sequence(F.lit(0), F.col("group_blocks") - 1)).alias("other")
    slices = shares.shares.join(blocks, "lang").select("lang", "source", "term", "share", block, F.pmod(F.xxhash64("term"), F.col("term_blocks")).cast("int").alias("depth"), other)
    # Every cell is told of all its groups, so a group without terms there has its share of count 0.
    depth = F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1)).alias("depth")
    told = shares.groups.join(blocks, "lang").select("lang", "source", F.lit(None).cast("string").alias("term"), F.col("none").alias("share"), block, "group_blocks", depth)
    told = told.select("lang", "source", "term", "share", "block", "depth", other)
    placed = slices.unionByName(told).select("*", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second")).drop("other")
    cells = placed.groupBy("lang", "first", "second", "depth").applyInArrow(_cell, "lang string, a string, b string, apart bigint, terms bigint")
    summed = cells.groupBy("lang", "a", "b").agg(F.sum("apart").alias("apart"), F.sum("terms").alias("terms"))
    by_name = shares.groups.select("lang", "source", "none")
    first = by_name.select("lang", F.col("source").alias("a"), F.col("none").alias("none_a"), F.lit(0).alias("_"))
    second = shares.groups.select("lang", F.col("source").alias("b"), F.col("none").alias("none_b"), "kept")
    whole = summed.join(first.drop("_"), ["lang", "a"]).join(second, ["lang", "b"])
    value = F.col("apart") + (F.col("kept") - F.col("terms")) * F.abs(F.col("none_a") - F.col("none_b"))
    both = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    return whole.select("lang", F.explode(both).alias("pair"), value.alias("value")).select("lang", "pair.source", "pair.item", "value")


def own_terms(shares: Shares, ranks: int = OWN_TERMS) -> DataFrame:
    """lang, source, item (a term), value (its share beyond the language's) and rank, the first ranks of each group."""
    overall = shares.overall.withColumnRenamed("share", "usual")
    above = shares.shares.join(overall, ["lang", "term"]).filter(F.col("share") > F.col("usual"))
    return _ranked(above.select("lang", "source", F.col("term").alias("item"), (F.col("share") - F.col("usual")).alias("value"))).filter(F.col("rank") <= ranks)


def _ranked(rows: DataFrame) -> DataFrame:
    in_group = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(in_group))


def audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, ranks: int = OWN_TERMS) -> DataFrame:
    """lang, source, part, item, value and rank: per group its divergence from every other source of its language
    (part ``pair``), and the terms by which it stands out from the language (part ``term``)."""
    shares = Shares(docs, least_documents)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = _ranked(pair_divergences(shares)).withColumn("part", F.lit("pair"))
    return pairs.select(columns).unionByName(own_terms(shares, ranks).withColumn("part", F.lit("term")).select(columns))
