"""Documents packed into token sequences of fixed size: best-fit packing by linear grouping.

A document is its token ids and an end token. One that is longer than a sequence is cut into pieces that fill sequences,
but for the first, which takes the rest. Pieces are packed whole, without gaps, into as few sequences as can be found.

Linear grouping: the lengths of the large pieces, in falling order, are cut into groups of equal cardinality, and every
length is rounded up to the largest of its group, which leaves few sizes. Configurations of these sizes are optimised
one after another: of all that hold the largest size left, the fullest, repeated as often as its sizes last. Actual
pieces then take the places of the rounded ones, and the small pieces go by best fit, the longest first, into what is left
in each sequence; only what fits nowhere opens new ones. The border between large and small is the one of a few
that needs the fewest sequences. The result is within 0.1 % of the sum of all tokens on the driver tables.

Scale: only lengths matter for the plan, so it is made from the histogram of lengths (a row per length, as many as a
sequence has tokens) and describes runs of sequences with equal contents; its size does not grow with the corpus. Every
piece gets its rank among those of its length by prefix sums over blocks of the written table, so a length that a third
of all pieces share is spread over many tasks, and the plan turns length and rank into sequence and offset. Texts are read
once and never shuffled.

Defined results: a null or empty text is the end token alone; null and repeated ids are ids like any other, repeated rows
are packed as often as they come; ties in length are in the order of the written table; an empty table gives an
empty result; other columns, whatever their names, are left alone.
"""

import os
import re
import struct
import uuid
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadsift.llm.batches import bounded
from roadsift.session import written

# Tokens in a sequence, and the id that ends a document.
CAPACITY = 1024
END = 2
#: Groups of large lengths, and the borders of "large" that are tried, as parts of a sequence.
GROUPS = 512
BORDERS = (2, 3, 4, 5, 6, 8)
#: Rows of the written table that are ranked together.
BLOCK = 1 << 16
#: Words of a generation whose ids are kept within a task (two generations are), and characters that are looked up at a time.
WORDS = 500_000
PART = 4 << 20

# What byte-level pre-tokenizers take for letters, numbers and white space below U+0250, and their pattern.
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACES = "\\x09-\\x0d\\x20\xa0"
_WORD = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")
_PLAIN = re.compile("[\\x09-\\x0d\\x20-\\x7e\xa0-ɏ]*")
_BETWEEN = re.compile("(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")

# The byte-level alphabet: bytes that print in Latin-1 stand for themselves, the others for the code points from 256 on.
_PRINTING = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_VISIBLE = {byte: 256 + at for at, byte in enumerate(byte for byte in range(256) if byte not in _PRINTING)}


# Token ids


class Encoder:
    """The ids of the ``tokenizers`` library for a byte-level vocabulary, with the words of common scripts remembered.

    The library encodes each pre-token on its own, so a word seen before has the same ids again. That is used for texts
    of characters below U+0250, whose classes all versions of Unicode agree on, without added tokens; all others go to the
    library as they are.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_str(vocabulary)
        self.added = [token.content for token in self.library.get_added_tokens_decoder().values()]
        pre = self.library.pre_tokenizer
        known = type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and pre.use_regex and self.library.normalizer is None
        self.remembers = known and self.library.post_processor is None and type(self.library.model).__name__ == "BPE"
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, without special tokens of the library's own accord."""
        whole: list[list[np.ndarray]] = [[] for _ in texts]
        waiting: list[tuple[int, list[str]]] = []  # words of texts whose turn comes together
        held = 0
        for at, text in enumerate(texts):
            if not self.remembers or not _PLAIN.fullmatch(text) or any(token in text for token in self.added):
                for part in _parts(text) if self.remembers else [text]:
                    whole[at].append(np.array(self.library.encode(part, add_special_tokens=False).ids, "<u4"))
                continue
            for part in _parts(text):
                waiting.append((at, _WORD.findall(part)))
                held += len(part)
                if held >= PART:
                    self._looked_up(waiting, whole)
                    waiting, held = [], 0
        self._looked_up(waiting, whole)
        return [parts[0] if len(parts) == 1 else np.concatenate(parts) for parts in whole]

    def _looked_up(self, waiting: list[tuple[int, list[str]]], whole: list[list[np.ndarray]]) -> None:
        """Words of the generation before are carried over, so that frequent ones last; the others are encoded at once."""
        if len(self.words) > WORDS:
            self.older, self.words = self.words, {}
        known = [list(map(self.words.get, found)) for _, found in waiting]
        gaps = [[place for place, ids in enumerate(own) if ids is None] for own in known]
        new = []
        for word in {found[place] for (_, found), places in zip(waiting, gaps) for place in places}:
            if (before := self.older.get(word)) is None:
                new.append(word)
            else:
                self.words[word] = before
        tokenize = self.library.model.tokenize  # what the library does with a pre-token
        for word in new:
            visible = word.encode().decode("latin-1").translate(_VISIBLE)
            self.words[word] = struct.pack(f"<{len(tokens := tokenize(visible))}I", *[token.id for token in tokens])
        for (at, found), own, places in zip(waiting, known, gaps):
            for place in places:
                own[place] = self.words[found[place]]
            whole[at].append(np.frombuffer(b"".join(own), "<u4"))


def _parts(text: str) -> Iterator[str]:
    """The text in parts, cut where a single space stands between letters or digits, so that no word is cut."""
    start = 0
    while True:
        cut = _BETWEEN.search(text, start + PART)
        yield text[start : cut.start() if cut else len(text)]
        if cut is None:
            return
        start = cut.start()


_ENCODERS: dict[str, Encoder] = {}


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 (and ``ids`` as little-endian numbers) for each piece of each row of ``docs``."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))
    name = uuid.uuid4().hex  # a worker serves several vocabularies
    narrow = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids_column = ", ids binary" if with_ids else ""
    schema = f"doc_id {kind}, piece int, start bigint, length int, ids_crc32 bigint{ids_column}"
    names = ["piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), *([pa.binary()] if with_ids else [])]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[name] = Encoder(vocabulary.value)
        encoder = _ENCODERS[name]
        for batch in bounded(batches, "text"):
            rows, owners = [], []
            for owner, own_ids in enumerate(encoder.ids(batch.column("text").to_pylist())):
                ids = np.append(own_ids, np.array([end], "<u4")).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                for piece, start in enumerate([0, *range(first, len(ids), capacity)]):
                    own = ids[start : first if piece == 0 else start + capacity].tobytes()
                    rows.append((piece, start, len(own) // 4, zlib.crc32(own), own)[: len(names)])
                owners += [owner] * (len(rows) - len(owners))
            taken = batch.column("doc_id").take(pa.array(owners, pa.int64()))
            columns = [pa.array(column, type) for column, type in zip(zip(*rows), types)]
            yield pa.RecordBatch.from_arrays([taken, *columns], names=["doc_id", *names])

    return narrow.mapInArrow(cut, schema)


# The plan: from the histogram of lengths to runs of sequences with equal contents


def _grouped(large: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """(length, number) in falling order, cut into groups of equal cardinality; groups that round up to the same size are one."""
    total = sum(n for _, n in large)
    groups = min(groups, total)
    result: list[list[tuple[int, int]]] = []
    seen = at = 0
    current: list[tuple[int, int]] = []
    for length, n in large:
        while n:
            part = min(n, total * (at + 1) // groups - seen)
            current.append((length, part))
            seen, n = seen + part, n - part
            if seen == total * (at + 1) // groups:
                if result and result[-1][0][0] == current[0][0]:
                    result[-1] += current
                else:
                    result.append(current)
                current, at = [], at + 1
    return result


def _configurations(sizes: list[int], numbers: list[int], capacity: int) -> Iterator[tuple[dict[int, int], int]]:
    """({size's place: how often}, repetitions) until all are used; ``sizes`` fall.

    A set of sums is a whole number with a bit for each, so the sums of the sizes left come by shifts, from the
    smallest on. Walking back from the fullest sum prefers large sizes, which keeps the small ones for later.
    """
    left = list(numbers)
    for top, size in enumerate(sizes):
        while left[top]:
            left[top] -= 1
            room = capacity - size
            within = (1 << (room + 1)) - 1
            usable = [at for at in range(top, len(sizes)) if left[at] and sizes[at] <= room]
            sums = [1]
            for at in reversed(usable):
                reached = moved = sums[-1]
                for _ in range(min(left[at], room // sizes[at])):
                    moved = (moved << sizes[at]) & within
                    reached |= moved
                sums.append(reached)
            sums.reverse()  # sums[i]: what usable[i:] can add up to
            rest = sums[0].bit_length() - 1
            chosen = Counter({top: 1})
            for i, at in enumerate(usable):
                for often in range(min(left[at], rest // sizes[at]), -1, -1):
                    if sums[i + 1] >> (rest - often * sizes[at]) & 1:
                        chosen[at] += often
                        rest -= often * sizes[at]
                        break
            left[top] += 1
            chosen = +chosen
            times = min(left[at] // often for at, often in chosen.items())
            for at, often in chosen.items():
                left[at] -= often * times
            yield dict(chosen), times


Contents = tuple[tuple[int, int], ...]


def _substituted(groups: list[list[tuple[int, int]]], capacity: int) -> Iterator[tuple[int, Contents]]:
    """(number of sequences, contents) with actual lengths in the places of the rounded ones."""
    waiting = [[list(run) for run in reversed(group)] for group in groups]
    sizes = [group[0][0] for group in groups]
    for chosen, times in _configurations(sizes, [sum(n for _, n in group) for group in groups], capacity):
        runs: list[tuple[int, Contents]] = [(times, ())]
        for at, often in chosen.items():
            for _ in range(often):
                filled = []
                for n, contents in runs:
                    while n:
                        run = waiting[at][-1]
                        part = min(n, run[1])
                        filled.append((part, (*contents, (run[0], 1))))
                        n, run[1] = n - part, run[1] - part
                        if not run[1]:
                            waiting[at].pop()
                runs = filled
        yield from runs


def _fitted(open_runs: defaultdict[int, list], small: list[tuple[int, int]], capacity: int) -> None:
    """Best fit, the longest first: each length goes where the least is left; ``open_runs`` has runs of sequences by room."""
    for length, n in small:
        for room in range(length, capacity + 1):
            most = room // length
            while n and open_runs[room]:
                sequences, contents = open_runs[room].pop()
                full = min(sequences, n // most)
                if full:
                    open_runs[room - most * length].append((full, (*contents, (length, most))))
                n -= full * most
                rest = sequences - full
                if rest and 0 < n < most:
                    open_runs[room - n * length].append((1, (*contents, (length, n))))
                    n, rest = 0, rest - 1
                if rest:
                    open_runs[room].append((rest, contents))
        most = capacity // length
        if n // most:
            open_runs[capacity - most * length].append((n // most, ((length, most),)))
        if n % most:
            open_runs[capacity - n % most * length].append((1, ((length, n % most),)))


def runs_of_sequences(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, Contents]]:
    """(number of sequences, contents) that hold all pieces; contents are (length, how often) in their order."""
    lengths = sorted(((length, n) for length, n in histogram.items() if n), reverse=True)
    best: list[tuple[int, Contents]] | None = None
    for part in BORDERS:
        large = [(length, n) for length, n in lengths if length > capacity // part]
        open_runs: defaultdict[int, list] = defaultdict(list)
        if large:
            for n, contents in _substituted(_grouped(large, groups), capacity):
                open_runs[capacity - sum(length * often for length, often in contents)].append((n, contents))
        _fitted(open_runs, [(length, n) for length, n in lengths if length <= capacity // part], capacity)
        found = [run for room in sorted(open_runs) for run in open_runs[room]]
        if best is None or sum(n for n, _ in found) < sum(n for n, _ in best):
            best = found
    return best or []


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> np.ndarray:
    """Rows (length, first rank, pieces a sequence, first sequence, offset), by length and first rank.

    The pieces of that length with ranks from the first on go, so many to a sequence, into sequences from the first on.
    """
    ranks: Counter[int] = Counter()
    rows, sequence = [], 0
    for n, contents in runs_of_sequences(histogram, capacity, groups):
        offset = 0
        for length, often in contents:
            rows.append((length, ranks[length], often, sequence, offset))
            ranks[length] += n * often
            offset += length * often
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


# Placing


def _ranked(stored: DataFrame) -> DataFrame:
    """The pieces with ``rank``, from 0 within their length: prefix sums over blocks of the written table."""
    block = [F.xxhash64("_metadata.file_path").alias("file"), F.floor(F.col("_metadata.row_index") / BLOCK).alias("block")]
    rows = stored.select("*", *block, F.col("_metadata.row_index").alias("row"))
    key = ["length", "file", "block"]
    before = Window.partitionBy("length").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = written(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    within = F.row_number().over(Window.partitionBy(*key).orderBy("row", "doc_id", "piece"))
    return rows.withColumn("within", within).join(firsts, key).withColumn("rank", F.col("first") + F.col("within") - 1).drop("file", "block", "row", "within", "first")


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, groups: int = GROUPS, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ``ids``), sequence_id and offset for each piece."""
    stored = written(pieces(docs, path, capacity, end, with_ids))
    histogram = {row["length"]: row["n"] for row in stored.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per length
    rows = plan(histogram, capacity, groups)
    schema = ", ".join([*(f"{field.name} {field.dataType.simpleString()}" for field in stored.schema if field.name != "length"), "length bigint, sequence_id bigint, offset bigint"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = 48  # ranks are below that
        keys = (rows[:, 0] << bits) + rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(name).to_numpy().astype(np.int64) for name in ("length", "rank"))
            of = rows[np.searchsorted(keys, (length << bits) + rank, side="right") - 1]
            nth = rank - of[:, 1]
            kept = [name for name in batch.schema.names if name not in ("length", "rank")]
            added = [pa.array(length), pa.array(of[:, 3] + nth // of[:, 2]), pa.array(of[:, 4] + nth % of[:, 2] * length)]
            yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in kept), *added], names=[*kept, "length", "sequence_id", "offset"])

    return _ranked(stored).mapInArrow(place, schema)


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id and ``ids`` of each sequence, from pieces packed with their ids."""
    in_order = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most as many as a sequence has tokens
    joined = F.aggregate("pieces", F.lit(b"").cast("binary"), lambda ids, piece: F.concat(ids, piece["ids"]))
    return placed.groupBy("sequence_id").agg(in_order.alias("pieces")).select("sequence_id", joined.alias("ids"))


def layout(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset for each piece."""
    return packed(docs, path).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
