"""Fill-in-the-middle: texts are cut in three and reordered, by displacement scatter.

A text is cut into units, ASCII words or single other code points. Two hashed cuts make prefix, middle and suffix; most texts
are rewritten with marks in the order prefix, suffix, middle (psm) or suffix, prefix, middle (spm), some stay plain, and so do
empty texts and those that hold a mark already.

Displacement scatter: a batch's texts are one run of bytes. Its unit starts are scanned, and the cuts found among them. A
piece between two cuts moves as a whole, so only the first byte of a piece has an entry in the difference array; its
cumulative sum is every byte's shift, and one scatter writes the output of the batch. The way back reads the marks of
the output, forms the same differences, and gathers. All passes go over the batch in strides, so a very long text
takes its own bytes and little more.

Scale: no shuffle; a row's result depends on the row alone, so a lost task is simply run again.

Defined results: a null text counts as empty; a null id counts as an empty number; repeated rows give repeated results;
an empty table gives an empty result; other columns, whatever their names, are left alone.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadsift.llm.batches import bounded
from roadsift.llm.texts import utf8

SEED = "1"
#: Shares, in hundredths, of texts that are rewritten, and of these in the order suffix, prefix, middle.
REWRITTEN = 90
SUFFIX_FIRST = 20
#: Bytes that a pass works on at a time.
STRIDE = 1 << 20

# The marks, and the order of the pieces (0 prefix, 1 middle, 2 suffix) in each form.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
ORDERS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
MARKS = {0: PREFIX, 1: MIDDLE, 2: SUFFIX}
MARK = len(PREFIX)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
_FOLLOWS = np.zeros(256, bool)  # bytes within a code point
_FOLLOWS[0x80:0xC0] = True


# Passes over the bytes of a batch


def _strides(size: int) -> Iterator[tuple[int, int]]:
    for start in range(0, size, STRIDE):
        yield start, min(start + STRIDE, size)


def unit_starts(data: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Which bytes begin a unit; ``firsts`` are the places where texts begin."""
    starts = np.empty(len(data), bool)
    for low, high in _strides(len(data)):
        letters = _LETTER[data[low:high]]
        after = np.concatenate(([low > 0 and _LETTER[data[low - 1]]], letters[:-1]))
        starts[low:high] = ~_FOLLOWS[data[low:high]] & ~(letters & after)
    starts[firsts[firsts < len(data)]] = True
    return starts


def counts_before(flags: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many flags are set before each of the places, which rise."""
    found, held = np.zeros(len(places), np.int64), 0
    for low, high in _strides(len(flags)):
        sums = np.concatenate(([0], np.cumsum(flags[low:high], dtype=np.int64)))
        a, b = np.searchsorted(places, [low, high])
        found[a:b] = held + sums[places[a:b] - low]
        held += int(sums[-1])
    found[np.searchsorted(places, len(flags)) :] = held
    return found


def places_of(flags: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The places of the flags with these ranks, which rise; a rank beyond the last flag gives the length."""
    found, held = np.full(len(ranks), len(flags), np.int64), 0
    for low, high in _strides(len(flags)):
        here = np.flatnonzero(flags[low:high])
        a, b = np.searchsorted(ranks, [held, held + len(here)])
        found[a:b] = low + here[ranks[a:b] - held]
        held += len(here)
    return found


def mark_places(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all marks, rising, and the text each is in; bytes of two texts make no mark."""
    found = []
    middles = {mark[1] for mark in MARKS.values()}
    for low, high in _strides(len(data) - MARK + 1):
        at = low + np.flatnonzero((data[low:high] == PREFIX[0]) & (data[low + 2 : high + 2] == PREFIX[2]))
        found.append(at[np.isin(data[at + 1], list(middles))])
    at = np.concatenate([*found, np.zeros(0, np.int64)])
    text = np.searchsorted(ends, at, side="right")
    within = at + MARK <= ends[text] if len(at) else np.zeros(0, bool)
    return at[within], text[within]


def shifts(firsts: np.ndarray, moves: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(low, high, shift of each byte) in strides; the byte at ``firsts[i]`` and those up to the next move by ``moves[i]``.

    ``firsts`` rise. Empty pieces share a place with the piece after them; their differences add up to its own.
    """
    steps, held = np.diff(moves, prepend=0), 0
    for low, high in _strides(size):
        differences = np.zeros(high - low, np.int64)
        a, b = np.searchsorted(firsts, [low, high])
        np.add.at(differences, firsts[a:b] - low, steps[a:b])
        differences[0] += held
        moved = np.cumsum(differences)
        held = int(moved[-1])
        yield low, high, moved


def _laid_out(sizes: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each text's pieces begin in its output (a column per piece), and the size of the output.

    ``sizes`` has a column per piece, ``forms`` a form per text; the pieces of a plain text stay where they are.
    """
    begin = np.zeros_like(sizes)
    begin[:, 1:] = np.cumsum(sizes, axis=1)[:, :-1]
    for form, order in ORDERS.items():
        rows = forms == form
        at = np.zeros(int(rows.sum()), np.int64)
        for piece in order:
            begin[rows, piece] = at + MARK
            at = at + MARK + sizes[rows, piece]
    return begin, sizes.sum(axis=1) + np.where(forms == "plain", 0, MARK * len(MARKS))


def scatter(data: np.ndarray, bounds: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The outputs of a batch as one run of bytes, and where each begins and the last ends.

    ``bounds`` has a row per text: where prefix, middle and suffix begin, and where the text ends.
    """
    sizes = np.diff(bounds, axis=1)
    begin, length = _laid_out(sizes, forms)
    offsets = np.concatenate(([0], np.cumsum(length)))
    begin += offsets[:-1, None]
    output = np.empty(int(offsets[-1]), np.uint8)
    for low, high, moved in shifts(bounds[:, :-1].ravel(), (begin - bounds[:, :-1]).ravel(), len(data)):
        output[np.arange(low, high) + moved] = data[low:high]
    rewritten = forms != "plain"
    for piece, mark in MARKS.items():
        for at, byte in enumerate(mark):
            output[begin[rewritten, piece] - MARK + at] = byte
    return output, offsets


def gather(output: np.ndarray, offsets: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The way back, from outputs and forms alone: texts as one run of bytes, and where each begins and the last ends."""
    starts, ends = offsets[:-1], offsets[1:]
    sizes = np.zeros((len(forms), len(MARKS)), np.int64)
    source = np.zeros_like(sizes)
    plain = forms == "plain"
    sizes[plain, 0], source[plain, 0] = (ends - starts)[plain], starts[plain]
    at, text = mark_places(output, ends)
    at, text = at[~plain[text]], text[~plain[text]]
    if not np.array_equal(text, np.repeat(np.flatnonzero(~plain), len(MARKS))):
        raise ValueError("an output does not hold the three marks of its form")
    at = at.reshape(-1, len(MARKS))
    stop = np.concatenate([at[:, 1:], ends[text].reshape(-1, len(MARKS))[:, :1]], axis=1)
    for form, order in ORDERS.items():
        of_marked, rows = forms[~plain] == form, np.flatnonzero(forms == form)
        for place, piece in enumerate(order):
            source[rows, piece] = at[of_marked, place] + MARK
            sizes[rows, piece] = stop[of_marked, place] - at[of_marked, place] - MARK
    back = np.concatenate(([0], np.cumsum(sizes.sum(axis=1))))
    first = back[:-1, None] + np.cumsum(sizes, axis=1) - sizes
    text_bytes = np.empty(int(back[-1]), np.uint8)
    source[sizes == 0] = first[sizes == 0]  # empty pieces move nothing
    for low, high, moved in shifts(first.ravel(), (source - first).ravel(), len(text_bytes)):
        text_bytes[low:high] = output[np.arange(low, high) + moved]
    return text_bytes, back


# Columns


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary column as one run of bytes, and where each begins and the last ends."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    values = column.buffers()[2]
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _column(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data)])


def cut_and_moved(batch: pa.RecordBatch, rewritten: int, suffix_first: int) -> pa.RecordBatch:
    """A batch of texts and hash groups with its units, forms, pieces and outputs."""
    data, offsets = _bytes_of(batch.column("text"))
    h1, h2, h3, h4 = (batch.column(name).to_numpy() for name in ("h1", "h2", "h3", "h4"))
    starts, ends = offsets[:-1], offsets[1:]
    units = unit_starts(data, starts)
    upto = counts_before(units, offsets)
    first, n = upto[:-1], np.diff(upto)
    cuts = np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)], axis=1), axis=1)
    places = places_of(units, (first[:, None] + cuts).ravel()).reshape(-1, 2)
    places = np.where(cuts == n[:, None], ends[:, None], places)
    marked = np.zeros(len(n), bool)
    marked[mark_places(data, ends)[1]] = True
    forms = np.where((ends == starts) | marked | (h3 % 100 >= rewritten), "plain", np.where(h4 % 100 < suffix_first, "spm", "psm"))
    plain = forms == "plain"
    bounds = np.column_stack([starts, places, ends])
    points = counts_before(~_FOLLOWS[data], bounds.ravel()).reshape(-1, 4)
    chars = np.diff(points, axis=1)
    output, at = scatter(data, bounds, forms)
    columns = [
        batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(forms.tolist(), pa.string()),
        pa.array(chars[:, 0], pa.int64(), mask=plain), pa.array(chars[:, 1], pa.int64(), mask=plain), _column(output, at),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def _hash_group(digest: Column, at: int) -> Column:
    return F.conv(F.substring(digest, 8 * at + 1, 8), 16, 10).cast("long")


def transformed(docs: DataFrame, seed: str = SEED, rewritten: int = REWRITTEN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars and ``output`` (UTF-8 bytes) per row of ``docs``."""
    number = F.coalesce(docs["doc_id"].cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), number).cast("binary"), 256)
    narrow = docs.select(docs["doc_id"].alias("doc_id"), utf8(docs["text"]).alias("text"), *(_hash_group(digest, at).alias(f"h{at + 1}") for at in range(4)))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            yield cut_and_moved(batch, rewritten, suffix_first)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(rewrite, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary")


def restored(rows: DataFrame) -> DataFrame:
    """The rows (of ``transformed``) with ``restored``, the text's bytes rebuilt from output and form."""
    schema = f"{', '.join(f'`{field.name}` {field.dataType.simpleString()}' for field in rows.schema)}, restored binary"

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "output"):
            output, offsets = _bytes_of(batch.column("output"))
            back = gather(output, offsets, np.array(batch.column("form").to_pylist(), dtype="U5"))
            yield pa.RecordBatch.from_arrays([*batch.columns, _column(*back)], names=[*batch.schema.names, "restored"])

    return rows.mapInArrow(rebuild, schema)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256 per row of ``docs``."""
    both = restored(transformed(docs))
    return both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
