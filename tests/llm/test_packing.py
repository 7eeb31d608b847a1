import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from roadsift.llm import packing, queries

PATH = public_tokenizers.path(queries.PACKING_VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def _check(rows, placed, library, capacity=1024):
    """Every piece of every row is there with its ids, and the sequences are gapless and short enough."""
    want = Counter()
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) - (len(ids) - 1) // capacity * capacity
        for piece, start in enumerate([0, *range(first, len(ids), capacity)]):
            own = ids[start : first if piece == 0 else start + capacity]
            want[doc_id, piece, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert Counter((row["doc_id"], row["piece"], row["start"], row["length"], row["ids_crc32"]) for row in placed) == want
    held = defaultdict(list)
    for row in placed:
        held[row["sequence_id"]].append((row["offset"], row["length"]))
    for content in held.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_all_documents_are_packed_tightly(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    placed = packing.layout(docs, PATH).collect()
    used = _check([(row["doc_id"], row["text"]) for row in docs.collect()], placed, library)
    least = -(-sum(row["length"] for row in placed) // 1024)
    assert used <= least + 2


def test_odd_rows_and_the_sequences_themselves(odd_docs, no_docs, library):
    rows = [(row["doc_id"], row["text"]) for row in odd_docs.collect()]
    _check(rows, packing.layout(odd_docs, PATH).collect(), library)
    small = packing.packed(odd_docs, PATH, capacity=16, groups=3, with_ids=True)
    _check(rows, small.collect(), library, 16)
    found = {row["sequence_id"]: bytes(row["ids"]) for row in packing.sequences(small).collect()}
    for row in small.collect():
        at = 4 * row["offset"]
        assert found[row["sequence_id"]][at : at + 4 * row["length"]] == bytes(row["ids"])
    assert packing.layout(no_docs, PATH).collect() == []


def test_a_hot_length_in_small_blocks(monkeypatch, make_docs, library):
    monkeypatch.setattr(packing, "BLOCK", 7)
    rows = [(at if at % 3 else None, "the same words again" if at % 2 else f"others {at}") for at in range(200)]
    _check(rows, packing.layout(make_docs(*rows), PATH).collect(), library)


@pytest.mark.parametrize("text", ["it's we'll 'tis I'd'd", "a  b \t\n c   ", "été ª ² ½ x\xa0y \xa0", "<|endoftext|> a", "\x1c\x1d a \x85b", "漢字 and \u0378 x", "\U0001f600 !!", "'", " ", "a\u00adb"])
def test_ids_are_the_librarys(library, text):
    encoder = packing.Encoder(open(PATH, encoding="utf-8").read())
    assert encoder.remembers
    for _ in range(2):
        assert [ids.tolist() for ids in encoder.ids([text, "", text])] == [library.encode(each, add_special_tokens=False).ids for each in (text, "", text)]


def test_long_texts_in_parts_and_few_words_remembered(monkeypatch, library):
    monkeypatch.setattr(packing, "PART", 11)
    monkeypatch.setattr(packing, "WORDS", 5)
    random.seed(3)
    text = "".join(random.choices(["word ", "Wort, ", " ", "été ", "12 ", "it's ", "\n", "漢 ", "x"], k=600))
    encoder = packing.Encoder(open(PATH, encoding="utf-8").read())
    assert [ids.tolist() for ids in encoder.ids([text, "", text])] == [library.encode(each, add_special_tokens=False).ids for each in (text, "", text)]
    assert len(encoder.words) < 40 and len(encoder.older) < 40


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [at for at, room in enumerate(rooms) if room >= length]
        if fits:
            rooms[min(fits, key=rooms.__getitem__)] -= length
        else:
            rooms.append(capacity - length)
    return len(rooms)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 30)), max_size=25), st.integers(1, 12))
def test_the_plan_places_every_rank_once(counts, groups):
    histogram = Counter()
    for length, n in counts:
        histogram[length] += n
    held = defaultdict(list)
    rows = packing.plan(histogram, 40, groups)
    for at, (length, rank, often, sequence, offset) in enumerate(rows.tolist()):
        following = rows[at + 1] if at + 1 < len(rows) else None
        stop = int(following[1]) if following is not None and following[0] == length else histogram[length]
        for nth in range(stop - rank):
            held[sequence + nth // often].append((offset + nth % often * length, length))
    assert Counter(length for content in held.values() for _, length in content) == histogram
    for content in held.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 40
    lengths = list(histogram.elements())
    if groups >= len(lengths):  # nothing is rounded
        assert len(held) <= best_fit_decreasing(lengths, 40) + 1


def test_few_sizes_cost_little():
    random.seed(5)
    histogram = Counter(min(1024, int(random.lognormvariate(6, 1)) + 1) for _ in range(100_000))
    sequences = sum(n for n, _ in packing.runs_of_sequences(histogram))
    rows = packing.plan(histogram)
    assert sequences <= 1.005 * sum(length * n for length, n in histogram.items()) / 1024
    assert len(rows) < 20_000
