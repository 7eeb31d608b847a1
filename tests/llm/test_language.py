import itertools
import tracemalloc
import zlib

import numpy as np
import pytest

from roadsift.llm import crf, language

DE = "der hund und die katze gehen nicht über die straße weil es schon sehr spät ist und niemand schläft"
EN = "the dog and the cat are not crossing the street because it was already very late and nobody sleeps there"
FR = "le chien et la chatte ne traversent pas la rue parce que c'était déjà très tard et personne ne dort"


def plain_forward_backward(scores, moves):
    """By summing over all label sequences of one sentence."""
    size, count = scores.shape
    chance, expected, total = np.zeros_like(scores), np.zeros_like(moves), 0.0
    for path in itertools.product(range(count), repeat=size):
        weight = np.exp(sum(scores[at, label] for at, label in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
        total += weight
        for at, label in enumerate(path):
            chance[at, label] += weight
        for a, b in zip(path, path[1:]):
            expected[a, b] += weight
    return chance / total, expected / total


def test_forward_backward_equals_all_paths():
    draw = np.random.default_rng(1)
    lengths, moves = np.array([3, 1, 6, 2]), draw.normal(size=(3, 3))
    scores = draw.normal(size=(lengths.sum(), 3)) * 2
    chance, expected = crf.forward_backward(scores, lengths, moves)
    start, summed = 0, np.zeros((3, 3))
    for length in lengths:
        want, moved = plain_forward_backward(scores[start : start + length], moves)
        assert np.allclose(chance[start : start + length], want)
        summed += moved
        start += length
    assert np.allclose(expected, summed)


@pytest.fixture(scope="module")
def model():
    cut = lambda text: [" ".join(text.split()[at : at + 8]) + "." for at in range(0, 12)]
    return crf.fit([(text, name) for name, whole in (("de", DE), ("en", EN), ("fr", FR)) for text in cut(whole)])


def test_code_switched_words_are_labelled(model):
    labeler = crf.Labeler(model)
    words = [*EN.split()[:8], *DE.split()[:8]]
    rows = labeler._rows(words)
    chance, _ = crf.forward_backward(labeler.table[rows], np.array([len(words)]), model.moves)
    assert [model.labels[at] for at in chance.argmax(axis=1)] == ["en"] * 8 + ["de"] * 8


def test_parts_and_forgetting_do_not_change_sums(model, monkeypatch):
    texts = [f"{EN}. {DE}! {FR}\n" * 20, None or "", "123 ²", DE]
    want = crf.Labeler(model).sums(texts)
    monkeypatch.setattr(crf.Labeler, "GROUP", 60)
    monkeypatch.setattr(crf.Labeler, "MOST_WORDS", 40)
    got = crf.Labeler(model).sums(texts)
    assert np.allclose(got[0], want[0]) and (got[1] == want[1]).all() and want[1][2] == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {row["doc_id"]: row["lang"] for row in docs.select("doc_id", "lang").collect()}
    rows = language.identified(docs).collect()
    assert len(rows) == len(truth)
    assert all(row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 4 == 2) for row in rows)
    unseen = [row for row in rows if row["held_out"]]
    assert sum(truth[row["doc_id"]] == row["lang_pred"] for row in unseen) >= 0.98 * len(unseen) and all(0 <= row["score"] <= 1 for row in rows)
    # Neither the language nor the source of a held-out row has a part in its prediction.
    changed = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 'xx' ELSE lang END AS lang", "'s' AS source")
    assert {tuple(row) for row in language.identified(changed).collect()} == {tuple(row) for row in rows}


def test_odd_rows(odd_docs, no_docs):
    rows = {row["doc_id"]: row for row in language.identified(odd_docs).collect()}
    for doc_id in (3, 4, 5, 11):
        assert (rows[doc_id]["lang_pred"], rows[doc_id]["score"]) == ("und", 0.0)
    assert rows[6]["lang_pred"] != "und" and rows[12]["lang_pred"] != "und" and rows[None]["held_out"] is False
    kept = language.recognised(odd_docs)
    assert kept.schema == odd_docs.schema and {3, 4, 5, 11}.isdisjoint(row["doc_id"] for row in kept.collect())
    assert language.identified(no_docs).collect() == [] and language.recognised(no_docs).collect() == []


def test_nothing_learned_is_undetermined(make_docs):
    rows = language.identified(make_docs((1, "some words"), (2, "more words"))).collect()
    assert {(row["lang_pred"], row["score"]) for row in rows} == {("und", 0.0)}


def test_switches_within_texts_are_found(spark, make_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learned = crf.fit(language.sample(docs))
    words = {}
    for row in docs.filter("lang IS NOT NULL").filter(language.held_out(docs["doc_id"])).orderBy("doc_id").collect():
        words.setdefault(row["lang"], []).extend(word for word in row["text"].split() if word.isalpha())
    pieces, truth = [], []
    for turn in range(12):
        for name in sorted(words):
            pieces.append(" ".join(words[name][turn * 12 : turn * 12 + 12]))
            truth.append(name)
    text = " ".join(pieces)
    spans = crf.Labeler(learned).spans(text)
    right = start = 0
    for piece, name in zip(pieces, truth):
        for low, high, found in spans:
            if found == name:
                right += max(0, min(high, start + len(piece)) - max(low, start))
        start += len(piece) + 1
    assert right >= 0.9 * len(text)
    assert learned.moves.shape == (len(learned.labels),) * 2
    rows = language.word_spans(make_docs((1, text), (2, None), (3, "12 !"), (4, "İİ the dog")), learned).collect()
    assert [[tuple(span) for span in row["spans"]] for row in rows] == [spans, [], [], crf.Labeler(learned).spans("İİ the dog")]
    assert rows[0]["row"]["doc_id"] == 1 and language.word_spans(no_docs, learned).collect() == []


def test_every_language_is_learned_in_bounded_memory(spark, monkeypatch):
    assert language.sample_size(4) == language.sample_size(15) == (200, 2000)
    for languages in (16, 40, 300):
        documents, window = language.sample_size(languages)
        assert documents >= 1 and window >= 200 and documents * window * languages**2 <= language.SAMPLE_CELLS
    rows = [(at, " ".join(f"w{chr(97 + label % 26)}{chr(97 + label // 26)}{chr(97 + at * n % 23)}" for n in range(40)), f"l{label:03d}") for at, label in enumerate(list(range(300)) * 4)]
    sample = language.sample(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert len({label for _, label in sample}) == 300
    monkeypatch.setattr(crf, "ROUNDS", 2)
    tracemalloc.start()
    fitted = crf.fit(sample)
    assert len(fitted.labels) == 300 and tracemalloc.get_traced_memory()[1] < 1 << 30
    tracemalloc.stop()


def test_joined_sentences_switch_and_repeat():
    sentences = [([f"w{at}{n}" for n in range(1 + at % 5)], at % 3) for at in range(100)]
    joined = crf._switched(sentences)
    assert joined == crf._switched(sentences) and joined
    assert all(len(words) == len(labels) and len(set(labels)) == 2 for words, labels in joined)
