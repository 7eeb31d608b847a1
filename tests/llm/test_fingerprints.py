import hashlib
import random

import numpy as np
import pytest

from roadsift.llm import fingerprints


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[at : at + 5]) for at in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def walked(rows):
    """(doc_id, text) in the order of the walk."""
    tie = lambda row: hashlib.md5((row[1] or "").encode()).hexdigest()
    return sorted(sorted(rows, key=tie, reverse=True), key=lambda row: (row[0] is not None, row[0] or 0), reverse=True)


def check(rows, got):
    order = walked([(doc_id, text or "") for doc_id, text in rows])
    want = []
    for at, (doc_id, text) in enumerate(order):
        following = order[(at + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest()))
        row = next(r for r in got if (r["doc_id"], r["n_chars"], r["edited_sha256"]) == want[-1])
        assert row["near_edited"] == pytest.approx(similarity(shingles(text), shingles(edited)), abs=0.2)
        assert row["near_next"] == pytest.approx(similarity(shingles(text), shingles(following)), abs=0.2)
    assert sorted(want, key=repr) == sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=repr)


def test_neighbours_of_the_smallest_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check([(row["doc_id"], row["text"]) for row in docs.collect()], fingerprints.fingerprints_with_neighbours(docs.repartition(5)).collect())


def test_odd_rows(odd_docs, no_docs, make_docs):
    rows = [(row["doc_id"], row["text"]) for row in odd_docs.collect()]
    got = fingerprints.fingerprints_with_neighbours(odd_docs).collect()
    check(rows, got)
    assert len({row["fingerprint"] for row in got if row["doc_id"] in (3, 4, 5)}) == 1
    assert len({row["fingerprint"] for row in got if row["doc_id"] in (8, 9)}) == 1
    single = fingerprints.fingerprints_with_neighbours(make_docs((1, "a b"))).first()
    assert single["near_next"] == 1.0
    assert fingerprints.fingerprints_with_neighbours(no_docs).collect() == []


def test_signatures_estimate_similarity():
    draw = random.Random(4)
    off = []
    for _ in range(60):
        words = [f"w{draw.randint(0, 10**6)}" for _ in range(300)]
        other = [*words[: draw.randint(0, 300)], *(f"v{at}" for at in range(150))]
        a, b = " ".join(words), " ".join(other)
        estimate = fingerprints.likeness(*(fingerprints.signature(fingerprints.shingle_hashes(text)) for text in (a, b)))
        off.append(estimate - fingerprints.jaccard(a, b))
        assert fingerprints.jaccard(a, b) == pytest.approx(similarity(shingles(a), shingles(b)))
    assert abs(np.mean(off)) < 0.02 and np.abs(off).max() < 0.2


def test_blocks_do_not_change_a_signature(monkeypatch):
    hashes = fingerprints.shingle_hashes(" ".join(map(str, range(5000))))
    whole = fingerprints.signature(hashes)
    monkeypatch.setattr(fingerprints, "BLOCK", 7)
    assert (fingerprints.signature(hashes) == whole).all()


def test_near_duplicates_are_true_and_found(make_docs):
    draw = random.Random(6)
    rows = []
    for group in range(25):
        words = [f"g{group}w{at}" for at in range(200)]
        for copy in range(4):
            own = list(words)
            own[draw.randrange(200)] = f"c{copy}"
            rows.append((len(rows), " ".join(own)))
    rows += [(200, rows[0][1]), (201, None), (202, ""), (None, rows[0][1])]
    texts = dict(rows)
    links = fingerprints.near_duplicates(make_docs(*rows)).collect()
    for row in links:
        assert row["other_id"] < row["doc_id"]
        assert row["jaccard"] == pytest.approx(similarity(shingles(texts[row["doc_id"]]), shingles(texts[row["other_id"]]))) and row["jaccard"] >= 0.8
    root = {}
    for row in sorted(links, key=lambda row: row["doc_id"]):
        root[row["doc_id"]] = min(root.get(row["doc_id"], row["doc_id"]), root.get(row["other_id"], row["other_id"]))
    assert all(root.get(at, at) == at // 4 * 4 for at in range(100)) and root[200] == 0 and root[202] == 201


def test_a_passage_that_many_share_hides_no_copies(make_docs):
    rows, want = [], set()
    for group in range(4):
        passage = [f"g{group}p{at}" for at in range(200)]
        rows += [(1000 * group + at, " ".join([*passage, *(f"g{group}d{at}w{n}" for n in range(55))])) for at in range(250)]
        a, b = 10**9 + 2 * group, 10**9 + 2 * group + 1  # alike in every band, as the other holders of the passage are in many
        rows += [(at, " ".join([*passage, f"copy{at}"])) for at in (a, b)]
        want.add((b, a))
    assert {(row["doc_id"], row["other_id"]) for row in fingerprints.near_duplicates(make_docs(*rows)).collect()} == want


def test_thinning_keeps_one_of_edited_copies(make_docs):
    words = [f"w{at}" for at in range(120)]
    edited = " ".join([*words[:40], "other", *words[41:]])
    docs = make_docs((4, edited), (2, " ".join(words)), (None, " ".join(words) + " more"), (None, "no copy of any"), (9, "no copy at all"), (9, "a text of its own"))
    kept = fingerprints.thinned(docs).collect()
    assert sorted((row["doc_id"] or 0, row["text"]) for row in kept) == [(0, "no copy of any"), (2, " ".join(words)), (9, "a text of its own"), (9, "no copy at all")]
    assert kept[0].asDict().keys() == set(docs.columns)
