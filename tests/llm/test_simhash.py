import random
import re

import numpy as np
import pytest
import xxhash

from roadsift.llm import simhash


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[at : at + 3]) for at in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(shingle.encode(), 42) for shingle in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(points, radius=2):
    """For each point the least of its component, by comparing all pairs."""
    root = {p: p for p in points}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for at, a in enumerate(points):
        for b in points[:at]:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {p: find(p) for p in points}


def clustered(draw, centers, around, flips):
    points = set()
    for _ in range(centers):
        center = draw.getrandbits(64)
        points.add(center)
        for _ in range(draw.randint(0, around)):
            point = center
            for bit in draw.sample(range(64), draw.randint(1, flips)):
                point ^= 1 << bit
            points.add(point)
    return sorted(points)


def test_fingerprint_of_odd_texts(odd_docs, monkeypatch):
    texts = [row["text"] for row in odd_docs.collect()]
    monkeypatch.setattr(simhash, "STRIDE", 777)
    assert [simhash.fingerprint((text or "").encode()) for text in texts] == [plain_fingerprint(text) for text in texts]


@pytest.mark.parametrize("seed", range(4))
def test_search_within_a_shard_loses_no_link(seed, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "BUFFER", 100)
    draw = random.Random(seed)
    points = clustered(draw, 60, 12, 3) if seed % 2 else clustered(draw, 3, 250, 4)
    got = simhash.components_within(np.array(points, np.uint64))
    want = plain_components(points)
    assert [points[at] for at in got] == [want[point] for point in points]


def test_every_link_meets_in_a_shard():
    draw = random.Random(9)
    points = clustered(draw, 150, 8, 3)
    nodes = simhash.fit_tree(np.array(points[::3], np.uint64), 12)
    shards = [set(map(int, some)) for _, some in simhash.route(nodes, np.array(points, np.uint64))]
    assert len(shards) > 8
    for at, a in enumerate(points):
        for b in points[:at]:
            if (a ^ b).bit_count() <= 2:
                assert any(a in shard and b in shard for shard in shards)


def test_components_over_shards(spark):
    draw = random.Random(5)
    chain = [draw.getrandbits(64)]
    for at in range(60):  # a long chain, each two bits from the one before
        chain.append(chain[-1] ^ (1 << (2 * at % 64)) ^ (1 << ((2 * at + 1) % 64)))
    points = sorted({*chain, *clustered(draw, 80, 6, 2)})
    frame = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in points], "fp bigint")
    links = simhash.shard_links(frame, sample=1000, shard=10)
    roots = {row["fp"]: row["root"] for row in simhash.components(links).collect()}
    want = plain_components(points)
    groups: dict = {}
    for point in points:
        signed = int(np.uint64(point).view(np.int64))
        groups.setdefault(want[point], set()).add(roots.get(signed, signed))
    assert all(len(found) == 1 for found in groups.values())
    assert len({next(iter(found)) for found in groups.values()}) == len(groups)


def test_near_duplicates_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {row["doc_id"]: row["text"] for row in docs.collect()}
    marks = {doc_id: plain_fingerprint(text) for doc_id, text in texts.items()}
    want = plain_components(sorted(set(marks.values())))
    least: dict = {}
    for doc_id, mark in marks.items():
        least[want[mark]] = min(least.get(want[mark], doc_id), doc_id)
    for row in simhash.near_duplicates(docs, shard=20).collect():
        assert row["fingerprint"] == f"{marks[row['doc_id']]:016x}"
        assert row["component_id"] == least[want[marks[row["doc_id"]]]]


def test_odd_rows(odd_docs, no_docs):
    found = {(row["doc_id"], row["fingerprint"], row["component_id"]) for row in simhash.near_duplicates(odd_docs).collect()}
    zero = "0" * 16
    assert {(3, zero, 3), (4, zero, 3), (5, zero, 3), (None, zero, 3)} <= found
    assert {row[2] for row in found if row[0] in (1, 2)} == {1} and {row[2] for row in found if row[0] in (6, 7)} == {6}
    kept = simhash.thinned(odd_docs)
    assert kept.schema == odd_docs.schema
    assert sorted(row["doc_id"] for row in kept.collect()) == [1, 3, 6, 8, 10, 11, 12, 13]
    assert simhash.near_duplicates(no_docs).collect() == [] and simhash.thinned(no_docs).collect() == []


def test_thinning_judges_each_row_by_its_own_id_and_text(make_docs):
    docs = make_docs(
        (1, "one two three four"), (None, "ONE two three four"), (None, "alone without an id"), (None, "only nulls here now"), (None, "ONLY nulls here now"),
        (7, "a repeated id with its first text"), (7, "quite another text stands below seven"), (3, "A repeated id with its first text"), (8, "given twice"), (8, "given twice"),
    )
    kept = simhash.thinned(docs).collect()
    assert sorted((row["doc_id"] or 0, row["text"].lower()) for row in kept) == [
        (0, "alone without an id"), (0, "only nulls here now"), (1, "one two three four"), (3, "a repeated id with its first text"),
        (7, "quite another text stands below seven"), (8, "given twice"),
    ]
