import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from roadsift.llm import exact_dedup


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def expected(rows, keep):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[lowered(text)].append(doc_id)
    pick = {"smallest": min, "largest": max}[keep]
    best = {text: pick((x for x in ids if x is not None), default=None) for text, ids in groups.items()}
    out, used = [], set()
    for doc_id, text in rows:
        body = lowered(text)
        kept = doc_id == best[body] and body not in used
        used |= {body} if kept else set()
        out.append((doc_id, best[body], len(groups[body]), kept, hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_decisions_equal_brute_force(odd_docs):
    rows = [(row["doc_id"], row["text"]) for row in odd_docs.collect()]
    for keep in ("smallest", "largest"):
        got = sorted(map(tuple, exact_dedup.decisions(odd_docs, keep).collect()), key=repr)
        assert got == expected(rows, keep)


def test_colliding_hashes_are_told_apart(make_docs):
    draw = random.Random(3)
    rows = [(at, "".join(draw.choice("aAbB") for _ in range(draw.randint(0, 4)))) for at in range(120)]
    docs = make_docs(*rows)

    def weak(body):
        return F.unhex(F.md5((F.length(body) % 2).cast("string")))

    got = sorted(map(tuple, exact_dedup.decisions(docs, digest=weak).collect()), key=repr)
    assert got == expected(rows, "smallest")
    kept = sorted(row["doc_id"] for row in exact_dedup.deduplicated(docs, digest=weak).collect())
    assert kept == sorted(row[0] for row in got if row[3])


def test_kept_rows_are_whole(odd_docs):
    kept = exact_dedup.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns and kept.schema == odd_docs.schema
    rows = kept.collect()
    assert sorted((row["doc_id"] for row in rows), key=repr) == sorted([1, 3, 5, 6, 7, 8, 10, 11, 12, 13], key=repr)
    assert all(row["hash"] == "hash" for row in rows)


def test_row_given_twice_stays_once(make_docs):
    docs = make_docs((9, "x"), (9, "x"), (9, "y"), (None, "z"), (None, "z"))
    assert sorted(((row["doc_id"], row["text"]) for row in exact_dedup.deduplicated(docs).collect()), key=repr) == [(9, "x"), (9, "y"), (None, "z")]


def test_empty_table(no_docs):
    assert exact_dedup.decisions(no_docs).collect() == [] and exact_dedup.deduplicated(no_docs).collect() == []


def test_no_python_on_the_executors(make_docs):
    plan = exact_dedup.decisions(make_docs((1, "a")))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "MapPartitions"))
