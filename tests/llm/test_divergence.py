import random
import re
from collections import Counter, defaultdict

import pytest

from roadsift.llm import divergence


def plain_audit(rows, least):
    """The audit of (text, source, lang) rows by the rules, with dense shares."""
    found, holding = defaultdict(Counter), defaultdict(Counter)
    groups = set()
    for text, source, lang in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        found[lang, source].update(terms)
        holding[lang].update(set(terms))
    result = set()

    def share(counts, kept):
        total = sum(counts[term] for term in kept)
        return {term: 1 + 10**9 * (counts[term] + 5) // (total + 5 * len(kept)) for term in kept}

    for lang in {lang for lang, _ in groups}:
        kept = [term for term, n in holding[lang].items() if n >= least]
        sources = sorted(source for own, source in groups if own == lang)
        shares = {source: share(found[lang, source], kept) for source in sources}
        usual = share(sum((found[lang, source] for source in sources), Counter()), kept)
        for source in sources:
            pairs = [(sum(abs(shares[source][t] - shares[other][t]) for t in kept), other) for other in sources if other != source]
            own = [(shares[source][t] - usual[t], t) for t in kept if found[lang, source][t] and shares[source][t] > usual[t]]
            for part, values, most in (("pair", pairs, None), ("term", own, 50)):
                for at, (value, item) in enumerate(sorted(values, key=lambda x: (-x[0], x[1].encode()))[:most], start=1):
                    result.add((lang, source, part, item, value, at))
    return result


def _rows(seed, sources, size=200):
    random.seed(seed)
    words = ["Alpha", "beta", "été", "ÉTÉ", "漢字", "x1y", "don't", "zeta", *(f"w{chr(97 + at % 26)}{chr(97 + at // 26)}" for at in range(150))]
    return [(" ".join(random.choices(words, k=random.randint(0, 40))), random.choice(sources), random.choice(["en", "de", None, ""])) for _ in range(size)]


@pytest.mark.parametrize("groups_a_block, terms_a_block", [(64, 2048), (3, 7), (1, 1000)])
def test_equals_dense_shares_in_any_cube(spark, make_docs, groups_a_block, terms_a_block):
    rows = [*_rows(1, [*"abcdefghij", None, "é"]), (None, "nothing", "en"), ("", "empty", "fr"), ("alone", "only", "it"), ("alone", "only", "it")]
    docs = make_docs(*((at, text, source, lang) for at, (text, source, lang) in enumerate(rows)))
    shares = divergence.Shares(docs, 5)
    want = plain_audit(rows, 5)
    pairs = {tuple(row) for row in divergence.pair_divergences(shares, groups_a_block, terms_a_block).collect()}
    assert pairs == {(lang, source, item, value) for lang, source, part, item, value, _ in want if part == "pair"}
    if groups_a_block == 64:
        assert {tuple(row) for row in divergence.audit(docs, 5).collect()} == want


def test_long_texts_in_pieces_and_counts_sent_in_parts(monkeypatch, make_docs):
    assert [term for terms in divergence._pieces(b"Ab cd1ef " * 3) for term in terms] == [b"ab", b"cd", b"ef"] * 3
    monkeypatch.setattr(divergence, "PIECE", 4)
    assert [term for terms in divergence._pieces(b"Abcdefgh ij1kl ") for term in terms] == [b"abcdefgh", b"ij", b"kl"]


def test_odd_rows(odd_docs, no_docs):
    rows = [(row["text"], row["source"], row["lang"]) for row in odd_docs.collect()]
    assert {tuple(row) for row in divergence.audit(odd_docs, 2).collect()} == plain_audit(rows, 2)
    assert divergence.audit(no_docs).collect() == []


def test_shares_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(divergence._share(F.lit(10**13), F.lit(3 * 10**13), F.lit(10))).first()
    assert row[0] == 1 + 10**9 * (10**13 + 5) // (3 * 10**13 + 50)
