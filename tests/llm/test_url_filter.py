import random

import numpy as np
import pytest

from roadsift.llm import url_filter
from roadsift.llm.queries import URL_RULES

ODD = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "http://NET/en/1", "http://a.b.example.net/en/x?q=/de/", "https://example.net/en", "ftp://xnet/",
    "http://example.com/de/#x", "http://example.com#/de/", "http://sub.Example.COM/de/", "a://b://c/", "http://é.org/fr/", "http://user@site.org:80/fr/", "http://org/fr/",
    "http://.net/", "http://x.net./", "http://x.net\n/", "http://a/\nb?c", "http://site.org/FR/",
]


def plain(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = rest[:cut], rest[cut:]
        path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[2] if best else default


@pytest.fixture
def make(spark):
    def build(urls, rules):
        pages = spark.createDataFrame([(at if at % 7 else None, url, "x", "x") for at, url in enumerate(urls)], "page_id bigint, url string, host string, verdict string")
        return pages, spark.createDataFrame(rules, "host string, path string, verdict string")

    return build


def check(make, urls, rules, default="allow"):
    got = sorted(map(tuple, url_filter.judged(*make(urls, rules), default).collect()), key=repr)
    assert got == sorted(((at if at % 7 else None, *plain(url, rules, default)) for at, url in enumerate(urls)), key=repr)


def test_odd_urls(make):
    check(make, ODD + ODD, URL_RULES)


@pytest.mark.parametrize("few", [url_filter.FEW, 0])
def test_random_rules_and_full_filters(make, few, monkeypatch):
    monkeypatch.setattr(url_filter, "FEW", few)
    monkeypatch.setattr(url_filter, "MOST_BLOCKS", 1)  # overfull: nearly all passes, the join decides
    draw = random.Random(few)
    label = lambda: draw.choice(["a", "b", "c", "net"])
    rules = sorted({(".".join(label() for _ in range(draw.randint(1, 3))), draw.choice(["", "/", "/x", "/x/", "/y/z"])) for _ in range(40)})
    rules = [(host, path, draw.choice(["block", "allow"])) for host, path in rules]
    urls = [f"http://{'.'.join(label() for _ in range(draw.randint(1, 4)))}{draw.choice(['', '/', '/x', '/x/q', '/y/z/1', '?x'])}" for _ in range(300)]
    check(make, urls, rules, "block")


def test_empty_tables(make):
    pages, rules = make(ODD, URL_RULES)
    assert url_filter.judged(pages.limit(0), rules).collect() == []
    assert {(row["rule"], row["verdict"]) for row in url_filter.judged(pages, rules.limit(0)).collect()} == {(None, "allow")}


def test_filter_passes_all_it_holds_and_little_else(spark):
    keys = spark.createDataFrame([(f"k{at}",) for at in range(3000)], "key string")
    bits = url_filter.bloom_filter(keys, 3000)

    def share(prefix):
        frame = spark.createDataFrame([(f"{prefix}{at}",) for at in range(3000)], "key string").selectExpr("xxhash64(key) AS h")
        rows = frame.select("h", url_filter._bits(frame["h"]).alias("bits")).collect()
        block = np.array([row["h"] % len(bits) for row in rows])
        return url_filter.possible(bits, block, np.array([row["bits"] for row in rows])).mean()

    assert share("k") == 1.0 and share("other") < 0.02


def test_hosts_of_very_many_labels(make):
    long = "a." * 40_000
    urls = [f"http://{long}net/", f"http://{long}example.net/en/x", f"http://{long}other/", "http://net/", f"http://{'.' * 40_000}net/"]
    pages, rules = make(urls, URL_RULES)
    assert [(row["rule"], row["verdict"]) for row in url_filter.judged(pages, rules).orderBy("page_id").collect()] == [
        ("net/", "block"), ("example.net/en/", "allow"), (None, "allow"), ("net/", "block"), ("net/", "block"),
    ]
