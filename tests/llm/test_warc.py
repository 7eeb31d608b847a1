import base64
import gzip
import hashlib
import random
from pathlib import Path

import pytest

from roadsift.llm import files, warc

SCHEMA = "page_id bigint, url string, html string, sha1 string, shard string, size string, first string"


@pytest.fixture
def make_pages(spark):
    def build(*rows):
        return spark.createDataFrame([(*row, "x", "x", "x", "x") for row in rows], SCHEMA)

    return build


def expected(rows, least=0):
    largest: dict = {}
    for page_id, _, html in rows:
        if page_id is not None:
            largest[html or ""] = max(largest.get(html or "", page_id), page_id)
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        first = largest.get(html or "", page_id) if len(data) >= least else page_id
        revisit = first is not None and first != page_id
        out.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


ODD = [
    (1, "http://a/", "same"), (2, "http://b/", "same"), (3, None, None), (4, "", ""), (5, "http://c/\r\nX: y", "é\r\n\r\nx" * 9000), (None, "http://d/", "same"),
    (None, "http://e/", "only here"), (6, "http://f/", "twice"), (6, "http://f/", "twice"), (7, "u", "\x00 WARC/1.1\r\n\r\n"), (-5, "http://g/", "same"),
]


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip_of_odd_pages(make_pages, least):
    got = warc.round_trip(make_pages(*ODD), least_bytes=least, roll_bytes=300, shard_bytes=1000)
    assert sorted(map(tuple, got.collect()), key=repr) == expected(ODD, least)


def test_empty_table(make_pages):
    assert warc.round_trip(make_pages((1, "u", "x")).limit(0)).collect() == []


def test_equal_pages_give_equal_files_that_gzip_reads(make_pages, tmp_path):
    draw = random.Random(2)
    rows = [(at * 37 % 1009, f"http://h/{at}", "".join(draw.choices("abcdefgh ", k=draw.randint(0, 900)))) for at in range(200)]
    pages = make_pages(*rows)
    folders = [warc.write_archive(pages.repartition(n), str(tmp_path / str(n)), roll_bytes=6000, shard_bytes=30_000) for n in (2, 5)]
    first, second = ({path.name: path.read_bytes() for path in Path(folder).glob("*.warc.gz")} for folder in folders)
    assert first == second and len(first) > 4
    assert any(name.endswith("00001.warc.gz") for name in first) and max(map(len, first.values())) < 8000
    assert not (tmp_path / "2" / "temporary").exists()
    ids = []
    for name in sorted(first):
        plain = gzip.decompress(first[name]).decode()
        ids += [int(line.rsplit(":", 1)[1].strip("<>")) for line in plain.split("\r\n") if line.startswith("WARC-Record-ID")]
    assert ids == sorted(row[0] for row in rows)


def test_only_what_the_manifest_names_is_read(make_pages, spark, tmp_path):
    folder = warc.write_archive(make_pages((1, "u", "x")), str(tmp_path / "a"))
    (tmp_path / "a" / "pages-000009-00000.warc.gz").write_bytes(warc.compressed(warc.record(9, "u", b"y", 1, warc.digest(b"y"), None)))
    assert [row["page_id"] for row in warc.read_archive(spark, folder).collect()] == [1]
    (tmp_path / "a" / "manifest.json").unlink()
    with pytest.raises(FileNotFoundError):
        warc.read_archive(spark, folder)


def test_renaming_can_be_repeated(tmp_path):
    store, base = files.opened(str(tmp_path))
    (tmp_path / "t").write_text("x")
    for _ in range(2):
        files.moved(store, f"{base}/t", f"{base}/f")
    assert (tmp_path / "f").read_text() == "x"
    with pytest.raises(FileNotFoundError):
        files.moved(store, f"{base}/t", f"{base}/g")


def test_damage_is_noticed(tmp_path):
    good = warc.record(1, "u", b"payload", 7, warc.digest(b"payload"), None)
    with pytest.raises(ValueError):
        warc.described(*next(warc.read_records(_source(tmp_path, warc.compressed(good.replace(b"payload", b"pAyload"))))))
    with pytest.raises(ValueError):
        list(warc.read_records(_source(tmp_path, warc.compressed(good)[:-9])))


def _source(tmp_path, data):
    (tmp_path / "file").write_bytes(data)
    return (tmp_path / "file").open("rb")


def _record_ids(folder):
    return [line for path in Path(folder).glob("*.warc.gz") for line in gzip.decompress(path.read_bytes()).split(b"\r\n") if line.startswith(b"WARC-Record-ID")]


def test_any_64_bit_ids_and_an_outlying_one(make_pages, tmp_path):
    draw = random.Random(5)
    body = lambda: "".join(draw.choices("abcdefgh ", k=500))
    wide = [(draw.choice([-1, 1]) * draw.randint(9 * 10**18, 2**63 - 1), f"u{at}", body()) for at in range(60)]
    dense = [(at, f"u{at}", body()) for at in range(120)] + [(10**15, "far", body())]
    for rows in (wide, dense):
        pages = make_pages(*rows)
        assert sorted(map(tuple, warc.round_trip(pages, shard_bytes=5000).collect()), key=repr) == expected(rows)
        folder = warc.write_archive(pages, str(tmp_path / str(len(rows))), shard_bytes=5000)
        sizes = [len(gzip.decompress(path.read_bytes())) for path in Path(folder).glob("*.warc.gz")]
        assert len(sizes) >= 6 and max(sizes) <= 1.5 * sorted(sizes)[len(sizes) // 2]


def test_null_and_repeated_ids_fill_many_shards_under_ids_of_their_own(make_pages, tmp_path):
    rows = [(None, "u", "the same text " * 10)] * 90 + [(None, f"u{at}", f"text {at} " * 20) for at in range(30)] + [(7, "v", "seven " * 30)] * 40 + [(at, "w", f"{at} " * 60) for at in range(20, 60)]
    pages = make_pages(*rows)
    assert sorted(map(tuple, warc.round_trip(pages, shard_bytes=2000).collect()), key=repr) == expected(rows)
    folder = warc.write_archive(pages, str(tmp_path / "a"), shard_bytes=2000)
    ids = _record_ids(folder)
    assert len(ids) == len(set(ids)) == len(rows)
    assert len({path.name for path in Path(folder).glob("*.warc.gz")}) >= 12
