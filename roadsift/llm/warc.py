"""A deterministic, sharded WARC writer, and the reader of its archives.

Pages are range-sorted by id and payload digest, each shard a range of about equal bytes; a shard's files roll at a
compressed size. A record has regenerated headers (length, block and payload digests, an id of its own made from digest and
page id, a fixed date), is a gzip member of its own, and contains nothing of the run, so equal pages give equal bytes. Of
records with equal payloads the one with the largest id is a response and the others are revisits that refer to it, without
a payload.

Commit: tasks write under temporary names that no other attempt uses. The list of finished files is itself a table that
Spark commits, so of a repeated task one attempt's files are in it. They are then renamed, which can be repeated, and last
a manifest appears under its own name by a rename. Readers read only what the manifest names.

Scale: one shuffle of the payloads; digests, lengths and references are settled on narrow rows. A payload passes through a
task one at a time. Shard bounds are exact quantiles by bytes, from running sums over the sorted (id, digest) groups; there
are as many tasks as shards, and at most MOST_SHARDS bounds. Only ids are compared, never subtracted, so any 64-bit ids
will do, and one outlying id moves no bound. Rows that share id and payload and fill more than a shard (a third of all
pages without an id, say) are dealt over the shards they fill by chance: there alone which file holds which of the equal
records can differ between runs.

Defined results: null payloads are empty; pages without an id come last, are responses unless a page with an id has
their payload, and rows that repeat the id of a response are responses, under record ids of their own; a null url becomes a
URN of the page's id; an empty table gives an archive without files; other columns are left alone.
"""

import base64
import bisect
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadsift.llm.batches import bounded
from roadsift.llm.files import Store, moved, opened
from roadsift.llm.texts import utf8
from roadsift.session import shared_folder, written

DATE = "1970-01-01T00:00:00Z"
#: Compressed bytes at which a file is closed, payload bytes that a shard should hold, and the most shards; with more bytes
#: in all, shards are larger.
ROLL_BYTES = 32 << 20
SHARD_BYTES = 64 << 20
MOST_SHARDS = 65_536
LEVEL = 6
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, hashed: str, copy: str = "") -> str:
    """The id of the record of a page and payload digest; further rows with both alike are told apart by ``copy``."""
    return f"urn:x-page:{hashed}{copy and '/' + copy}:{'none' if page_id is None else page_id}"


def _page_id(name: str) -> int | None:
    number = name.strip("<>").rsplit(":", 1)[1]
    return None if number == "none" else int(number)


# Records


def record(page_id: int | None, url: str | None, payload: bytes, size: int, hashed: str, refers_to: int | None, copy: str = "") -> bytes:
    """One WARC record; a revisit, for which the payload is not needed, if it refers to another page."""
    revisit = refers_to is not None
    http = HTTP.format(size).encode()
    block = http if revisit else http + payload
    target = url if url else f"urn:x-page:{'none' if page_id is None else page_id}"
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{record_id(page_id, hashed, copy)}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target.replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha1:{hashed}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        *([("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{record_id(refers_to, hashed)}>")] if revisit else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in headers) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def compressed(data: bytes) -> bytes:
    """A gzip member without name or time."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def read_records(source: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive file."""
    rest = b""
    while True:
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            rest = rest or source.read(1 << 20)
            if not rest:
                if parts:
                    raise ValueError("the file ends inside a record")
                return
            parts.append(unpacker.decompress(rest))
            rest = unpacker.unused_data
        head, _, block = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"not a record: {lines[0][:40]}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        yield headers, block[: int(headers["Content-Length"])]


def described(headers: dict[str, str], block: bytes) -> tuple:
    """The row of a record, its digests checked."""
    if headers["WARC-Block-Digest"] != f"sha1:{digest(block)}":
        raise ValueError(f"{headers['WARC-Record-ID']}: the block does not match its digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    hashed = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = headers["WARC-Type"] == "revisit"
    if not revisit and (digest(payload) != hashed or len(payload) != size):
        raise ValueError(f"{headers['WARC-Record-ID']}: the payload does not match its digest")
    return _page_id(headers["WARC-Record-ID"]), size, hashed, headers["WARC-Type"], _page_id(headers["WARC-Refers-To"]) if revisit else None


# Writing


def _referenced(pages: DataFrame, least_bytes: int) -> DataFrame:
    """page_id, url, html (bytes; null for revisits), size, sha1 (hex), refers_to per row."""
    payload = utf8(pages["html"])
    rows = pages.select("page_id", "url", payload.alias("html"), F.length(payload).cast("long").alias("size"), F.sha1(payload).alias("sha1"))
    copied = rows.filter(F.col("size") >= least_bytes).groupBy("sha1", "size").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    copied = written(copied.filter("copies > 1").select("sha1", "size", "first"))
    refers = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    return rows.join(copied, ["sha1", "size"], "left").select("page_id", "url", F.when(refers.isNull(), F.col("html")).alias("html"), "size", "sha1", refers.alias("refers_to"))


class Bounds:
    """Where shards begin: for each group of rows alike in id and digest that a shard begins in, the shards that do.

    ``keys`` rise, as pairs of id (null last) and digest. A group that a shard begins within belongs to the shard before
    as well.
    """

    def __init__(self, rows: list[tuple[int | None, str, int, int, bool, bool]]):
        rows = sorted(rows, key=lambda row: self.key(row[0], row[1]))
        self.keys = [self.key(page_id, sha1) for page_id, sha1, *_ in rows]
        self.first = [first if exact else first - 1 for _, _, first, _, exact, _ in rows]
        self.last = [last for _, _, _, last, _, _ in rows]
        #: Where the group's own rows end: a single row is in the shard that it begins in.
        self.end = [last if several else first for first, last, (*_, several) in zip(self.first, self.last, rows)]
        self.shards = max(self.last, default=0) + 1
        #: The groups that go on in a shard from the one before.
        self.continued = {shard: key for key, first, end in zip(self.keys, self.first, self.end) for shard in range(first + 1, end + 1)}

    @staticmethod
    def key(page_id: int | None, sha1: str) -> tuple:
        return page_id is None, page_id or 0, sha1

    def shard(self, page_id: int | None, sha1: str, chance: float) -> int:
        key = self.key(page_id, sha1)
        at = bisect.bisect_right(self.keys, key) - 1
        if at < 0:
            return 0
        if self.keys[at] != key:
            return self.last[at]
        return self.first[at] + int(chance * (self.end[at] - self.first[at] + 1))


def _bounds(pages: DataFrame, shard_bytes: int) -> Bounds:
    """Quantiles by bytes of the groups of rows alike in id and digest."""
    payload = utf8(pages["html"])
    size = F.length(payload).cast("long") + F.lit(1)  # empty payloads count too
    groups = pages.select("page_id", F.sha1(payload).alias("sha1"), size.alias("size")).groupBy("page_id", "sha1").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    order = [F.asc_nulls_last("page_id"), F.asc("sha1")]
    stored = written(groups.repartitionByRange(*order).sortWithinPartitions(*order))
    rows = stored.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    sums = [(row["file"], row["bytes"]) for row in rows.groupBy("file").agg(F.sum("bytes").alias("bytes")).collect()]  # a row per file
    sums.sort(key=lambda each: [int(number) for number in re.findall(r"^part-(\d+)|-c(\d+)", each[0])[0] if number])
    step = max(shard_bytes, -(-sum(size for _, size in sums) // MOST_SHARDS))
    firsts = dict(zip((name for name, _ in sums), accumulate((size for _, size in sums), initial=0)))
    before = F.sum("bytes").over(Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    offset = pages.sparkSession.createDataFrame(list(firsts.items()) or [("", 0)], "file string, offset bigint")
    placed = rows.withColumn("start", F.coalesce(before, F.lit(0))).join(F.broadcast(offset), "file").withColumn("start", F.col("start") + F.col("offset"))
    first, last = F.ceil(F.col("start") / step), F.floor((F.col("start") + F.col("bytes") - 1) / step)
    begun = placed.select("page_id", "sha1", first.alias("first"), last.alias("last"), (F.col("start") % step == 0).alias("exact"), (F.col("n") > 1).alias("several")).filter("first <= last")
    return Bounds([tuple(row) for row in begun.collect()])  # at most MOST_SHARDS rows


def write_archive(pages: DataFrame, folder: str, least_bytes: int = 0, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES) -> str:
    """Writes the pages (page_id, url, html) below ``folder``, which all executors must reach; returns it.

    ``folder`` is a path or URL that pyarrow's file systems open. Payloads of fewer than ``least_bytes`` bytes are always
    written out.
    """
    spark = pages.sparkSession
    own = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), pages["html"].alias("html"))
    bounds = spark.sparkContext.broadcast(_bounds(own, shard_bytes))

    @F.pandas_udf("int")
    def shard_of(page_id: pd.Series, sha1: pd.Series, chance: pd.Series) -> pd.Series:
        known = page_id.notna()
        return pd.Series([bounds.value.shard(int(own) if there else None, hashed, at) for own, there, hashed, at in zip(page_id.fillna("0"), known, sha1, chance)], dtype="int32")

    # As text: a column of numbers with nulls would come as doubles, which round large ids.
    rows = _referenced(own, least_bytes).withColumn("shard", shard_of(F.col("page_id").cast("string"), F.col("sha1"), F.rand()))
    ordered = rows.repartitionById(bounds.value.shards, F.col("shard")).sortWithinPartitions("shard", F.asc_nulls_last("page_id"), "sha1", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(folder)
        attempt = f"{base}/temporary/{uuid.uuid4().hex}"
        shard, last, ordinal = None, None, 0
        with _Files(store, attempt, roll_bytes) as files:
            for batch in bounded(batches, "html"):
                for row in batch.to_pylist():
                    if row["shard"] != shard:
                        shard, ordinal = row["shard"], 0
                        last = bounds.value.continued.get(shard)
                    key = Bounds.key(row["page_id"], row["sha1"])
                    copy = f"{shard}-{ordinal}" if key == last else ""
                    last, ordinal = key, ordinal + 1
                    hashed = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
                    files.add(shard, row["page_id"], record(row["page_id"], row["url"], row["html"] or b"", row["size"], hashed, row["refers_to"], copy))
        yield pa.RecordBatch.from_pylist(files.finished, schema=_FILES)

    listed = f"{folder}/files"
    ordered.mapInArrow(write, "shard int, part int, name string, temporary string, records bigint, bytes bigint, sha1 string").write.parquet(listed)
    files = spark.read.parquet(listed)

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(folder)
        for batch in batches:
            for row in batch.to_pylist():
                moved(store, row["temporary"], f"{base}/{row['name']}")
            yield batch.select(["records", "bytes"])

    totals = files.select("temporary", "name", "records", "bytes").mapInArrow(rename, "records bigint, bytes bigint").agg(F.count(F.lit(1)), F.sum("records"), F.sum("bytes")).first()
    store, base = opened(folder)
    with store.writer(f"{base}/temporary-manifest.json") as out:
        out.write(json.dumps({"files": totals[0], "records": totals[1] or 0, "bytes": totals[2] or 0, "list": "files"}).encode())
    moved(store, f"{base}/temporary-manifest.json", f"{base}/manifest.json")
    store.delete_dir(f"{base}/temporary")  # what broken attempts have left
    return folder


_FILES = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("name", pa.string()), ("temporary", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())])


class _Files:
    """The files of one task's attempt, rolled by compressed size."""

    def __init__(self, store: Store, folder: str, roll_bytes: int):
        self.store, self.folder, self.roll_bytes = store, folder, roll_bytes
        self.finished: list[dict] = []
        self.out = None
        self.shard = None

    def __enter__(self) -> "_Files":
        self.store.create_dir(self.folder)
        return self

    def add(self, shard: int, page_id: int | None, data: bytes) -> None:
        if self.out is not None and (shard != self.shard or self.row["bytes"] >= self.roll_bytes):
            self._close()
        if self.out is None:
            part = self.row["part"] + 1 if shard == self.shard else 0
            self.shard = shard
            name = f"pages-{shard:06d}-{part:05d}.warc.gz"
            self.row = {"shard": shard, "part": part, "name": name, "temporary": f"{self.folder}/{name}", "records": 0, "bytes": 0}
            self.hashed = hashlib.sha1()
            self.out = self.store.writer(self.row["temporary"])
        packed = compressed(data)
        self.out.write(packed)
        self.hashed.update(packed)
        self.row["records"] += 1
        self.row["bytes"] += len(packed)

    def _close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.finished.append({**self.row, "sha1": self.hashed.hexdigest()})
            self.out = None

    def __exit__(self, *failure) -> None:
        self._close()


# Reading


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record of a finished archive: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    store, base = opened(folder)
    with store.reader(f"{base}/manifest.json") as source:
        manifest = json.loads(source.read())
    files = spark.read.parquet(f"{folder}/{manifest['list']}").select("name", "sha1")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(folder)
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for name in batch.column("name").to_pylist():
                with store.reader(f"{base}/{name}") as source:
                    rows: list[tuple] = []
                    for found in read_records(source):
                        rows.append(described(*found))
                        if len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names=names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names=names)

    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.select("name").repartition(spread).mapInArrow(read, RECORD)


def round_trip(pages: DataFrame, least_bytes: int = 0, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the pages to a new archive in the shared folder and reads it back."""
    spark = pages.sparkSession
    return read_archive(spark, write_archive(pages, shared_folder(spark), least_bytes, roll_bytes, shard_bytes))
