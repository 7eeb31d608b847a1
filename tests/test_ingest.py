import random

import pytest
from pyspark.sql import functions as F

from roadsift.operators import ingest, key_filter
from roadsift.plans import runs
from roadsift.session import shared_folder, written
from roadsift.sources import feedback_csv, golden, key_filters, quoted_csv, reviews, tables

BATCH = "id long, source string, external_id string, body string"


def test_null_keys_never_collide(spark):
    incoming = spark.createDataFrame(
        [(1, "csv", None, "x"), (2, "csv", None, "x"), (3, "csv", "a", "x"), (4, "csv", "b", "x"), (5, "csv", "b", "y"), (6, None, "c", "x"), (7, "csv", "d", None)],
        BATCH,
    )
    stored = spark.createDataFrame([("csv", "a"), (None, None)], "source string, external_id string")
    kept = ingest.dedup_new(incoming, stored, [F.col("id")]).collect()
    assert sorted(row.id for row in kept) == [1, 2, 4]


def test_stored_hits_agree_on_both_paths(spark):
    incoming = spark.createDataFrame([(i, "csv", f"k{i % 7}", "x") for i in range(50)], BATCH)
    stored = spark.createDataFrame([("csv", f"k{i}") for i in range(4, 40)], "source string, external_id string")
    whole = ingest.dedup_new(incoming, ingest.stored_hits(stored, incoming, 50, limit=10), [F.col("id")])
    small = ingest.dedup_new(incoming, ingest.stored_hits(stored, incoming, 50), [F.col("id")])
    assert sorted(r.external_id for r in whole.collect()) == sorted(r.external_id for r in small.collect()) == ["k0", "k1", "k2", "k3"]


def test_short_bodies_are_dropped(spark):
    bodies = ["x" * 20, "x" * 19, "\t\n " + "y" * 19 + " \n", " " + "z" * 20, None, ""]
    kept = ingest.filter_usable(spark.createDataFrame([(b,) for b in bodies], "body string")).collect()
    assert [row.body for row in kept] == ["x" * 20, " " + "z" * 20]


def test_counts(spark):
    frames = [spark.range(n) for n in (5, 3, 0)]
    row = ingest.ingest_counts(*frames).first()
    assert (row.incoming, row.usable, row.inserted) == (5, 3, 0)


def test_csv(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text(
        'body,rating,author,created_at\n'
        '"line one\nline ""two"" of a text",4.7,,2024-05-01\n'
        'NA,3,bob,\n'
        ',1,bob,\n'
        '"  a text that is long enough  ",NA,null,not a date\n',
        encoding="utf-8",
    )
    rows = feedback_csv.read_feedback_csv(spark, str(path)).orderBy("ingest_order").collect()
    assert [r.body for r in rows] == ['line one\nline "two" of a text', None, None, "a text that is long enough"]
    assert [r.rating for r in rows] == [4, 3, 1, None]
    assert [r.author for r in rows] == ["anonymous", "bob", "bob", "anonymous"]
    assert str(rows[0].created_at) == "2024-05-01 00:00:00" and rows[3].created_at is None
    assert rows[0].external_id.startswith("csv-") and rows[0].external_id != rows[3].external_id


def test_csv_keeps_given_ids_but_not_blank_ones(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("body,external_id\nsome text of mine,T-1\nsome text of yours, \n")
    rows = feedback_csv.read_feedback_csv(spark, str(path)).orderBy("ingest_order").collect()
    assert rows[0].external_id == "T-1" and rows[1].external_id.startswith("csv-")


def test_csv_without_body_names_its_columns(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("text,rating\nhello,3\n")
    with pytest.raises(ValueError, match="text.*rating"):
        feedback_csv.read_feedback_csv(spark, str(path))


def test_csv_order_is_file_order(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("body\n" + "\n".join(f"this is row number {i:06d}" for i in range(50000)))
    for multi_line in (True, False):
        rows = feedback_csv.read_feedback_csv(spark, str(path), multi_line=multi_line).orderBy("ingest_order").select("body").collect()
        assert [r.body for r in rows] == [f"this is row number {i:06d}" for i in range(50000)]


def test_reviews(spark):
    raw = spark.createDataFrame(
        [("r1", "", " good app, really good ", 5, "2024-01-01T10:00:00"), ("r2", "bob", None, None, None)],
        "reviewId string, userName string, content string, score int, at string",
    )
    one, two = reviews.normalize_reviews(raw).orderBy("external_id").collect()
    assert (one.source, one.author, one.body, one.rating) == ("play_store", "anonymous", "good app, really good", 5)
    assert (two.author, two.body, two.rating, two.created_at) == ("bob", "", None, None)


def test_golden_round_trip(spark, tmp_path):
    rows = [("1", 'says "no", twice\nand leaves', "bug", "3", None, None), ("2", " padded ", None, None, None, None)]
    frame = spark.createDataFrame(rows, "id string, body string, gold_type string, gold_severity string, gold_sentiment string, gold_notes string")
    golden.write_golden(frame, str(tmp_path / "g"))
    back = golden.read_golden(spark, str(tmp_path / "g")).orderBy("id").collect()
    assert [tuple(r) for r in back] == rows


def test_import_in_any_order_and_split_ends_the_same(spark):
    """Shuffled, split and repeated batches store every key once; ids are unique and rise in arrival order."""
    draw = random.Random(3)
    rows = [(i, f"s{i % 3}", f"k{draw.randint(0, 40)}", f"a body that is long enough, number {i}") for i in range(120)]
    want = sorted({(r[1], r[2]) for r in rows})
    normalized = ", ".join(["arrival long", "source string", "external_id string", "body string", "author string", "rating int", "created_at timestamp"])
    for attempt in range(2):
        directory = shared_folder(spark)
        mixed = draw.sample(rows, len(rows))
        inserted = 0
        for batch in (mixed[:50], mixed[30:], mixed):
            frame = spark.createDataFrame([(*r, "ann", 1, None) for r in batch], normalized)
            inserted += runs.import_feedback(spark, directory, frame, [F.col("arrival")], ids_in_order=not attempt)[0]
        stored = tables.read_table(spark, directory, "items").collect()
        assert sorted((r.source, r.external_id) for r in stored) == want
        assert inserted == len(stored) == len({r.id for r in stored})


def test_first_copy_wins_and_ids_follow_arrival(spark):
    directory = shared_folder(spark)
    rows = [(i, "s", f"k{i % 5}", f"a body that is long enough, number {i}", "ann", 1, None) for i in range(20)]
    frame = spark.createDataFrame(rows[::-1], "arrival long, source string, external_id string, body string, author string, rating int, created_at timestamp")
    assert runs.import_feedback(spark, directory, frame.repartition(3), [F.col("arrival")]) == (5, 1)
    assert runs.import_feedback(spark, directory, frame, [F.col("arrival")], ids_in_order=False)[0] == 0
    stored = tables.read_table(spark, directory, "items").orderBy("id").collect()
    assert [r.body[-1] for r in stored] == ["0", "1", "2", "3", "4"]


NORMALIZED = "arrival long, source string, external_id string, body string, author string, rating int, created_at timestamp"


def batch_of(spark, keys, start=0):
    return spark.createDataFrame([(start + at, "s", key, f"a body that is long enough, number {at}", "ann", 1, None) for at, key in enumerate(keys)], NORMALIZED)


def test_filters_hold_every_key_and_few_others(spark):
    keys = spark.range(20_000).selectExpr("concat('s', id % 3) AS source", "cast(id AS string) AS external_id")
    others = keys.selectExpr("source", "concat('x', external_id) AS external_id")
    blocks = key_filter.blocks_for(20_000)
    filters = key_filter.filter_blocks(keys, blocks).withColumn("filter", F.lit("f")).persist()
    assert key_filter.possible_hits(keys, filters, [("f", blocks)]).count() == 20_000
    assert key_filter.possible_hits(others, filters, [("f", blocks)]).count() < 40


def test_an_import_of_new_keys_reads_no_stored_key(spark, monkeypatch):
    directory = shared_folder(spark)
    runs.import_feedback(spark, directory, batch_of(spark, [f"a{at}" for at in range(50)]), [F.col("arrival")])
    keys = spark.createDataFrame([("s", f"b{at}") for at in range(50)], "source string, external_id string")
    assert key_filters.known_keys(spark, directory, keys) is None
    read = []
    whole = key_filters._keys_of
    monkeypatch.setattr(key_filters, "_keys_of", lambda spark, directory, imports: read.append(imports) or whole(spark, directory, imports))
    runs.import_feedback(spark, directory, batch_of(spark, [f"b{at}" for at in range(50)]), [F.col("arrival")])
    assert read == [{2}]  # its own, for its filter
    read.clear()
    assert runs.import_feedback(spark, directory, batch_of(spark, ["b3", "c1"]), [F.col("arrival")])[0] == 1
    assert read == [{2}, {3}]  # the import that holds b3, and its own


def test_filters_merge_by_levels_and_nothing_is_stored_twice(spark, monkeypatch):
    monkeypatch.setattr(key_filters, "LEVEL", 2)
    directory = shared_folder(spark)
    for at in range(5):
        runs.import_feedback(spark, directory, batch_of(spark, [f"k{n}" for n in range(3 * at, 3 * at + 5)]), [F.col("arrival")])
    live = key_filters.live_filters(spark, directory)
    assert sorted(each.level for each in live) == [0, 2] and set().union(*(each.imports for each in live)) == {1, 2, 3, 4, 5}
    assert sorted(r.external_id for r in tables.read_table(spark, directory, "items").collect()) == sorted(f"k{n}" for n in range(17))


def test_imports_without_a_filter_are_read(spark, monkeypatch):
    directory = shared_folder(spark)

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(runs, "extend", broken)
        with pytest.raises(RuntimeError):
            runs.import_feedback(spark, directory, batch_of(spark, ["a", "b"]), [F.col("arrival")])
    assert key_filters.live_filters(spark, directory) == []
    assert runs.import_feedback(spark, directory, batch_of(spark, ["b", "c", None, None]), [F.col("arrival")]) == (3, 2)
    assert runs.import_feedback(spark, directory, batch_of(spark, ["a", "c"]), [F.col("arrival")])[0] == 0


def test_ids_have_no_gaps_over_many_partitions(spark, monkeypatch):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        directory = shared_folder(spark)
        rows = batch_of(spark, [f"k{at}" for at in range(400)])
        runs.import_feedback(spark, directory, rows.orderBy(F.rand(1)), [F.col("arrival")])
        stored = tables.read_table(spark, directory, "items").orderBy("id").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [(r.id, r.external_id) for r in stored] == [(at, f"k{at}") for at in range(400)]
    chosen = spark.range(0, 20_000, 1, 10_000).selectExpr("id AS place", "'f' AS file", "id AS row")
    largest = ingest.with_item_ids(chosen, (1 << 62), ordered=False).agg(F.max("id"), F.countDistinct("id")).first()
    assert tuple(largest) == ((1 << 62) + 19_999, 20_000)


def test_bodies_are_not_sorted(spark):
    batch = written(batch_of(spark, [f"k{at}" for at in range(50)]).withColumn("place", F.struct("arrival")))
    rows = ingest.numbered_rows(batch, ingest.with_item_ids(ingest.arrivals(batch, None), 0))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    sorts = [line for line in plan.splitlines() if "Sort [" in line and "_w" not in line]  # the files' sizes are added up in order
    assert sorts == [] and "SortMergeJoin" not in plan


def test_one_quoted_file_is_read_by_many_tasks(spark, tmp_path):
    draw = random.Random(4)
    pieces = ["word ", "\n", "\r\n", '""', ",", "é", " " * 30, "x" * 90]
    with open(tmp_path / "in.csv", "w", encoding="utf-8", newline="") as out:
        out.write("body,author,rating\n")
        for at in range(200):
            body = "".join(draw.choices(pieces, k=draw.randint(0, 40)))
            out.write(f'"{at} {body}",{draw.choice(["ann", "", chr(34) + "b,c" + chr(10) + "d" + chr(34)])},{at}' + draw.choice(["\n", "\n", "\n\n"]))
        out.write('"the last one goes over\nmany lines' + "\n and more" * 400 + '",x,1')
    want = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(str(tmp_path / "in.csv"))
    want = sorted(map(str, want.select("body", "author", "rating").collect()))
    for size in ("800", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            read = quoted_csv.read_quoted_csv(spark, str(tmp_path / "in.csv"))
            rows = read.orderBy("ingest_order").collect()
            blocks = {row.ingest_order.block for row in rows}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert sorted(str(row)[: -len(f", ingest_order={row.ingest_order!r})")] + ")" for row in rows) == want
        assert [int(row.body.split()[0]) for row in rows[:-1]] == list(range(200))
        assert len(blocks) > {"800": 30, "128m": 0}[size]


def test_files_with_other_headers_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("body,author\nsome text,ann\n")
    (tmp_path / "b.csv").write_text("author,body\nann,some text\n")
    with pytest.raises(Exception, match="begins with"):
        quoted_csv.read_quoted_csv(spark, str(tmp_path)).collect()


def test_states_at_the_starts_of_splits():
    splits = [("a", 0, True), ("a", 10, False), ("a", 20, True), ("a", 30, False), ("b", 0, False), ("b", 10, True), ("c", 0, False)]
    assert quoted_csv.inside_quotes(splits[::-1]) == {("a", 10), ("a", 20)}
