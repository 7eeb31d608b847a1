import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from roadsift.operators import kmeans, themes
from roadsift.plans import runs
from roadsift.session import shared_folder
from roadsift.sources import tables


def blobs(groups=4, each=15, size=8, seed=1):
    draw = np.random.default_rng(seed)
    centers = np.eye(size)[:groups] * 5
    return [(g * each + i, (centers[g] + draw.normal(0, 0.1, size)).tolist()) for g in range(groups) for i in range(each)]


@pytest.fixture
def vectors(spark):
    return themes.unit_vectors(spark.createDataFrame(blobs(), "id long, features array<double>"))


def test_unit_vectors_have_length_one_and_drop_zero(spark):
    frame = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id long, features array<double>")
    rows = themes.unit_vectors(frame).select("id", vector_to_array("features").alias("v")).collect()
    assert [(r.id, r.v) for r in rows] == [(1, [0.6, 0.8])]


def test_clusters_find_the_groups_and_repeat(vectors):
    first = {r.id: r.cluster for r in themes.cluster(vectors, seeds=range(42, 45)).collect()}
    again = {r.id: r.cluster for r in themes.cluster(vectors.repartition(7), seeds=range(42, 45)).collect()}
    assert first == again and len(first) == 60
    assert [len({first[g * 15 + i] for i in range(15)}) for g in range(4)] == [1] * 4 and len(set(first.values())) == 4


def test_any_layout_gives_the_same_bits(spark):
    frame = spark.createDataFrame(blobs(5, 40, 16, 3), "id long, features array<double>")
    unit = themes.unit_vectors(frame.union(frame.selectExpr("id + 1000", "features")))  # every vector twice
    models = []
    for layout in (unit, unit.repartition(7), unit.coalesce(1), unit.orderBy(F.desc("id"))):
        flat = layout.select("id", vector_to_array("features").alias("features"))
        models.append(kmeans.fit(flat, 6, [42, 43, 44]))
    first = models[0]
    assert all(np.array_equal(model.centers, first.centers) and (model.cost, model.seed) == (first.cost, first.seed) for model in models)


def test_starts_are_distinct_points_far_apart(spark):
    flat = spark.createDataFrame([(i, [float(i // 10), 0.0]) for i in range(40)], "id long, features array<double>")
    for centers in kmeans.starting_centers(flat, 4, [1, 2, 3]).values():
        assert sorted(centers[:, 0] / kmeans.GRID) == [0.0, 1.0, 2.0, 3.0]
    assert len(kmeans.starting_centers(flat, 9, [1])[1]) == 4  # no more points than these
    many = spark.createDataFrame([(i, [i / 200, 1.0]) for i in range(200)], "id long, features array<double>")
    assert {len(centers) for centers in kmeans.starting_centers(many, 50, [1, 2]).values()} == {50}
    with pytest.raises(ValueError):
        kmeans.fit(spark.createDataFrame([(1, [5.0])], "id long, features array<double>"), 1, [1])


def test_draws_are_even_and_differ_by_seed():
    ids = np.arange(20_000)
    one, other = kmeans.drawn(ids, 42, 0), kmeans.drawn(ids, 43, 0)
    assert abs(one.mean() - 0.5) < 0.01 and abs(np.corrcoef(one, other)[0, 1]) < 0.03 and 0 < one.min() and one.max() < 1


def test_packed_vectors_hold_the_grid_of_sparse_and_dense_ones(spark):
    rows = [(1, Vectors.sparse(3, [0, 2], [0.5, -0.25])), (2, Vectors.dense([0.5, 0.0, -0.25])), (3, Vectors.sparse(3, [], []))]
    ml = spark.createDataFrame(rows, ["id", "features"])
    flat = ml.select("id", vector_to_array("features").alias("features"))
    for frame in (ml, flat, flat.limit(0)):
        found = {r.id: (r.squared, np.frombuffer(r.point, "<i4").tolist()) for r in kmeans.packed(frame).collect()}
        half = [kmeans.GRID // 2, 0, -kmeans.GRID // 4]
        assert found == ({} if frame.isEmpty() else {1: (0.3125, half), 2: (0.3125, half), 3: (0.0, [0, 0, 0])})
    models = [kmeans.fit(frame, 2, [42]) for frame in (kmeans.packed(ml), flat)]
    assert models[0].cost == models[1].cost == 0


def test_texts_are_taken_apart_once(spark, make_items):
    vectors = themes.word_vectors(make_items({"body": "an item"}, {"body": "---"}))
    assert "split(" not in vectors._jdf.queryExecution().toString()


def test_best_start_is_kept(vectors):
    def cost(frame):
        rows = frame.select("cluster", vector_to_array("features").alias("v")).collect()
        groups = {}
        for row in rows:
            groups.setdefault(row.cluster, []).append(row.v)
        return sum(((np.array(g) - np.mean(g, axis=0)) ** 2).sum() for g in groups.values())

    seeds = range(42, 46)
    best = cost(themes.cluster(vectors, k=6, seeds=seeds))
    assert best <= min(cost(themes.cluster(vectors, k=6, seeds=[seed])) for seed in seeds) + 1e-9


def test_k_never_exceeds_the_items(spark):
    few = themes.unit_vectors(spark.createDataFrame(blobs(3, 1), "id long, features array<double>"))
    assert len({r.cluster for r in themes.cluster(few, seeds=[42]).collect()}) == 3


def test_small_clusters_lose_their_items(spark):
    rows = blobs(2, 20) + [(99, [0.0] * 7 + [9.0])]
    frame = themes.unit_vectors(spark.createDataFrame(rows, "id long, features array<double>"))
    ids = {r.id for r in themes.cluster(frame, k=3, seeds=range(3), min_size=5).collect()}
    assert ids == set(range(40))


def test_silhouette_and_nearest_centroid(spark, vectors):
    clustered = themes.cluster(vectors, seeds=[42])
    assert themes.silhouette(clustered) > 0.9
    flat = clustered.select("id", F.col("cluster").alias("theme_id"), vector_to_array("features").alias("features"))
    near = {r.id: r.theme_id for r in themes.nearest_centroid(flat, themes.centroids(flat)).collect()}
    assert near == {r.id: r.theme_id for r in flat.collect()}


def test_centers_in_blocks_give_the_same(spark, vectors, monkeypatch):
    flat = vectors.select("id", vector_to_array("features").alias("features"))
    centers = flat.select(F.col("id").alias("theme_id"), F.col("features").alias("centroid")).filter("id % 3 = 0")
    whole = {tuple(r) for r in themes.nearest_centroid(flat, centers).collect()}
    monkeypatch.setattr(themes, "BLOCK_BYTES", 8 * 8 * 4)
    assert {tuple(r) for r in themes.nearest_centroid(flat, centers).collect()} == whole
    assert themes.nearest_centroid(flat, centers.limit(0)).collect() == []


@pytest.mark.parametrize("count", [0, 1, 2])
def test_runs_over_very_few_items(spark, make_items, count):
    directory = shared_folder(spark)
    bodies = ["an item about crashes", "кириллица и ничего больше"][:count]
    tables.append(make_items(*[{"body": body} for body in bodies]), directory, "items")
    runs.label_new(spark, directory, lambda prompts: [('{"type": "bug"}', None) for _ in prompts])
    runs.build_themes(spark, directory)
    current = tables.read_current(spark, directory).collect()
    assert len(current) == count and all(r.theme_id is not None for r in current)
    assert tables.read_table(spark, directory, "themes").count() == count


def test_a_text_is_asked_once_over_all_slices(spark, make_items, tmp_path):
    directory, log = shared_folder(spark), str(tmp_path / "asked")
    tables.append(make_items(*[{"body": f"one of five texts, number {at % 5}"} for at in range(40)]), directory, "items")

    def answer(prompts):
        with open(log, "a") as file:
            file.write("x\n" * len(prompts))
        return [('{"type": "bug"}', None) for _ in prompts]

    runs.label_new(spark, directory, answer, slices=4)
    with open(log) as file:
        assert len(file.readlines()) == 5
    assert tables.read_current(spark, directory).filter("status = 'classified'").count() == 40


def test_area_mode_prefers_first_seen(make_items):
    items = make_items(*[{"theme_id": 1, "product_area": a} for a in "BAAB"], {"theme_id": 2}, {"theme_id": 2, "product_area": ""}, {"theme_id": 2, "product_area": "ui/ux"})
    assert {r.theme_id: r.area for r in themes.top_areas(items).collect()} == {1: "B", 2: "general"}


def test_names(spark, make_items):
    items = make_items(*[{"theme_id": t, "product_area": "ui/ux"} for t in (1, 2, 3, 4)])
    replies = spark.createDataFrame(
        [(1, 'ok {"name": "' + "n" * 70 + '", "summary": "s"}'), (2, "no"), (3, "{}")], "theme_id long, reply string"
    )
    rows = {r.id: (r.name, r.summary) for r in themes.name_themes(items, replies).collect()}
    assert rows[1] == ("n" * 60, "s") and rows[3] == ("Unnamed", "")
    assert rows[2] == rows[4] == ("Ui/Ux issues", themes.FALLBACK_SUMMARY)


def test_samples(make_items):
    items = make_items(*[{"theme_id": 1, "body": f"{at:03d}" + "x" * 200} for at in range(20)])
    lines = themes.theme_samples(items).first().sample.splitlines()
    assert len(lines) == 12 and lines[0] == "- 000" + "x" * 157 and lines[11].startswith("- 011")


def test_theme_run_with_an_embedder_embeds_each_text_once(spark, make_items, tmp_path):
    directory, log = shared_folder(spark), str(tmp_path / "embedded")
    words = ["crash", "slow", "price", "sync"]
    bodies = [f"{words[at % 4]} trouble number {at // 8}" for at in range(40)]
    tables.append(make_items(*[{"body": b} for b in bodies]), directory, "items")
    runs.label_new(spark, directory, lambda prompts: [('{"type": "bug", "area": "mobile app"}', None) for _ in prompts])

    def embed(texts):
        with open(log, "a") as file:
            file.write("".join(f"{t}\n" for t in texts))
        return [[float(t.startswith(w)) for w in words] for t in texts]

    def name(prompts):
        return prompts.select("theme_id", F.lit('{"name": "Named", "summary": "S"}').alias("reply"))

    for run in (1, 2):
        assert runs.build_themes(spark, directory, embed, k=4, name=name if run == 2 else None, slices=2) == run
        assert runs.score_themes(spark, directory) == run
    with open(log) as file:
        embedded = file.read().splitlines()
    assert sorted(embedded) == sorted(set(bodies))
    current = tables.read_current(spark, directory)
    sizes = sorted(r["count"] for r in current.groupBy("theme_id").count().collect())
    assert sizes == [10, 10, 10, 10]
    stored = tables.read_table(spark, directory, "themes").collect()
    assert len({r.id for r in stored}) == 8 and {r.name for r in stored} == {"Mobile App issues", "Named"}
    scores = tables.newest_run(tables.read_table(spark, directory, "opportunities"))
    assert scores.count() == 4 and {r.reach for r in scores.collect()} == {10}


def test_word_vectors_read_whole_texts(spark, make_items):
    padding = "filler " * 5000
    items = make_items({"body": padding + "apple"}, {"body": padding + "pear"}, {"body": "---"}, {"body": ""}, {"body": "漢字"})
    rows = sorted(themes.word_vectors(items).collect(), key=lambda r: r.id)
    assert [r.id for r in rows] == [1, 2, 3, 5] and rows[0].features != rows[1].features
