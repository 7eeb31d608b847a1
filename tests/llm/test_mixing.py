import random

import pytest
from pyspark.sql import functions as F

from roadsift.llm import mixing


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    """Shares by weight; what is above a cap goes round again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {source: weights[at % len(weights)] for at, source in enumerate(order)}
    target, open_ones, left = {}, set(order), sum(sizes.values())
    while open_ones:
        share = {s: left * weight[s] / sum(weight[o] for o in open_ones) for s in open_ones}
        over = {s for s in open_ones if share[s] >= most * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
        open_ones -= over
        left = sum(sizes.values()) - sum(target.values())
    return target


@pytest.mark.parametrize("seed", range(3))
def test_targets_equal_sharing_in_rounds(spark, seed):
    draw = random.Random(seed)
    sizes = {None if at == 0 else f"s{at:02d}é": int(10 ** draw.uniform(0, 5)) * draw.randint(0, 3) for at in range(9)}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    want = plain_targets(sizes)
    for row in mixing.targets(frame).collect():
        assert row["target"] == pytest.approx(want[row["source"]], abs=1e-6)


@pytest.fixture
def many(make_docs):
    draw = random.Random(8)
    names = ["a", "b", None, "d"]
    return make_docs(*((at, " ".join(["w"] * int(10 ** draw.uniform(0, 2.5))), draw.choices(names, [60, 5, 10, 25])[0]) for at in range(1500)))


def test_taken_words_come_near_the_targets(many):
    rows = mixing.decisions(many).collect()
    assert len(rows) == 1500
    for source_size in {row["source_size"] for row in rows}:
        own = [row for row in rows if row["source_size"] == source_size]
        # The sample ends within half a document of the target.
        assert abs(sum(row["taken"] for row in own) - own[0]["target"]) <= max(row["size"] for row in own) / 2 + 1e-6
    assert all(row["taken"] in (0, row["size"], 2 * row["size"], 3 * row["size"]) for row in rows)


def test_reruns_agree_and_the_rows_match_the_decisions(many):
    first, again = (sorted(map(tuple, mixing.decisions(many.repartition(n)).collect())) for n in (2, 5))
    assert first == again
    copies = {row["doc_id"]: row["count"] for row in mixing.mixed(many).groupBy("doc_id").count().collect()}
    assert copies == {row[0]: row[4] // row[1] for row in first if row[4]}
    assert mixing.mixed(many).schema == many.schema


def test_other_seeds_draw_other_documents(many):
    one, two = ({row["doc_id"] for row in mixing.decisions(many, seed=seed).filter("taken > 0").collect()} for seed in (1, 2))
    assert one != two


def test_values_shift_the_draw(many):
    valued = many.withColumn("value", F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0))
    rows = mixing.decisions(valued, value="value").collect()
    even, odd = (sum(row["taken"] for row in rows if row["doc_id"] % 2 == at) / sum(row["size"] for row in rows if row["doc_id"] % 2 == at) for at in (0, 1))
    assert even > 1.8 * odd


def test_odd_rows(odd_docs, no_docs):
    rows = mixing.decisions(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(row["size"] == 0 and row["taken"] == 0 for row in rows if row["doc_id"] in (3, 4, 5))
    assert mixing.decisions(no_docs).collect() == [] and mixing.mixed(no_docs).collect() == []
