"""Packing and mixing."""

import random

import pytest

from codelode.llm import mixing, packing, sizes
from codelode.session import cut

DOCS = "doc_id long, text string, source string, tokens string, weight int"


def test_every_token_is_packed_once_and_little_is_unused(spark):
    rng = random.Random(2)
    data = [(i, rng.choice([rng.randrange(1, 300), rng.randrange(1, 2049), rng.randrange(1, 9000)])) for i in range(1500)] + [(9001, 2048), (9002, 4096), (9003, 0), (9004, None), (None, 7)]
    df = spark.createDataFrame([(a, b, "x") for a, b in data], "doc_id long, tokens long, container string")
    got = [r.asDict() for r in packing.pack(df).collect()]
    by_doc, by_container = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_container[r["container"]] = by_container.get(r["container"], 0) + r["tokens"]
    assert set(by_doc) == {a for a, b in data if a is not None and b}
    for a, b in data:
        if a is not None and b:
            parts = sorted(by_doc[a], key=lambda r: r["first_token"])
            assert [r["first_token"] for r in parts] == [i * 2048 for i in range(len(parts))] and sum(r["tokens"] for r in parts) == b
            assert len(parts) == -(-b // 2048)
    assert max(by_container.values()) <= 2048
    report = packing.fill_report(packing.pack(df)).first()
    assert report["unused_share"] < 0.01 and report["containers"] - report["least_containers"] <= 3


def test_small_windows_fill_exactly():
    taken = list(packing.fill({7: 1, 5: 2, 3: 1, 2: 2}, 12))
    assert [sum(n * k for n, k in t.items()) for t in taken] == [12, 12]
    assert list(packing.fill({}, 10)) == [] and list(packing.fill({10: 3}, 10)) == [{10: 1}] * 3
    assert sum(sum(n * k for n, k in t.items()) for t in packing.fill({1: 10_000}, 2048)) == 10_000


def test_packing_of_nothing(spark, collect):
    empty = spark.createDataFrame([], "doc_id long, tokens long")
    assert collect(packing.pack(empty)) == []
    assert packing.fill_report(packing.pack(empty)).first()["containers"] == 0


def test_sizes_cover_nulls_empty_and_long_texts(spark, collect):
    data = [(1, "hello world", "a", "", 0), (2, None, "a", "", 0), (3, "", None, "", 0), (4, "word " * 50_000, "b", "", 0), (1, "hello world", "a", "", 0), (None, "x", "a", "", 0)]
    got = {r[0]: r[2] for r in collect(sizes.token_sizes(spark.createDataFrame(data, DOCS)))}
    assert got[1] == 2 and got[2] == 0 and got[3] == 0 and got[4] >= 50_000 and set(got) == {1, 2, 3, 4}


@pytest.fixture(scope="module")
def sized(spark):
    rng = random.Random(4)
    data = [(i, s, rng.randrange(1, 60), rng.random()) for s, base, n in (("big", 0, 3000), ("mid", 10_000, 800), ("small", 20_000, 60), ("other", 30_000, 50)) for i in range(base, base + n)]
    return cut(spark.createDataFrame([*data, (40_000, "big", 0, 0.0), (40_001, None, 5, 0.5)], "doc_id long, source string, tokens long, weight double"), "sized")


def test_shares_are_met_within_the_repeats(spark, sized):
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4), ("absent", 0.4, 1), ("big", 0.5, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(sized, targets)
    rows = mixed.collect()
    limit = {"big": 1, "mid": 2, "small": 4}
    assert {r["source"] for r in rows} == set(limit) and all(1 <= r["repeats"] <= limit[r["source"]] for r in rows)
    total = sum(r["tokens"] * r["repeats"] for r in rows)
    for source, share in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert abs(sum(r["tokens"] * r["repeats"] for r in rows if r["source"] == source) / total - share) < 0.01
    assert len({r["doc_id"] for r in rows}) == len(rows)
    small = [r["repeats"] for r in rows if r["source"] == "small"]
    assert min(small) == max(small) == 4  # complete epochs of the source that limits the mixture
    report = {r["source"]: r for r in mixing.mix_report(mixed, targets).collect()}
    assert report["absent"]["texts"] == 0 and abs(report["big"]["share"] - 0.5) < 0.01


def test_partial_epochs_follow_complete_ones(spark, sized):
    targets = spark.createDataFrame([("small", 1.0, 4)], "source string, target_share double, max_repeats int")
    size = sum(r["tokens"] for r in sized.where("source = 'small'").collect())
    repeats = [r["repeats"] for r in mixing.mix(sized, targets, total=int(2.5 * size)).collect()]
    assert set(repeats) == {2, 3} and len(repeats) == 60
    again = mixing.mix(sized, targets, total=int(2.5 * size), buckets=7)
    assert sorted(r["doc_id"] for r in again.where("repeats = 3").collect()) == sorted(r["doc_id"] for r in mixing.mix(sized, targets, total=int(2.5 * size)).where("repeats = 3").collect())


def test_weights_favour_what_is_better(spark):
    data = [(i, "s", 1, 1.0 if i % 2 else 0.05) for i in range(4000)]
    df = cut(spark.createDataFrame(data, "doc_id long, source string, tokens long, weight double"), "w")
    got = mixing.mix(df, spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int"), total=1000).collect()
    assert abs(len(got) - 1000) <= 1 and sum(r["doc_id"] % 2 for r in got) > 900


def test_mixing_of_nothing(spark, collect):
    empty = spark.createDataFrame([], "doc_id long, source string, tokens long, weight double")
    targets = spark.createDataFrame([("s", 1.0, None)], "source string, target_share double, max_repeats int")
    assert collect(mixing.mix(empty, targets)) == [] and collect(mixing.mix(empty, targets.where("false"))) == []
