"""Ranking, components, shared spans and near duplicates against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest

from codelode.llm import balls, components, fmindex, spans, streams, topn
from codelode.session import cut

TOKENS = "file_id long, unit int, line int, text string, repo string, hashes string, key string"


def token_rows(files):
    return [(f, u, u // 5 + 1, t, "r", "x", "y") for f, ts in files.items() for u, t in enumerate(ts)]


def brute_spans(files, width):
    owner, many = {}, set()
    for f, ts in files.items():
        for i in range(len(ts) - width + 1):
            k = tuple(ts[i : i + width])
            if owner.setdefault(k, f) != f:
                many.add(k)
    out = []
    for f, ts in files.items():
        hit = [False] * len(ts)
        for i in range(len(ts) - width + 1):
            if tuple(ts[i : i + width]) in many:
                hit[i : i + width] = [True] * width
        i = 0
        while i < len(ts):
            j = i
            while j < len(ts) and hit[j]:
                j += 1
            if j > i:
                out.append((f, i, j - 1))
            i = max(j, i + 1)
    return sorted(out, key=repr)


def random_files(seed, n=14, vocabulary=12):
    rng = random.Random(seed)
    word = lambda: f"t{rng.randrange(vocabulary)}"
    shared = [[word() for _ in range(rng.randrange(20, 160))] for _ in range(4)]
    files = {}
    for f in range(n):
        text = [word() for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.randrange(0, 3)):
            s = rng.choice(shared)
            a = rng.randrange(len(s))
            at = rng.randrange(len(text) + 1)
            text[at:at] = s[a:]
        files[f] = text
    files[n] = list(files[0])  # a copy
    files[n + 1] = ["a"] * 300  # one token only, and its copy with an edit
    files[n + 2] = ["a"] * 170 + ["b"] + ["a"] * 90
    return files


def test_top_n_matches_a_sort(spark, collect):
    rng = random.Random(1)
    items = [(g, i, rng.choice([None, 1, 2, 2, 3])) for g in (None, 1, 2, 3) for i in range(40 if g != 2 else 3)]
    items += [(1, None, 9), *items[:50]]
    df = spark.createDataFrame([(g, i, s, "x", 0) for g, i, s in items], "scan long, item long, score int, _g string, pos int")
    want = []
    for g in (1, 2, 3):
        best = sorted({(-s, i) for gg, i, s in items if gg == g and s is not None and i is not None})[:10]
        want += [(g, p + 1, i) for p, (_, i) in enumerate(best)]
    assert collect(topn.top_n_per_group(df, "scan", "item", "score", 10, salts=4)) == sorted(want, key=repr)


def test_top_n_of_nothing_and_of_one_hot_group(spark, collect):
    empty = spark.createDataFrame([], "g long, i long, s int")
    assert collect(topn.top_n_per_group(empty, "g", "i", "s", 3)) == []
    hot = spark.range(5000).selectExpr("1L as g", "id as i", "cast(id % 7 as int) as s")
    assert [r[2] for r in collect(topn.top_n_per_group(hot, "g", "i", "s", 3))] == [6, 13, 20]


def test_scores_that_disagree_count_once_by_the_highest(spark, collect):
    df = spark.createDataFrame([(1, 1, 5), (1, 1, 9), (1, 2, 7)], "g long, i long, s int")
    assert collect(topn.top_n_per_group(df, "g", "i", "s", 2)) == [(1, 1, 1), (1, 2, 2)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_union_find(spark, collect, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 201 + i) for i in range(30)]
    edges += [(5, 5), *edges[:5]]
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in edges] + [(None, 3, 1, 2), (4, None, 1, 2)], "a long, b long, u int, v int")
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    assert collect(components.connected_components(df)) == sorted(((x, find(x)) for x in list(up)), key=repr)


def test_components_of_no_edges(spark, collect):
    assert collect(components.connected_components(spark.createDataFrame([], "a string, b string"))) == []


def test_spellings_of_an_advisory_are_one(spark, collect):
    data = [
        ("CVX-2030-0000001", [" ghsx–aaaa‑bbbb-cccc\t", None, "N/A", ""], 1), ("GHSX-AAAA-BBBB-CCCC", None, 1), ("cvx-2030-0000009 ", ["TBD", "see url", "-"], 2),
        ("CVX-2031-0000002", ["none"], 3), ("PYX-2031-0000003", ["A-1-1", "pyx-2031-0000003"], 3), (None, ["CVX-2030-0000001"], 4), ("GHSX-AAAA-BBBB-CCCC", [], 5),
    ]
    df = spark.createDataFrame(data, "osv_id string, aliases array<string>, node int")
    assert collect(components.advisory_groups(df)) == [
        ("CVX-2030-0000001", "CVX-2030-0000001"), ("GHSX-AAAA-BBBB-CCCC", "CVX-2030-0000001"), ("PYX-2031-0000003", "A-1-1"),
    ]
    assert collect(components.advisory_groups(df.where("false"))) == []


def test_an_identifier_of_zeros_links_nothing(spark, collect):
    data = [
        ("CVX-2030-0000001", ["CVX-0000-0000000"]), ("CVX-2030-0000002", [" cvx‐0000‐0000000", "GHSX-AAAA-BBBB-CCC0"]), ("CVX-2030-0000003", ["PYX-0000-00000"]),
        ("CVX-0000-0000000", ["CVX-2030-0000003"]), ("CVX-2030-0000004", ["CVX-2000-0000000", "PYX-0000-0000010"]),
    ]
    df = spark.createDataFrame(data, "osv_id string, aliases array<string>")
    assert collect(components.advisory_groups(df)) == [("CVX-2030-0000002", "CVX-2030-0000002"), ("CVX-2030-0000004", "CVX-2000-0000000")]


def test_fm_index_finds_what_a_scan_finds():
    rng = np.random.default_rng(3)
    docs = [rng.integers(2, 6, n) for n in (30, 1, 17, 30)]
    text = np.concatenate([np.append(d, 1) for d in docs])
    owner = np.repeat(np.arange(4), [len(d) + 1 for d in docs])
    index = fmindex.FMIndex(text, owner, 6)
    codes = np.concatenate(docs)
    bounds = np.cumsum([0, *map(len, docs)])
    start, end, own = [], [], []
    for k, d in enumerate(docs):
        for e in range(len(d)):
            start.append(bounds[k])
            end.append(bounds[k] + e)
            own.append(k)
    got = index.reach(codes, np.array(start), np.array(end), np.array(own))
    for s, e, k, r in zip(start, end, own, got, strict=True):
        want = e + 1
        while want > s and any(
            j != k and " ".join(map(str, codes[want - 1 : e + 1])) in " ".join(map(str, d)) for j, d in enumerate(docs)
        ):
            want -= 1
        assert r == want


@pytest.mark.parametrize(("seed", "block"), [(1, 1_000_000), (2, 400), (3, 60)])
def test_shared_spans_match_brute_force(spark, collect, seed, block):
    files = random_files(seed)
    data = token_rows(files)
    df = spark.createDataFrame(data + data[:40], TOKENS).repartition(3)
    packed = cut(streams.file_streams(df), "t")
    assert collect(spans.shared_spans(packed, 50, block)) == brute_spans(files, 50)


def test_shared_spans_of_little(spark, collect):
    empty = cut(streams.file_streams(spark.createDataFrame([], TOKENS)), "t")
    assert collect(spans.shared_spans(empty)) == []
    rows = token_rows({1: ["a"] * 49, 2: ["a"] * 49, 3: []}) + [(None, 1, 1, "a", "", "", ""), (1, None, 1, "a", "", "", ""), (4, 0, 1, None, "", "", "")]
    short = cut(streams.file_streams(spark.createDataFrame(rows, TOKENS)), "t")
    assert collect(spans.shared_spans(short)) == []


def edited(rng, text, share):
    out = [t if rng.random() > share else f"e{rng.randrange(1000)}" for t in text]
    cut_at = rng.randrange(len(out))
    return out[cut_at:] + out[:cut_at]


def brute_pairs(files, threshold=0.7):
    sets = {f: {tuple(t[i : i + 5]) for i in range(len(t) - 4)} for f, t in files.items() if len(t) >= 50}
    return sorted(
        ((a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 10 * threshold * len(sets[a] | sets[b]) - 1e-6), key=repr
    )


def test_near_duplicates_match_brute_force(spark, collect):
    rng = random.Random(5)
    files = {}
    for k in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(60, 400))]
        files[10 * k] = base
        for j, share in enumerate((0.0, 0.01, 0.03, 0.06, 0.1)):
            files[10 * k + j + 1] = edited(rng, base, share)
    files[500] = list(files[0])
    files[501] = ["x"] * 49
    files[502] = ["x"] * 49
    df = spark.createDataFrame(token_rows(files), TOKENS).repartition(3)
    packed = cut(streams.file_streams(df), "t")
    assert collect(balls.similar_pairs(packed)) == brute_pairs(files)
    groups = collect(balls.near_duplicate_groups(packed))
    assert len(groups) == len(files) - 2 and {g[0]: g[1] for g in groups}[500] == 0
    linked = defaultdict(set)
    for f, _, group, _ in groups:
        linked[group].add(f)
    assert {0, 500} <= linked[0]


def test_crowded_variants_lose_and_add_nothing(spark, collect):
    rng = random.Random(8)
    header = [f"h{i}" for i in range(150)]
    files = {k: header + [f"w{k}_{rng.randrange(10**6)}" for _ in range(rng.randrange(60, 200))] for k in range(40)}
    for k in range(5):
        files[100 + k] = edited(rng, files[k], 0.01)
    packed = cut(streams.file_streams(spark.createDataFrame(token_rows(files), TOKENS).repartition(3)), "t")
    assert collect(balls.similar_pairs(packed, crowd=3)) == collect(balls.similar_pairs(packed)) == brute_pairs(files)
    reps = packed.select("file_id").withColumnRenamed("file_id", "rep")
    assert 5 <= balls.crowded_pairs(packed, reps, 0.7).count() < 60


def test_near_duplicates_of_nothing(spark, collect):
    empty = cut(streams.file_streams(spark.createDataFrame([], TOKENS)), "t")
    assert collect(balls.similar_pairs(empty)) == [] and balls.miss_rate(0.7) < 2e-4
