"""Clone groups, file pairs and blocks against brute force on small token tables."""

import random

from codelode.operators import clones, duplication

TOKENS = "file_id long, unit int, line int, text string"


def table(spark, files):
    return spark.createDataFrame([(f, i, i + 1, t) for f, ts in files.items() for i, t in enumerate(ts)], TOKENS)


def maximal_repeats(files, size):
    """All runs of at least ``size`` lines that stand twice and lose a place when made longer on either side, without those that lie within one other."""
    found = {}
    for f, ts in files.items():
        for i in range(len(ts)):
            for j in range(i + size, len(ts) + 1):
                found.setdefault(tuple(ts[i:j]), []).append((f, i, j))
    kept = {}
    for run, places in found.items():
        if len(places) > 1:
            left = {files[f][i - 1] if i else (f, i) for f, i, _ in places}
            right = {files[f][j] if j < len(files[f]) else (f, j) for f, _, j in places}
            if len(left) > 1 and len(right) > 1:
                kept[run] = places

    def within(a, b):
        inside = all(any(f == g and k <= i and j <= n for g, k, n in kept[b]) for f, i, j in kept[a])
        return a != b and len(b) > len(a) and inside and {f for f, *_ in kept[b]} <= {f for f, *_ in kept[a]}

    return sorted((f, i + 1, j) for a in kept if not any(within(a, b) for b in kept) for f, i, j in kept[a])


def test_clone_parts_are_the_maximal_repeats(spark, collect):
    rng = random.Random(4)
    for alphabet, length in ((3, 14), (40, 60)):
        shared = [f"s{rng.randrange(200)}" for _ in range(12)]
        files = {}
        for f in range(4):
            ts = [f"w{rng.randrange(alphabet)}" for _ in range(length)]
            if f < 3 and alphabet > 3:
                at = rng.randrange(20)
                ts[at : at + 12 - 2 * f] = shared[f : 12 - f]
            # Equal lines in a row are collapsed before, which brute force does not do.
            files[f] = [t for i, t in enumerate(ts) if not i or t != ts[i - 1]]
        for many in (clones.MANY, 1):
            found = collect(clones.clone_parts(table(spark, files), size=3, min_tokens=1, many=many).select("file_id", "start_line", "end_line"))
            assert found == sorted(maximal_repeats(files, 3), key=repr)


def test_clones_of_little(spark, collect):
    empty = spark.createDataFrame([], TOKENS)
    assert collect(clones.clone_parts(empty)) == [] and collect(clones.file_pairs(clones.fingerprints(empty))) == []
    alike = {1: [f"a{i}" for i in range(30)], 2: [f"b{i}" for i in range(30)]}
    assert collect(clones.clone_parts(table(spark, alike), min_tokens=1)) == []
    # Words alike on every line, told apart by signs.
    signs = [f"{i} +" if i % 2 else f"{i} -" for i in range(30)]
    files = {f: [t for i, s in enumerate(signs) for t in (f"{w}{i}", s)] for f, w in ((1, "a"), (2, "b"))}
    tokens = spark.createDataFrame([(f, i, i // 2 + 1, t) for f, ts in files.items() for i, t in enumerate(ts)], TOKENS)
    assert clones.clone_parts(tokens, min_tokens=1).count() == 0
    assert collect(clones.clone_groups(clones.clone_parts(tokens, min_tokens=1, normalize_identifiers=True)).drop("group_id")) == [(2, 2, 21, 30)]


def test_file_pairs_and_blocks(spark, collect):
    rng = random.Random(6)
    common = [f"c{i}" for i in range(260)]
    files = {1: common + [f"a{i}" for i in range(200)], 2: [f"b{i}" for i in range(60)] + common, 3: [f"d{i}" for i in range(300)], 4: [f"d{i}" for i in range(300)], 5: [f"e{rng.randrange(10**6)}" for _ in range(100)] + common[:130]}
    tokens = table(spark, files)
    prints = clones.fingerprints(tokens).persist()
    sets = {}
    for r in prints.collect():
        sets.setdefault(r["file_id"], set()).add(r["hash"])
    reps = [1, 2, 3, 5]
    want = sorted(((a, b, len(sets[a] & sets[b])) for a in reps for b in reps if a < b and sets[a] & sets[b]), key=lambda x: (-x[2], x[0], x[1]))
    for top, rare in ((500, 32), (2, 32), (2, 1), (1, 32)):
        got = clones.file_pairs(prints, top, rare)
        assert sorted(map(tuple, got.select("file_a", "file_b", "shared").collect()), key=lambda x: (-x[2], x[0], x[1])) == want[:top]
    assert {(r["file_id"], r["rep"], r["copies"]) for r in clones.file_classes(prints).collect()} >= {(3, 3, 2), (4, 3, 2), (1, 1, 1)}
    blocks = clones.fingerprint_blocks(prints, tokens, clones.file_pairs(prints))
    found = {(r["file_a"], r["file_b"]): (r["start_a"], r["end_a"], r["start_b"], r["end_b"]) for r in blocks.collect()}
    a, z, b, y = found[(1, 2)]
    assert 1 <= a < 20 and 240 < z <= 260 and b - a == 60 and y - z == 60
    kept = clones.undominated(blocks).collect()
    assert kept[0]["tokens"] == max(r["tokens"] for r in blocks.collect()) and (2, 5) not in {(r["file_a"], r["file_b"]) for r in kept}
    spans = {(r["file_a"], r["file_b"]): r["blocks"] for r in clones.legacy_pairs(tokens, clones.file_pairs(prints)).collect()}
    assert spans[(1, 2)] == 251


def test_collapse_in_both_ways(spark, collect):
    lines = spark.createDataFrame([(1, i + 1, v, i, i) for i, v in enumerate("aabbbcddd")], "file_id long, line int, value string, start_unit int, end_unit int")
    assert [r[1] for r in collect(duplication.collapse_runs(lines))] == [1, 2, 3, 5, 6, 7, 9]
    assert [r[1] for r in collect(duplication.collapse_runs(lines, keep_pairs=False))] == [1, 3, 5, 6, 7, 9]
