"""Clone groups, file pairs and duplicate blocks, without a pair of places for every repetition.

Places of a line block whose copies all go on alike are one *stretch*; the stretches of a file are a short sequence of classes. Clone
groups are the maximal repeats of these sequences: runs of classes that cannot be made longer, to the left or to the right, without
losing a place.
"""

from __future__ import annotations

from hashlib import md5

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.operators.duplication import BLOCK_LINES, MIN_TOKENS, SHINGLE, WINDOW, collapse_runs, line_blocks, shingles, token_lines, winnow
from codelode.session import cut, drop_cut

#: Different continuations of one class that one task looks at.
MANY = 20_000


def stretches(blocks: DataFrame) -> DataFrame:
    """``(file_id, seq, class, start_idx, end_idx, start_line, end_line, start_unit, end_unit)``: runs of repeated blocks with one set of places.

    Whether two neighbouring blocks have the same places, moved by one, is seen from the number of places and the xor of their
    hashes, so no list of places is ever held.
    """
    here = blocks.withColumn("at", F.xxhash64("file_id", "idx")).withColumn("back", F.xxhash64("file_id", F.col("idx") - 1))
    places = here.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("at").alias("x"), F.bit_xor("back").alias("xb")).where("n > 1")
    hit = blocks.join(places, "hash")
    w = Window.partitionBy("file_id").orderBy("idx")
    goes_on = (F.lag("idx").over(w) == F.col("idx") - 1) & (F.lag("n").over(w) == F.col("n")) & (F.lag("x").over(w) == F.col("xb"))
    marked = hit.withColumn("seq", F.sum(F.when(goes_on, 0).otherwise(1)).over(w))
    return marked.groupBy("file_id", "seq").agg(
        F.min(F.struct("idx", "hash"))["hash"].alias("class"), F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"), F.min("start_line").alias("start_line"),
        F.max("end_line").alias("end_line"), F.min("start_unit").alias("start_unit"), F.max("end_unit").alias("end_unit"),
    )


def clone_parts(tokens: DataFrame, size: int = BLOCK_LINES, min_tokens: int = MIN_TOKENS, normalize_identifiers: bool = False, many: int = MANY) -> DataFrame:
    """``(group_id, file_id, start_line, end_line, blocks, tokens)``: the parts of each clone group.

    A group is a longest run of lines, of ``size`` lines at least, that stands in two places or more; places may lie in one file. A group
    all of whose parts lie within parts of one other group of the same files is left out, and so is one without a part of
    ``min_tokens``. All places of a run begin with one class, so each class is looked at by itself, with what follows its places; places that go
    on alike count as one. A class with more than ``many`` different continuations is taken level by level instead.
    """
    blocks = line_blocks(collapse_runs(token_lines(tokens, normalize_identifiers)), size)
    base = cut(stretches(blocks), "stretches")
    w = Window.partitionBy("file_id").orderBy("seq")
    joined = F.coalesce(F.lag("end_idx").over(w) == F.col("start_idx") - 1, F.lit(False))
    linked = base.withColumn("joined", joined).withColumn("chain", F.sum(F.when(F.col("joined"), 0).otherwise(1)).over(w))
    chains = linked.groupBy("file_id", "chain").agg(F.min("seq").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "class"))), lambda x: x["class"]).alias("all"))
    each = chains.select("file_id", "first", "all", F.posexplode("all").alias("i", "class"))
    following = F.slice("all", F.col("i") + 1, F.size("all"))
    rows = each.select("file_id", (F.col("first") + F.col("i")).alias("seq"), "class", F.get("all", F.col("i") - 1).alias("prev"), following.alias("after"))
    rows = cut(rows.withColumn("key", F.md5(F.concat_ws("|", "after"))), "places")
    kinds = cut(rows.groupBy("class", "key", "prev").agg(F.count(F.lit(1)).alias("n"), F.first("after").alias("after")), "kinds")
    classes = kinds.groupBy("class").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("places")).where("places > 1")
    small = kinds.join(classes.where(F.col("kinds") <= many), "class", "left_semi")
    runs = small.groupBy("class").applyInArrow(_repeats, "class string, key string, length int, group_id string, n long")
    found = rows.join(runs, ["class", "key"]).select("file_id", F.col("seq").alias("a"), (F.col("seq") + F.col("length") - 1).alias("b"), "group_id", "n")
    large = classes.where(F.col("kinds") > many).select("class")
    if not large.isEmpty():
        found = found.unionByName(_by_levels(linked, large))
    first = base.select("file_id", F.col("seq").alias("a"), "start_idx", "start_line", "start_unit")
    last = base.select("file_id", F.col("seq").alias("b"), "end_idx", "end_line", "end_unit")
    parts = found.join(first, ["file_id", "a"]).join(last, ["file_id", "b"]).select(
        "group_id", "n", "file_id", "start_line", "end_line", "start_idx", "end_idx", (F.col("end_idx") - F.col("start_idx") + 1).alias("blocks"), (F.col("end_unit") - F.col("start_unit") + 1).alias("tokens")
    )
    wide = parts.groupBy("group_id").agg(F.max("tokens").alias("most")).where(F.col("most") >= min_tokens).select("group_id")
    return without_contained(cut(parts.join(wide, "group_id", "left_semi"), "parts")).select("group_id", "file_id", "start_line", "end_line", "blocks", "tokens")


def _repeats(table: pa.Table) -> pa.Table:
    """The maximal repeats that begin with one class, given by length for each continuation that has them."""
    name = table["class"][0].as_py()
    rows = list(zip(*(table[c].to_pylist() for c in ("key", "prev", "n", "after")), strict=True))
    out: dict[tuple[str, int], tuple[str, int]] = {}
    level, depth = {name: rows}, 1
    while level:
        deeper: dict[str, list] = {}
        for run, some in level.items():
            total = sum(r[2] for r in some)
            if total < 2:
                continue
            nexts: dict[str, list] = {}
            for r in some:
                if len(r[3]) > depth:
                    nexts.setdefault(r[3][depth], []).append(r)
            left = {r[1] for r in some}
            if (None in left or len(left) > 1) and not any(sum(r[2] for r in more) == total for more in nexts.values()):
                for r in some:
                    out[(r[0], depth)] = (run, total)
            for c, more in nexts.items():
                deeper[md5(f"{run}|{c}".encode()).hexdigest()] = more
        level, depth = deeper, depth + 1
    return pa.table(
        {
            "class": pa.array([name] * len(out), pa.string()), "key": pa.array([k for k, _ in out], pa.string()), "length": pa.array([d for _, d in out], pa.int32()),
            "group_id": pa.array([g for g, _ in out.values()], pa.string()), "n": pa.array([n for _, n in out.values()], pa.int64()),
        }
    )


def _by_levels(linked: DataFrame, classes: DataFrame, max_levels: int = 1000) -> DataFrame:
    """The same for classes of any size: each level is one grouped count over the places whose run is still repeated. Raises after ``max_levels``."""
    now = cut(linked.join(classes, "class", "left_semi").select("file_id", "seq", F.col("seq").alias("last"), F.col("class").alias("run"), "joined"), "runs")
    nxt = linked.select("file_id", F.col("seq").alias("to"), F.col("class").alias("next")).where("joined")
    prev = linked.select("file_id", (F.col("seq") + 1).alias("seq"), F.col("class").alias("prev"))
    done: DataFrame | None = None
    for _ in range(max_levels):
        counts = now.groupBy("run").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        alive = cut(now.join(counts, "run"), "alive")
        drop_cut(now)
        grown = alive.withColumn("to", F.col("last") + 1).join(nxt, ["file_id", "to"]).select(
            "file_id", "seq", F.col("to").alias("last"), F.md5(F.concat_ws("|", "run", "next")).alias("run"), "joined", F.col("run").alias("short"), F.col("n").alias("short_n")
        )
        grown = cut(grown, "grown")
        not_right = grown.groupBy("run", "short", "short_n").agg(F.count(F.lit(1)).alias("m")).where("m = short_n").select(F.col("short").alias("run")).distinct()
        # To the left: all places go back to one and the same class.
        not_left = alive.where("joined").join(prev, ["file_id", "seq"]).groupBy("run", "n", "prev").agg(F.count(F.lit(1)).alias("m")).where("m = n").select("run").distinct()
        found = cut(alive.join(not_right, "run", "left_anti").join(not_left, "run", "left_anti").select("file_id", F.col("seq").alias("a"), F.col("last").alias("b"), F.col("run").alias("group_id"), "n"), "found")
        done = found if done is None else done.unionByName(found)
        now = cut(grown.select("file_id", "seq", "last", "run", "joined"), "runs")
        drop_cut(grown)
        drop_cut(alive)
        if now.isEmpty():
            return done
    raise RuntimeError(f"runs still grow after {max_levels} levels")


def without_contained(parts: DataFrame) -> DataFrame:
    """The parts of groups that no other group contains: an interval join within files, and a division, as all parts of the one must be covered by one other
    group whose files are among its own."""
    inner = parts.select("file_id", F.col("group_id").alias("g"), F.col("n").alias("size"), F.col("start_idx").alias("s"), F.col("end_idx").alias("e"))
    outer = parts.select("file_id", F.col("group_id").alias("h"), F.col("start_idx").alias("hs"), F.col("end_idx").alias("he"))
    covered = inner.join(outer, "file_id").where("g <> h and hs <= s and e <= he and he - hs > e - s")
    covers = covered.groupBy("g", "h", "size").agg(F.countDistinct("file_id", "s").alias("m"), F.countDistinct("file_id").alias("files")).where("m = size")
    spans = parts.groupBy(F.col("group_id").alias("h")).agg(F.countDistinct("file_id").alias("of"))
    contained = covers.join(spans, "h").where("of = files").select(F.col("g").alias("group_id")).distinct()
    return parts.join(contained, "group_id", "left_anti")


def clone_groups(parts: DataFrame) -> DataFrame:
    """``(group_id, parts, files, blocks, lines)`` of each group of :func:`clone_parts`; ``lines`` is the longest part's."""
    return parts.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("parts"), F.countDistinct("file_id").alias("files"), F.max("blocks").alias("blocks"), F.max(F.col("end_line") - F.col("start_line") + 1).alias("lines")
    )


def top_blocks(parts: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` groups of most lines, ties by their first place: ``(lines, parts, file_id, start_line)``."""
    first = parts.groupBy("group_id").agg(
        F.max(F.col("end_line") - F.col("start_line") + 1).alias("lines"), F.count(F.lit(1)).alias("parts"), F.min(F.struct("file_id", "start_line")).alias("f")
    )
    return first.select("lines", "parts", "f.file_id", "f.start_line").orderBy(F.desc("lines"), "file_id", "start_line", "parts").limit(n)


def fingerprints(tokens: DataFrame) -> DataFrame:
    """``(file_id, pos, hash)`` of each file's winnowed fingerprints."""
    return winnow(shingles(tokens))


def file_classes(prints: DataFrame) -> DataFrame:
    """``(file_id, rep, copies)``: files by the set of their fingerprints; of files with equal sets the least id stands for all."""
    sets = prints.select("file_id", "hash").distinct().groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("hash")).alias("x"), F.bit_xor(F.xxhash64("hash", F.lit(1))).alias("y"))
    reps = sets.groupBy("n", "x", "y").agg(F.min("file_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    return sets.join(reps, ["n", "x", "y"]).select("file_id", "rep", "copies")


def file_pairs(prints: DataFrame, top: int = 500, rare: int = 32) -> DataFrame:
    """``(file_a, file_b, shared, copies_a, copies_b)``: the ``top`` pairs of files that share most fingerprints, ties by id.

    A pair is one of files with different fingerprints; each stands for its ``copies``. Exact without a pair for every frequent
    fingerprint: pairs over those of at most ``rare`` files give a bound that the last of the top reaches; a pair that reaches it has one of the rarest
    fingerprints of each file in common, all but ``bound - 1`` of them, so only these are joined, and candidates are counted over the whole sets.
    """
    classes = cut(file_classes(prints), "classes")
    reps = classes.where("file_id = rep").select("file_id", "copies")
    own = prints.select("file_id", "hash").distinct().join(reps.select("file_id"), "file_id", "left_semi")
    frequent = own.groupBy("hash").agg(F.count(F.lit(1)).alias("freq")).where("freq > 1")
    items = cut(own.join(frequent, "hash"), "items")
    pair = lambda x: x.alias("a").join(x.alias("b"), (F.col("a.hash") == F.col("b.hash")) & (F.col("a.file_id") < F.col("b.file_id"))).select(F.col("a.file_id").alias("file_a"), F.col("b.file_id").alias("file_b"))
    some = pair(items.where(F.col("freq") <= rare)).groupBy("file_a", "file_b").agg(F.count(F.lit(1)).alias("shared")).orderBy(F.desc("shared")).limit(top)
    least = some.agg(F.count(F.lit(1)), F.min("shared")).first()
    bound = least[1] if least[0] == top else 1
    ranked = items.withColumn("rank", F.row_number().over(Window.partitionBy("file_id").orderBy("freq", "hash"))).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("file_id")))
    likely = pair(ranked.where(F.col("rank") <= F.col("size") - bound + 1)).distinct()
    sets = cut(items.groupBy("file_id").agg(F.collect_set("hash").alias("set")), "sets")
    side = lambda p: sets.select(F.col("file_id").alias(f"file_{p}"), F.col("set").alias(f"set_{p}"))
    counted = likely.join(side("a"), "file_a").join(side("b"), "file_b").select("file_a", "file_b", F.size(F.array_intersect("set_a", "set_b")).alias("shared"))
    best = counted.orderBy(F.desc("shared"), "file_a", "file_b").limit(top)
    copies = lambda p: reps.select(F.col("file_id").alias(f"file_{p}"), F.col("copies").alias(f"copies_{p}"))
    return best.join(copies("a"), "file_a").join(copies("b"), "file_b").select("file_a", "file_b", "shared", "copies_a", "copies_b")


def fingerprint_blocks(prints: DataFrame, tokens: DataFrame, pairs: DataFrame, min_tokens: int = MIN_TOKENS, most_cells: int = 4_000_000) -> DataFrame:
    """``(file_a, start_a, end_a, file_b, start_b, end_b, tokens)``: for each pair the longest run of fingerprints that both have in a row, in lines.

    Equal fingerprints of a pair lie on diagonals; a run is an island of one. Pairs with more than ``most_cells`` possible matches are
    passed over, runs need ``min_tokens / WINDOW`` fingerprints; of equal runs the first in the first file counts.
    """
    w = Window.partitionBy("file_id").orderBy("pos")
    near = prints.join(pairs.select(F.explode(F.array("file_a", "file_b")).alias("file_id")).distinct(), "file_id", "left_semi")
    seq = cut(near.select("file_id", "pos", "hash", F.row_number().over(w).alias("i"), F.count(F.lit(1)).over(Window.partitionBy("file_id")).alias("m")), "seq")
    side = lambda p: seq.select(F.col("file_id").alias(f"file_{p}"), F.col("pos").alias(f"pos_{p}"), "hash", F.col("i").alias(f"i_{p}"), F.col("m").alias(f"m_{p}"))
    met = pairs.select("file_a", "file_b").join(side("a"), "file_a").join(side("b"), ["file_b", "hash"]).where(F.col("m_a").cast("long") * F.col("m_b") <= most_cells)
    met = met.withColumn("diagonal", F.col("i_b") - F.col("i_a"))
    island = F.col("i_a") - F.row_number().over(Window.partitionBy("file_a", "file_b", "diagonal").orderBy("i_a"))
    runs = met.withColumn("island", island).groupBy("file_a", "file_b", "diagonal", "island").agg(
        F.count(F.lit(1)).alias("length"), F.min("i_a").alias("i"), F.min("pos_a").alias("from_a"), F.max("pos_a").alias("to_a"), F.min("pos_b").alias("from_b"), F.max("pos_b").alias("to_b")
    )
    best = F.row_number().over(Window.partitionBy("file_a", "file_b").orderBy(F.desc("length"), F.col("i") + F.col("length"), "diagonal"))
    kept = runs.withColumn("r", best).where(f"r = 1 and length >= {-(-min_tokens // WINDOW)}")
    line = tokens.join(near.select("file_id").distinct(), "file_id", "left_semi").select("file_id", (F.row_number().over(Window.partitionBy("file_id").orderBy("unit")) - 1).alias("pos"), "line")
    line = cut(line, "lines")
    out = kept.select("file_a", "file_b", "from_a", (F.col("to_a") + SHINGLE - 1).alias("to_a"), "from_b", (F.col("to_b") + SHINGLE - 1).alias("to_b"))
    for p in "ab":
        for edge, name in (("from", "start"), ("to", "end")):
            out = out.join(line.select(F.col("file_id").alias(f"file_{p}"), F.col("pos").alias(f"{edge}_{p}"), F.col("line").alias(f"{name}_{p}")), [f"file_{p}", f"{edge}_{p}"])
    size = F.greatest(F.col("to_a") - F.col("from_a"), F.col("to_b") - F.col("from_b")) + 1
    return out.select("file_a", "start_a", "end_a", "file_b", "start_b", "end_b", size.alias("tokens"))


def undominated(blocks: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` largest blocks, without those of which a place lies, in the same file, within a wider place of a larger block that is kept.

    Whether a larger block is kept depends on those before it, so this goes through the blocks in order; they are at most one for each of the top pairs,
    and the driver holds no more than that.
    """
    rows = blocks.orderBy(F.desc("tokens"), "file_a", "file_b").limit(500).collect()
    kept: list = []
    for r in rows:
        places = ((r["file_a"], r["start_a"], r["end_a"]), (r["file_b"], r["start_b"], r["end_b"]))
        wide = ((k[f"file_{p}"], k[f"start_{p}"], k[f"end_{p}"]) for k in kept for p in "ab")
        if not any(f == g and s <= a and e >= z and e - s > z - a for g, s, e in wide for f, a, z in places):
            kept.append(r)
    return blocks.sparkSession.createDataFrame([tuple(r) for r in kept[:n]], blocks.schema)


def legacy_pairs(tokens: DataFrame, pairs: DataFrame, min_lines: int = 10, size: int = BLOCK_LINES) -> DataFrame:
    """``(file_a, file_b, blocks, start_a, end_a, start_b, end_b)``: for each pair the span of the line blocks both have, if they share enough of them."""
    blocks = line_blocks(collapse_runs(token_lines(tokens), keep_pairs=False), size)
    side = lambda p: blocks.select(F.col("file_id").alias(f"file_{p}"), "hash", F.col("start_line").alias(f"s_{p}"), F.col("end_line").alias(f"e_{p}"))
    met = pairs.select("file_a", "file_b").join(side("a"), "file_a").join(side("b"), ["file_b", "hash"])
    spans = met.groupBy("file_a", "file_b").agg(
        F.countDistinct("hash").alias("blocks"), F.min("s_a").alias("start_a"), F.max("e_a").alias("end_a"), F.min("s_b").alias("start_b"), F.max("e_b").alias("end_b")
    )
    return spans.where(F.col("blocks") >= max(2, -(-min_lines // 10)))
