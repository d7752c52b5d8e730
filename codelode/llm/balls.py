"""Near-duplicate token streams by meet-in-the-middle ball hashing.

A fingerprint is a tuple of ``SYMBOLS`` MinHash values of a file's runs of five tokens. In
deletion distance (deletions plus insertions) two fingerprints that differ in ``HALF``
places are ``2 * HALF`` apart, and each reaches the other half way by deleting
those places. So every fingerprint emits its variants with ``HALF`` places deleted, and
fingerprints that meet in a variant lie within the radius. ``TABLES`` independent fingerprints
make a miss at similarity 0.7 a matter of about one in 8,000 (see :func:`miss_rate`).
Colliding pairs are deduplicated and verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.llm.components import connected_components
from codelode.llm.streams import U64, grams, mix, pack_binary, unpack_binary
from codelode.session import cut

SYMBOLS, HALF, TABLES = 5, 2, 5
SHINGLE = 5
#: Of all SYMBOLS * TABLES values, verified pairs must agree in this many at least; at similarity 0.7 fewer have a chance of 1e-5.
AGREE = 8
#: Classes that may meet in one variant. More are paired by the rarest of their runs of tokens, exactly.
CROWD = 1000
_SEEDS = mix(np.arange(1, SYMBOLS * TABLES + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
_KEPT = list(combinations(range(SYMBOLS), SYMBOLS - HALF))


def miss_rate(similarity: float) -> float:
    """The chance that a pair of this Jaccard similarity meets in no variant of any table."""
    kept = sum(
        comb(SYMBOLS, k) * similarity**k * (1 - similarity) ** (SYMBOLS - k) for k in range(SYMBOLS - HALF, SYMBOLS + 1)
    )
    return (1 - kept) ** TABLES


def similar_classes(streams: DataFrame, threshold: float = 0.7, min_tokens: int = 50, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """Members ``(file_id, rep)`` of classes of equal streams, and pairs ``(rep_a, rep_b)`` of similar classes.

    ``streams`` is ``(file_id, hashes)``, one row per file, read more than once. Similarity is the
    Jaccard similarity of the sets of runs of five tokens; files below ``min_tokens`` take
    no part. Equal streams are grouped first by a 128-bit hash, so however many copies a
    file has, one of them is fingerprinted. The collisions are an equi-join on the variant. Where more than ``crowd`` classes share a
    variant, as a common header brings about, they are not paired in it: :func:`crowded_pairs` finds all similar pairs among them.
    """
    marks = cut(
        streams.mapInArrow(_fingerprints(min_tokens), "file_id long, c1 long, c2 long, signature binary"), "marks"
    )
    reps = marks.groupBy("c1", "c2").agg(F.min("file_id").alias("rep"))
    members = cut(marks.select("file_id", "c1", "c2").join(reps, ["c1", "c2"]).select("file_id", "rep"), "members")
    kept = cut(
        marks.select("file_id", "signature").join(members.where("file_id = rep"), "file_id").select("rep", "signature"),
        "kept",
    )
    variants = kept.mapInArrow(_variants, "variant long, rep long")
    hot = cut(variants.groupBy("variant").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("variant"), "hot")
    crowded = None
    if not hot.isEmpty():
        crowded = crowded_pairs(streams, variants.join(hot, "variant", "left_semi").select("rep").distinct(), threshold)
        variants = variants.join(hot, "variant", "left_anti")
    pairs = (
        variants.alias("x")
        .join(variants.alias("y"), (F.col("x.variant") == F.col("y.variant")) & (F.col("x.rep") < F.col("y.rep")))
        .select(F.col("x.rep").alias("rep_a"), F.col("y.rep").alias("rep_b"))
        .distinct()
    )
    if crowded is not None:
        pairs = pairs.unionByName(crowded).distinct()
    side = lambda p: kept.select(F.col("rep").alias(f"rep_{p}"), F.col("signature").alias(f"signature_{p}"))
    likely = cut(
        pairs.join(side("a"), "rep_a").join(side("b"), "rep_b").mapInArrow(_agreeing, "rep_a long, rep_b long"), "likely"
    )
    text = lambda p: streams.select(F.col("file_id").alias(f"rep_{p}"), F.col("hashes").alias(f"hashes_{p}"))
    checked = (
        likely.join(text("a"), "rep_a").join(text("b"), "rep_b").mapInArrow(_similar(threshold), "rep_a long, rep_b long")
    )
    return members, cut(checked, "similar")


def crowded_pairs(streams: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """``(rep_a, rep_b)``: candidates among ``reps`` that hold every pair of at least ``threshold`` similarity.

    Two sets so similar share one of the rarest runs of tokens of each, as many as may be missing from the other and one more; what
    all of them have in common is not among these, so a frequent header pairs nothing.
    """
    sets = reps.join(streams, F.col("rep") == F.col("file_id")).select("rep", "hashes").mapInArrow(_gram_rows, "rep long, gram long, size int")
    sets = cut(sets, "grams")
    frequent = sets.groupBy("gram").agg(F.count(F.lit(1)).alias("freq"))
    rank = F.row_number().over(Window.partitionBy("rep").orderBy("freq", "gram"))
    needed = F.col("size") - F.ceil(F.col("size") * F.lit(threshold) - 1e-9) + 1
    rare = cut(sets.join(frequent, "gram").withColumn("rank", rank).where((F.col("rank") <= needed) & (F.col("freq") > 1)).select("rep", "gram", "size"), "rare")
    one, two = rare.alias("x"), rare.alias("y")
    near = F.least("x.size", "y.size") >= F.lit(threshold) * F.greatest("x.size", "y.size") - 1e-9
    return one.join(two, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.rep") < F.col("y.rep")) & near).select(F.col("x.rep").alias("rep_a"), F.col("y.rep").alias("rep_b")).distinct()


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hashes, bounds = unpack_binary(b.column("hashes"), np.int64)
        for rep, a, z in zip(b.column("rep").to_pylist(), bounds[:-1], bounds[1:], strict=True):
            found = np.unique(grams(hashes[a:z], SHINGLE)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(found), rep, np.int64)), pa.array(found), pa.array(np.full(len(found), len(found), np.int32))], names=["rep", "gram", "size"]
            )


def similar_pairs(streams: DataFrame, threshold: float = 0.7, min_tokens: int = 50, crowd: int = CROWD) -> DataFrame:
    """All pairs ``(file_a, file_b)``, ``file_a < file_b``, of similar or equal files."""
    members, pairs = similar_classes(streams, threshold, min_tokens, crowd)
    a, b = (members.select(F.col("rep").alias(f"rep_{p}"), F.col("file_id").alias(p)) for p in "ab")
    across = pairs.join(a, "rep_a").join(b, "rep_b").select("a", "b")
    within = a.join(b, F.col("rep_a") == F.col("rep_b")).where("a < b").select("a", "b")
    both = across.unionByName(within)
    return both.select(F.least("a", "b").alias("file_a"), F.greatest("a", "b").alias("file_b"))


def near_duplicate_groups(streams: DataFrame, threshold: float = 0.7, min_tokens: int = 50) -> DataFrame:
    """``(file_id, rep, group_id, links)``: each file with its class of equal files, its group of linked classes and the number of similar classes."""
    members, pairs = similar_classes(streams, threshold, min_tokens)
    found = connected_components(pairs, "rep_a", "rep_b")
    ends = pairs.select(F.col("rep_a").alias("rep")).unionAll(pairs.select("rep_b"))
    links = ends.groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    return (
        members.join(found.withColumnRenamed("node", "rep"), "rep", "left")
        .join(links, "rep", "left")
        .select("file_id", "rep", F.coalesce("component", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    )


def _fingerprints(min_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, bounds = unpack_binary(b.column("hashes"), np.int64)
            size = np.diff(bounds)
            long = np.flatnonzero(size >= max(min_tokens, SHINGLE))
            if not len(long):
                continue
            keep = np.repeat(size >= max(min_tokens, SHINGLE), size)
            h, size = hashes.view(U64)[keep], size[long]
            starts = np.cumsum(size) - size
            place = (np.arange(len(h)) - np.repeat(starts, size)).astype(U64)
            ends = [np.add.reduceat(mix(mix(h ^ s) ^ (place * s)), starts) for s in _SEEDS[:2]]
            gram = grams(h, SHINGLE)
            inside = (place + U64(SHINGLE) <= np.repeat(size, size).astype(U64))[: len(gram)]
            gram = gram[inside]
            first = starts - np.arange(len(starts)) * (SHINGLE - 1)
            signature = np.empty((len(long), len(_SEEDS)), np.uint32)
            for k, s in enumerate(_SEEDS):
                signature[:, k] = np.minimum.reduceat(((gram ^ s) * s) >> U64(32), first)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("file_id").take(pa.array(long)), pa.array(ends[0].view(np.int64)), pa.array(ends[1].view(np.int64)),
                    pack_binary(signature.ravel(), np.arange(len(long) + 1) * signature.shape[1]),
                ],
                names=["file_id", "c1", "c2", "signature"],
            )

    return run


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        signature = unpack_binary(b.column("signature"), np.uint32)[0].reshape(b.num_rows, TABLES, SYMBOLS).astype(U64)
        rep = b.column("rep").to_numpy()
        keys = []
        for t in range(TABLES):
            for n, kept in enumerate(_KEPT):
                key = np.full(len(rep), t * len(_KEPT) + n + 1, U64)
                for k in kept:
                    key = mix((key * U64(0x9E3779B97F4A7C15)) ^ signature[:, t, k])
                keys.append(key.view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(keys)), pa.array(np.tile(rep, len(keys)))], names=["variant", "rep"]
        )


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        x, y = (unpack_binary(b.column(f"signature_{p}"), np.uint32)[0].reshape(b.num_rows, -1) for p in "ab")
        keep = pa.array((x == y).sum(axis=1) >= AGREE)
        yield pa.RecordBatch.from_arrays([b.column("rep_a").filter(keep), b.column("rep_b").filter(keep)], names=["rep_a", "rep_b"])


def _similar(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            (x, xb), (y, yb) = (unpack_binary(b.column(f"hashes_{p}"), np.int64) for p in "ab")
            keep = np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                one, two = (np.unique(grams(h[n[i] : n[i + 1]], SHINGLE)) for h, n in ((x, xb), (y, yb)))
                shared = len(np.intersect1d(one, two, assume_unique=True))
                keep[i] = shared >= threshold * (len(one) + len(two) - shared) - 1e-9
            keep = pa.array(keep)
            yield pa.RecordBatch.from_arrays([b.column("rep_a").filter(keep), b.column("rep_b").filter(keep)], names=["rep_a", "rep_b"])

    return run
