"""Long exact spans shared between records, through an FM-index per shard.

A window of ``min_length`` tokens goes to the shard of its minimizer, the run of
``ANCHOR`` tokens of least hash in it, which is the same wherever the window stands. So
consecutive windows with one minimizer travel as one *stretch*, equal windows meet in one
shard, and the work stays in proportion to the input. Stretches whose minimizer
stands in one file only share nothing and are left out; equal stretches are indexed once.
The stretches of a minimizer with more tokens than one index holds are divided anew by
longer runs, at last by whole windows, of which equal ones are one stretch, so that nothing is sent to more than one shard.
In each shard an FM-index is built over the stretches and backward search gives the
matching statistics of all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.fmindex import FMIndex
from codelode.llm.streams import U64, grams, mix, pack_binary, sliding_min, unpack_binary
from codelode.session import cut, drop_cut

#: Lengths of the runs that divide windows, the next one for the stretches of those runs that are too frequent; the whole window ends the list.
ANCHORS = (16, 32)
#: Tokens in one index, and those of distinct stretches from which a minimizer is too frequent.
BLOCK = 1_000_000
#: Tokens in one Arrow batch of stretches.
SLICE = 8_000_000
_POS = U64((1 << 28) - 1)
MANY, ANY = -1, -2


def shared_spans(streams: DataFrame, min_length: int = 50, block: int = BLOCK) -> DataFrame:
    """``(file_id, start_unit, end_unit)``: each unbroken run of tokens that lie in ``min_length`` equal tokens elsewhere.

    ``streams`` is ``(file_id, hashes)`` of :func:`codelode.llm.streams.file_streams`, one row per
    file; it is read twice, so pass a written table. Equality is that of the 64-bit token hashes. A repetition within
    one file only is not shared. Files shorter than ``min_length`` and an empty table give no rows.
    """
    anchors = sorted({min(k, min_length) for k in (*ANCHORS, min_length)})
    columns = "key long, content long, file_id long, start int, length int"
    stretches = cut(streams.mapInArrow(_stretches(min_length, anchors[0]), columns), "stretches")
    for k in [*anchors[1:], None]:
        single = stretches.groupBy("key", "content").agg(
            F.min("file_id").alias("least"),
            F.max("file_id").alias("most"),
            F.min(F.struct("file_id", "start", "length")).alias("at"),
        )
        single = cut(single.select("key", "content", "least", "most", "at.*"), "single")
        keys = single.groupBy("key").agg(F.min("least").alias("a"), F.max("most").alias("b"), F.sum(F.col("length").cast("long")).alias("size")).where("a <> b")
        hot = keys.where(F.col("size") > block).select("key")
        # A key of whole windows has one stretch, so after the last length nothing is left to divide.
        if k is None or hot.isEmpty():
            break
        hot = cut(hot, "hot")
        ranges = stretches.join(hot, "key", "left_semi").groupBy("file_id").agg(F.collect_list(F.struct("start", "length")).alias("w"))
        divided = ranges.join(streams, "file_id").mapInArrow(_divided(min_length, k), columns)
        finer = cut(stretches.join(hot, "key", "left_anti").unionByName(divided), "stretches")
        for old in (stretches, single, hot):
            drop_cut(old)
        stretches = finer
    wanted = cut(
        single.join(keys.select("key"), "key", "left_semi").select(
            "key", "content", "file_id", "start", "length", F.when(F.col("least") == F.col("most"), F.col("least")).otherwise(F.lit(MANY)).alias("doc")
        ),
        "wanted",
    )
    drop_cut(single)
    total = wanted.agg(F.sum(F.col("length").cast("long"))).first()[0] or 0
    shards = max(int(streams.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // block))
    per_file = wanted.groupBy("file_id").agg(F.collect_list(F.struct("start", "length", "key", "content", "doc")).alias("w"))
    texts = per_file.join(streams, "file_id").mapInArrow(_texts, "key long, content long, doc long, tokens binary")
    found = texts.repartition(shards, "key").mapInArrow(
        _search(min_length, block), "key long, content long, hits binary"
    )
    placed = stretches.join(found, ["key", "content"]).select("file_id", "start", "hits")
    return (
        placed.groupBy("file_id")
        .agg(F.collect_list(F.struct("start", "hits")).alias("s"))
        .mapInArrow(_runs(min_length), "file_id long, start_unit int, end_unit int")
    )


def _stretches(width: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, bounds = unpack_binary(b.column("hashes"), np.int64)
            found = stretches_of(hashes, bounds, width, k)
            if found is None:
                continue
            yield _stretch_batch(b, *found)

    return run


def _stretch_batch(b: pa.RecordBatch, key, content, owner, start, length) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(key.view(np.int64)), pa.array(content.view(np.int64)), pa.array(b.column("file_id").to_numpy()[owner]),
            pa.array(start.astype(np.int32)), pa.array(length.astype(np.int32)),
        ],
        names=["key", "content", "file_id", "start", "length"],
    )


def _divided(width: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            hashes, bounds = unpack_binary(b.column("hashes"), np.int64)
            lists = b.column("w")
            owner = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(lists.offsets)))
            start, length = (lists.flatten().field(i).to_numpy().astype(np.int64) for i in range(2))
            mark = np.zeros(len(hashes) + 1, np.int64)
            np.add.at(mark, bounds[owner] + start, 1)
            np.add.at(mark, bounds[owner] + start + length - width + 1, -1)
            found = stretches_of(hashes, bounds, width, k, np.cumsum(mark[:-1]) > 0)
            if found is not None:
                yield _stretch_batch(b, *found)

    return run


def stretches_of(hashes: np.ndarray, bounds: np.ndarray, width: int, k: int, wanted: np.ndarray | None = None):
    """Minimizer, content hash, file index, start and length of every stretch of windows, all or those that begin where ``wanted``; None where there are none."""
    if len(hashes) < width:
        return None
    gram = mix(grams(hashes, k) + U64(k))
    ranked = (mix(gram) & ~_POS) | (np.arange(len(gram), dtype=U64) & _POS)
    low = sliding_min(ranked, width - k + 1)
    whole = grams(hashes, width)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(low)]
    inside = np.arange(len(low)) + width <= bounds[owner + 1]
    at = np.flatnonzero(inside if wanted is None else inside & wanted[: len(low)])
    if not len(at):
        return None
    where = (low[at] & _POS).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (where[1:] != where[:-1]) | (owner[at[1:]] != owner[at[:-1]]) | (at[1:] != at[:-1] + 1)
    first = at[new]
    last = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
    length = last - first + width
    content = mix(whole[first] * U64(3) ^ mix(whole[last] + length.astype(U64)))
    return gram[where[new]], content, owner[first], first - bounds[owner[first]], length


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        hashes, bounds = unpack_binary(b.column("hashes"), np.int64)
        lists = b.column("w")
        w = lists.flatten()
        owner = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(lists.offsets)))
        start, length, key, content, doc = (w.field(i).to_numpy() for i in range(5))
        first = bounds[owner] + start
        # Stretches overlap, so a batch may grow; it goes on in slices.
        slices = np.cumsum(length.astype(np.int64)) // SLICE
        for some in np.split(np.arange(len(key)), np.flatnonzero(np.diff(slices)) + 1):
            size = length[some].astype(np.int64)
            ends = np.concatenate(([0], np.cumsum(size)))
            spread = np.arange(ends[-1]) - np.repeat(ends[:-1], size) + np.repeat(first[some], size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[some]), pa.array(content[some]), pa.array(doc[some]), pack_binary(hashes[spread], ends)], names=["key", "content", "doc", "tokens"]
            )


def _search(width: int, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A partition holds about ``block`` tokens, as there are as many as the total asks for and no key is larger; indexes are made of whole keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        table = table.take(pa.array(np.argsort(table["key"].to_numpy(), kind="stable")))
        key, content, docs = (table[c].to_numpy() for c in ("key", "content", "doc"))
        tokens, bounds = unpack_binary(table["tokens"], np.int64)
        begin = 0
        for z in np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)):
            if z == len(key) or bounds[z] - bounds[begin] >= block:
                hit = shared_windows(tokens[bounds[begin] : bounds[z]], bounds[begin : z + 1] - bounds[begin], docs[begin:z], width)
                some = np.flatnonzero(hit.any(axis=1))
                bits = np.packbits(hit[some], axis=1, bitorder="little")
                ends = np.arange(len(some) + 1) * bits.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[begin:z][some]), pa.array(content[begin:z][some]), pack_binary(bits.ravel(), ends)], names=["key", "content", "hits"]
                )
                begin = z

    return run


def shared_windows(tokens: np.ndarray, bounds: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """For each stretch (row) and window in it (column): whether the window stands in another document.

    A probe finds by backward search how far left of an end the text is shared. All windows within that reach are shared; all that
    hold both the end and the token beyond the reach are not. Probes start at the last end
    and halve what is left open, so a stretch shared as a whole takes one.
    """
    size = np.diff(bounds)
    codes = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 2
    sigma = int(codes.max()) + 1
    ends = np.cumsum(size + 1) - 1
    text = np.ones(int(ends[-1]) + 1 if len(ends) else 0, np.int64)
    place = np.ones(len(text), bool)
    place[ends] = False
    text[place] = codes
    owner = np.repeat(doc, size + 1)
    windows = size - width + 1
    column = np.arange(windows.max())
    hit = np.zeros((len(size), len(column)), bool)
    if not len(text):
        return hit
    index = FMIndex(text, owner, sigma)
    open_ = column[None, :] < windows[:, None]
    own = np.where(doc == MANY, ANY, doc)
    first = True
    while True:
        rows = np.flatnonzero(open_.any(axis=1))
        if not len(rows):
            return hit
        left = open_[rows]
        if first:
            pick = windows[rows] - 1
            first = False
        else:
            seen = left.cumsum(axis=1)
            pick = (seen > (seen[:, -1:] - 1) // 2).argmax(axis=1)
        base = bounds[rows]
        reach = index.reach(codes, base, base + pick + width - 1, own[rows]) - base
        shared = (column >= reach[:, None]) & (column <= pick[:, None])
        refuted = (column < reach[:, None]) & (column >= pick[:, None])
        hit[rows] |= left & shared
        open_[rows] = left & ~shared & ~refuted


def _runs(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(1)
            s = lists.flatten()
            owner = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(lists.offsets)))
            start = s.field(0).to_numpy().astype(np.int64)
            raw, ends = unpack_binary(s.field(1), np.uint8)
            wide = int(np.diff(ends).max())
            bits = np.zeros((len(start), wide), np.uint8)
            at = np.repeat(np.arange(len(start)), np.diff(ends))
            bits[at, np.arange(len(raw)) - ends[at]] = raw
            which, col = np.nonzero(np.unpackbits(bits, axis=1, bitorder="little"))
            o, w = owner[which], start[which] + col
            order = np.lexsort((w, o))
            o, w = o[order], w[order]
            new = np.ones(len(w), bool)
            new[1:] = (o[1:] != o[:-1]) | (w[1:] > w[:-1] + width)
            last = np.append(np.flatnonzero(new)[1:] - 1, len(w) - 1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(o[new])), pa.array(w[new].astype(np.int32)),
                 pa.array((w[last] + width - 1).astype(np.int32))],
                names=["file_id", "start_unit", "end_unit"],
            )

    return run
