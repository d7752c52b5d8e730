"""Token rows packed into one array per file, and rolling hashes over such arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
_M1, _M2 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9)


def pack_binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary array whose element ``i`` holds ``values[bounds[i]:bounds[i + 1]]``."""
    raw = np.ascontiguousarray(values)
    if raw.nbytes > np.iinfo(np.int32).max:
        raise OverflowError("a batch of more than 2 GB; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    offsets = (np.asarray(bounds, np.int64) * raw.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def unpack_binary(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary array end to end, and the bounds of each element."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.dtype(dtype).itemsize
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return raw.view(dtype) if raw.size else np.empty(0, dtype), ((offsets - offsets[0]) // size).astype(np.int64)


def file_streams(tokens: DataFrame) -> DataFrame:
    """``(file_id, hashes)``: 64-bit hashes of a file's token texts in order of ``unit``, little endian, in one value.

    Rows with a null ``file_id``, ``unit`` or ``text`` are left out; a unit delivered
    twice counts once (should its texts differ, one of them); a file without tokens gives
    no row. Runs of rows of one file are packed before the shuffle, which so moves a few
    arrays per file in place of a row per token.
    """
    rows = tokens.where("file_id is not null and unit is not null and text is not null").select(
        "file_id", "unit", F.xxhash64("text").alias("h")
    )
    runs = rows.mapInArrow(_pack_runs, "file_id long, units binary, hashes binary")
    whole = runs.groupBy("file_id").agg(F.collect_list(F.struct("units", "hashes")).alias("runs"))
    return whole.mapInArrow(_join_runs, "file_id long, hashes binary")


def _pack_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        f = b.column(0).to_numpy()
        cuts = np.flatnonzero(np.concatenate(([True], f[1:] != f[:-1])))
        bounds = np.append(cuts, len(f))
        yield pa.RecordBatch.from_arrays(
            [pa.array(f[cuts]), pack_binary(b.column(1).to_numpy(), bounds), pack_binary(b.column(2).to_numpy(), bounds)],
            names=["file_id", "units", "hashes"],
        )


def _join_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        runs = b.column(1)
        parts = runs.flatten()
        at = np.asarray(runs.offsets) - runs.offsets[0].as_py()
        units, ub = unpack_binary(parts.field(0), np.int32)
        hashes, _ = unpack_binary(parts.field(1), np.int64)
        ends = ub[at]
        owner = np.repeat(np.arange(len(at) - 1), np.diff(ends))
        order = np.lexsort((hashes, units, owner))
        owner, units, hashes = owner[order], units[order], hashes[order]
        new = np.ones(len(units), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (units[1:] != units[:-1])
        bounds = np.concatenate(([0], np.cumsum(np.bincount(owner[new], minlength=len(at) - 1))))
        yield pa.RecordBatch.from_arrays([b.column(0), pack_binary(hashes[new], bounds)], names=["file_id", "hashes"])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> U64(30))) * _M2
    return x ^ (x >> U64(27))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` values, by doubling; ``len(h) - k + 1`` of them."""
    cur, size = mix(h.astype(U64, copy=False) * _M1), 1
    while size < k:
        step = min(size, k - size)
        cur = mix((cur[:-step] * _M1) ^ (cur[step:] + _M2)) if len(cur) > step else cur[:0]
        size += step
    return cur


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values, by doubling."""
    size = 1
    while size < w:
        step = min(size, w - size)
        x = np.minimum(x[:-step], x[step:]) if len(x) > step else x[:0]
        size += step
    return x
