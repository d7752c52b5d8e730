"""Line differences between two versions of texts."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff_lines(pairs: DataFrame, context: int = 3) -> DataFrame:
    """``(path, seq, op, line)`` of ``pairs(path, old, new)``: ``equal``, ``delete`` and ``insert`` in order.

    Of equal runs only ``context`` lines next to a change are kept, a row ``gap`` stands for the rest; a null text counts as empty. One row of
    ``pairs`` is compared where it lies; nothing is shuffled.
    """
    return pairs.select("path", "old", "new").mapInArrow(_rows(context), "path string, seq int, op string, line string")


def operations(old: str, new: str, context: int = 3) -> list[tuple[str, str]]:
    a, b = old.splitlines(), new.splitlines()
    out: list[tuple[str, str]] = []
    for tag, i, j, k, n in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if tag == "equal":
            first, last = i == 0 and k == 0, j == len(a) and n == len(b)
            head, tail = (0 if first else context), (0 if last else context)
            if j - i > head + tail:
                out += [("equal", x) for x in a[i : i + head]]
                out.append(("gap", str(j - i - head - tail)))
                out += [("equal", x) for x in a[j - tail : j]] if tail else []
            else:
                out += [("equal", x) for x in a[i:j]]
        else:
            out += [("delete", x) for x in a[i:j]] + [("insert", x) for x in b[k:n]]
    return out


def _rows(context: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(p, i, op, x) for p, old, new in zip(*(c.to_pylist() for c in b.columns), strict=True) for i, (op, x) in enumerate(operations(old or "", new or "", context))]
            columns = list(zip(*found, strict=True)) or [()] * 4
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["path", "seq", "op", "line"])

    return run


def unified(pairs: DataFrame, context: int = 3) -> DataFrame:
    """``(path, diff)``: the changes of each pair as text, a sign before each line; a pair without changes gives none."""
    sign = F.create_map(F.lit("equal"), F.lit(" "), F.lit("delete"), F.lit("-"), F.lit("insert"), F.lit("+"))
    rows = diff_lines(pairs, context)
    text = F.when(F.col("op") == "gap", F.concat(F.lit("@@ "), F.col("line"), F.lit(" lines @@"))).otherwise(F.concat(F.element_at(sign, F.col("op")), F.col("line")))
    whole = rows.groupBy("path").agg(F.bool_or(F.col("op").isin("insert", "delete")).alias("changed"), F.array_sort(F.collect_list(F.struct("seq", text.alias("t")))).alias("l"))
    return whole.where("changed").select("path", F.concat(F.lit("--- "), "path", F.lit("\n+++ "), "path", F.lit("\n"), F.array_join(F.transform("l", lambda x: x["t"]), "\n")).alias("diff"))
