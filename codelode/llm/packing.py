"""Filling containers of fixed capacity by minimum bin slack."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
#: Containers a shard is meant to fill. A shard leaves about one container open, so some 0.02 % stays unused by sharding.
SHARD_CONTAINERS = 4096


def pack(sizes: DataFrame, capacity: int = CAPACITY, shard_containers: int = SHARD_CONTAINERS) -> DataFrame:
    """``(container, doc_id, piece, first_token, tokens)``: where each text goes, without cutting one that fits.

    ``sizes`` is ``(doc_id, tokens)``, one row per text; it is read twice, so pass a written table. A
    text above ``capacity`` is cut: whole pieces of ``capacity`` fill a container each, and the rest is an item. Texts
    without tokens (or with a null size) need no room and give no row. Items are dealt to
    shards by a hash of the id, so a shard holds a bounded number of tokens however skewed the lengths are; each shard is packed in one task.
    """
    items = sizes.where("doc_id is not null and tokens > 0").select("doc_id", "tokens")
    total = items.agg(F.sum(F.col("tokens") % capacity)).first()[0] or 0
    shards = max(1, -(-int(total) // (capacity * shard_containers)))
    whole = items.where(F.col("tokens") >= capacity).select(
        "doc_id", F.explode(F.sequence(F.lit(0), (F.floor(F.col("tokens") / capacity) - 1).cast("int"))).alias("piece")
    )
    whole = whole.select(
        F.concat_ws("-", F.lit("whole"), "doc_id", "piece").alias("container"), "doc_id", "piece",
        (F.col("piece").cast("long") * capacity).alias("first_token"), F.lit(capacity).alias("tokens"),
    )
    rest = items.where(F.col("tokens") % capacity > 0).select(
        F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), "doc_id",
        F.floor(F.col("tokens") / capacity).cast("int").alias("piece"), (F.col("tokens") % capacity).cast("int").alias("tokens"),
    )
    packed = (
        rest.groupBy("shard")
        .applyInArrow(_pack_shard(capacity), "container string, doc_id long, piece int, tokens int")
        .select("container", "doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("first_token"), "tokens")
    )
    return whole.unionByName(packed)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens in them, the least number of containers that could hold them, and the unused share."""
    one = packed.groupBy("container").agg(F.sum("tokens").alias("tokens")).agg(
        F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")
    )
    return one.select(
        "containers", "tokens", F.ceil(F.col("tokens") / capacity).alias("least_containers"),
        F.when(F.col("containers") > 0, F.round(1 - F.col("tokens") / (F.col("containers") * capacity), 6)).alias("unused_share"),
    )


def fill(counts: dict[int, int], capacity: int) -> Iterator[dict[int, int]]:
    """Containers as counts by length, until ``counts`` (by length, all within ``capacity``) is used up.

    Each starts with the largest length left. Which sums the next lengths can reach is a
    bitset in one integer, to which a length adds itself by a shift, its count by doubling
    steps. When the room left can be filled exactly, or all lengths have been looked at, the largest sum is backtracked to counts.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    lengths = sorted(left, reverse=True)
    while left:
        while lengths and lengths[0] not in left:
            lengths.pop(0)
        if len(lengths) > 2 * len(left) + 16:
            lengths = sorted(left, reverse=True)
        seed = lengths[0]
        room = capacity - seed
        taken = {seed: 1}
        steps: list[tuple[int, int, int]] = []
        reach, mask, goal = 1, (1 << (room + 1)) - 1, 1 << room
        for n in lengths:
            if n > room or n not in left:
                continue
            have = min(left[n] - (n == seed), room // n)
            part = 1
            while have > 0 and not reach & goal:
                now = min(part, have)
                steps.append((n, now, reach))
                reach |= reach << (n * now) & mask
                have -= now
                part *= 2
            if reach & goal:
                break
        at = reach.bit_length() - 1
        for n, now, before in reversed(steps):
            if not before >> at & 1:
                taken[n] = taken.get(n, 0) + now
                at -= n * now
        for n, k in taken.items():
            if left[n] == k:
                del left[n]
            else:
                left[n] -= k
        yield taken


def _pack_shard(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending")])
        shard = table["shard"][0].as_py()
        docs, pieces, sizes = (table[c].to_pylist() for c in ("doc_id", "piece", "tokens"))
        waiting: dict[int, list[int]] = {}
        for row, n in enumerate(sizes):
            waiting.setdefault(n, []).append(row)
        order, names = [], []
        for number, taken in enumerate(fill({n: len(x) for n, x in waiting.items()}, capacity)):
            for n, k in taken.items():
                for _ in range(k):
                    order.append(waiting[n].pop())
                    names.append(f"{shard}-{number}")
        return pa.table(
            {
                "container": pa.array(names, pa.string()), "doc_id": pa.array([docs[i] for i in order], pa.int64()),
                "piece": pa.array([pieces[i] for i in order], pa.int32()), "tokens": pa.array([sizes[i] for i in order], pa.int32()),
            }
        )

    return run
