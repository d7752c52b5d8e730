"""Top N items of every group by two-stage salted ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def top_n_per_group(
    items: DataFrame, group: str, item: str, score: str, n: int, salts: int = SALTS, pos: str = "pos"
) -> DataFrame:
    """The ``n`` items of highest ``score`` of each group, ties by ascending ``item``.

    Returns ``(group, pos, item)``, ``pos`` from 1. Every group is hashed by item into
    ``salts`` subgroups; each keeps its own first ``n``, and only those survivors meet
    in one task, at most ``salts * n`` rows a group however large the group is. Copies of
    an item fall into one subgroup, so deduplication needs no shuffle of its own.

    Null groups, items and scores do not rank. If copies of an item disagree on the
    score, the highest counts. Groups with fewer than ``n`` items give all they have; an
    empty input gives no rows. Further columns, whatever their names, are dropped first.
    """
    rows = items.select(
        F.col(group).alias("_g"), F.col(item).alias("_i"), F.col(score).alias("_s")
    ).where("_g is not null and _i is not null and _s is not null")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_i"), F.lit(salts))).repartition("_g", "_salt")
    # One exchange: this partitioning serves the deduplication and the first ranking alike.
    single = salted.groupBy("_g", "_salt", "_i").agg(F.max("_s").alias("_s"))
    order = (F.col("_s").desc(), F.col("_i").asc())
    first = single.withColumn("_r", F.row_number().over(Window.partitionBy("_g", "_salt").orderBy(*order))).where(
        F.col("_r") <= n
    )
    ranked = first.withColumn("_p", F.row_number().over(Window.partitionBy("_g").orderBy(*order)))
    return ranked.where(F.col("_p") <= n).select(
        F.col("_g").alias(group), F.col("_p").cast("int").alias(pos), F.col("_i").alias(item)
    )
