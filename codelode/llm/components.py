"""Connected components by alternating large-star and small-star rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.session import cut, drop_cut

#: The dashes that stand for a hyphen, and entries that name no advisory.
DASHES = "‐‑‒–—―⁃−﹘﹣－"
NO_ADVISORY = ("N/A", "NA", "NONE", "NULL", "NIL", "UNKNOWN", "PENDING", "TBD", "TBA", "TODO", "-", "SEE URL")
#: An identifier of any series whose parts are all zeros is a stand-in as well.
ZERO_ID = r"^[^-]+(-0+)+$"


def advisory_id(raw: Column) -> Column:
    """One spelling of an identifier: upper case, plain hyphens, no surrounding white space; null for none."""
    plain = F.translate(raw, DASHES, "-" * len(DASHES))
    plain = F.upper(F.regexp_replace(plain, r"^[\s\p{Z}​﻿]+|[\s\p{Z}​﻿]+$", ""))
    named = plain.rlike(r"^[^\s-]+(-[^\s-]+)+$") & (plain.rlike("[0-9]") | plain.rlike("-[^-]+-"))
    return F.when(named & ~plain.isin(*NO_ADVISORY) & ~plain.rlike(ZERO_ID), plain)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """``(node, component)``: every node that stands in an edge with the least node it is linked to.

    ``edges`` has two columns of one orderable type; rows with a null on either side and
    self-links connect nothing (a node that has only those gets no row), repeated rows
    count once, other columns are ignored, no edges give no rows. Strings order by bytes.

    Each round does a large-star (every larger neighbour of u is linked to the least node
    around u) and a small-star (every smaller-or-equal neighbour is). Both are a grouped
    minimum, which combines on the map side, joined back to the edges on u, so no
    neighbour list is ever collected; a hub's edges are split by the skew join of AQE.
    Edges are deduplicated and written to the shared folder after each round; the loop
    ends when a round leaves the edge set as it was (count and hash sum). Raises after
    ``max_rounds`` rather than returning components that are not final.
    """
    now = cut(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "cc",
    )
    seen = None
    for _ in range(max_rounds):
        nxt = cut(_small_star(_large_star(now)).distinct(), "cc")
        mark = nxt.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        drop_cut(now)
        now = nxt
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components not final after {max_rounds} rounds")
    roots = now.select(F.col("v").alias("u"), "v")
    return now.union(roots).distinct().select(F.col("u").alias("node"), F.col("v").alias("component"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return linked.union(least.select("u", F.col("m").alias("v")))


def advisory_groups(advisories: DataFrame) -> DataFrame:
    """``(osv_id, group_id)`` for every ``osv_id`` of the table whose group has two identifiers or more.

    Both are in the one spelling of :func:`advisory_id`. Aliases that are null, empty or
    stand for no advisory connect nothing; an ``osv_id`` without links gives no row.
    """
    rows = advisories.select(
        advisory_id(F.col("osv_id")).alias("osv_id"),
        F.transform(F.coalesce("aliases", F.array().cast("array<string>")), advisory_id).alias("aliases"),
    ).where("osv_id is not null")
    edges = rows.select(F.col("osv_id").alias("a"), F.explode("aliases").alias("b"))
    found = connected_components(edges)
    own = rows.select("osv_id").distinct()
    return own.join(found, F.col("osv_id") == F.col("node")).select("osv_id", F.col("component").alias("group_id"))
