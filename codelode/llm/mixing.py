"""Mixing sources to target shares by Efraimidis-Spirakis sampling without replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEED = 20_31
BUCKETS = 1024


def mix(sizes: DataFrame, targets: DataFrame, total: int | None = None, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """``(doc_id, source, tokens, repeats)`` of the texts to use, ``repeats`` times each.

    ``sizes`` is ``(doc_id, source, tokens, weight)``, read more than once; ``targets`` is ``(source,
    target_share, max_repeats)``. ``total`` tokens are mixed, by default the most for which every source can give its share.
    A source gives its budget in complete epochs first. What is left is taken in the order of exponential
    keys ``-ln(u) / weight`` (``u`` from a hash of the id and the seed) up to the budget.
    The running sum within a source is that of its key buckets before, plus that inside the bucket, so no task
    holds a source. Sources without a target, a share above 0 or a text give nothing, as do texts without tokens; a null ``max_repeats`` counts as 1.
    Shares are taken relative to the sum of those that can be served.
    """
    plan = budgets(sizes, targets, total)
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    keyed = (
        sizes.where("tokens > 0 and source is not null")
        .join(F.broadcast(plan.select("source", "epochs", "rest")), "source")
        .withColumn("key", -F.log(u) / F.greatest(F.col("weight"), F.lit(1e-3)))
        .withColumn("bucket", F.floor((1 - F.exp(-F.col("key"))) * buckets).cast("int"))
    )
    sums = keyed.groupBy("source", "bucket").agg(F.sum("tokens").alias("in_bucket"))
    before = sums.select(
        "source", "bucket",
        F.coalesce(F.sum("in_bucket").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    order = Window.partitionBy("source", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = keyed.join(before, ["source", "bucket"]).withColumn("upto", F.col("before") + F.sum("tokens").over(order))
    # The text that crosses the budget is taken if more than half of it lies inside.
    extra = ((F.col("rest") > 0) & (F.col("upto") - F.col("tokens") / 2 <= F.col("rest"))).cast("int")
    return (
        placed.withColumn("repeats", (F.col("epochs") + extra).cast("int")).where("repeats > 0").select("doc_id", "source", "tokens", "repeats")
    )


def budgets(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """One row per source that can give: ``source, target_share, max_repeats, size, budget, epochs, rest``."""
    have = sizes.where("tokens > 0 and source is not null").groupBy("source").agg(F.sum("tokens").alias("size"))
    rows = (
        targets.where("source is not null and target_share > 0")
        .groupBy("source")
        .agg(F.max("target_share").alias("target_share"), F.greatest(F.coalesce(F.max("max_repeats"), F.lit(1)), F.lit(1)).alias("max_repeats"))
        .join(have, "source")
    )
    every = Window.partitionBy(F.lit(1))  # a row per source
    rows = rows.withColumn("share", F.col("target_share") / F.sum("target_share").over(every))
    most = F.min(F.col("max_repeats") * F.col("size") / F.col("share")).over(every)
    rows = rows.withColumn("budget", F.least(F.lit(float(total)) * F.col("share") if total else most * F.col("share"), F.col("max_repeats") * F.col("size")))
    epochs = F.floor(F.col("budget") / F.col("size") + 1e-9)
    return rows.select(
        "source", "target_share", "max_repeats", "size", "budget", epochs.alias("epochs"),
        F.greatest(F.col("budget") - epochs * F.col("size"), F.lit(0.0)).alias("rest"),
    )


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, target_share, texts, tokens, share, most_repeats)``: what each target source gives in the mixture."""
    got = mixed.groupBy("source").agg(
        F.count(F.lit(1)).alias("texts"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats")
    )
    every = Window.partitionBy(F.lit(1))
    return (
        targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"))
        .join(got, "source", "left")
        .select(
            "source", "target_share", F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
            F.round(F.coalesce("tokens", F.lit(0)) / F.sum("tokens").over(every), 6).alias("share"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        )
    )
