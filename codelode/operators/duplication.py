"""Duplication in token streams: shingles, winnowing, line blocks and densities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions import text as T
from codelode.operators.sourcefiles import duplication_eligible

SHINGLE, WINDOW = 5, 10
BLOCK_LINES, MIN_TOKENS = 10, 100


def clean_tokens(tokens: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """``(file_id, unit, line, text)`` once each; of eligible files only, if ``files`` is given."""
    once = tokens.where("file_id is not null and unit is not null and text is not null").select("file_id", "unit", "line", "text")
    if files is not None:
        once = once.join(files.where(duplication_eligible(F.col("path"))).select("file_id").distinct(), "file_id", "left_semi")
    # One exchange by file serves the copies here and all that follows by file: shingles, windows, lines.
    return once.repartition("file_id").groupBy("file_id", "unit").agg(F.min("line").alias("line"), F.min("text").alias("text"))


def shingles(tokens: DataFrame, k: int = SHINGLE) -> DataFrame:
    """``(file_id, pos, hash)``: hashes of all runs of ``k`` tokens of a file, by position from 0."""
    w = Window.partitionBy("file_id").orderBy("unit")
    parts = [F.col("text"), *[F.lead("text", i).over(w) for i in range(1, k)]]
    rows = tokens.select("file_id", (F.row_number().over(w) - 1).alias("pos"), F.array(*parts).alias("run"))
    return rows.where(F.get("run", F.lit(k - 1)).isNotNull()).select("file_id", "pos", F.md5(F.concat_ws("\x01", "run")).alias("hash"))


def winnow(hashes: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(file_id, pos, hash)``: the fingerprints of each file.

    The least hash of every ``window`` consecutive ones, the rightmost of equals; then one more, the least after the last of these (the leftmost
    of equals). A file of up to ``window`` hashes gives its leftmost least one.
    """
    w, whole = Window.partitionBy("file_id").orderBy("pos"), Window.partitionBy("file_id")
    least = F.min(F.struct("hash", (-F.col("pos")).alias("neg"))).over(w.rowsBetween(0, window - 1))
    rows = hashes.select("file_id", "pos", "hash", least.alias("m"), F.count(F.lit(1)).over(whole).alias("n"))
    # The place of the least hash never moves back, so a window gives a new one where it differs from that of the window before.
    at = F.when(F.col("pos") + window <= F.col("n"), -F.col("m.neg"))
    rows = rows.select("file_id", "pos", "hash", "n", at.alias("at"), F.col("m.hash").alias("picked"))
    rows = rows.select("*", F.lag("at").over(w).alias("before"), F.max("at").over(whole).alias("last"))
    rest = F.when((F.col("n") <= window) | (F.col("pos") > F.col("last")), F.struct("hash", "pos"))
    rows = rows.select("*", F.min(rest).over(whole).alias("tail"))
    fresh = F.when(F.col("at").isNotNull() & ~F.col("at").eqNullSafe(F.col("before")), F.struct(F.col("at").alias("pos"), F.col("picked").alias("hash")))
    ending = F.when((F.col("pos") == 0) & F.col("tail").isNotNull(), F.struct(F.col("tail.pos").alias("pos"), F.col("tail.hash").alias("hash")))
    return rows.where(fresh.isNotNull() | ending.isNotNull()).select("file_id", F.explode(F.array_compact(F.array(fresh, ending))).alias("f")).select("file_id", "f.pos", "f.hash")


def duplication_totals(tokens: DataFrame, k: int = SHINGLE, window: int = WINDOW, min_tokens: int = 100) -> DataFrame:
    """One row: tokens, duplicated tokens (``k`` for every file beyond the first that has a fingerprint) and their percentage.

    Below ``min_tokens`` in all nothing counts as duplicated.
    """
    prints = winnow(shingles(tokens, k), window).select("hash", "file_id").distinct()
    extra = prints.groupBy("hash").agg((F.count(F.lit(1)) - 1).alias("more")).agg((F.coalesce(F.sum("more"), F.lit(0)) * k).alias("duplicated"))
    one = tokens.agg(F.count(F.lit(1)).alias("tokens")).crossJoin(extra)  # one row each
    dup = F.when(F.col("tokens") < min_tokens, 0).otherwise(F.col("duplicated"))
    return one.select("tokens", dup.alias("duplicated"), F.round(T.percent(dup, F.col("tokens")), 4).alias("percent"))


def shared_fingerprints(tokens: DataFrame) -> DataFrame:
    """``(file_id, fingerprints, shared)``: how many fingerprints a file has, and how many of them stand in another file too."""
    prints = winnow(shingles(tokens)).select("hash", "file_id").distinct()
    common = prints.groupBy("hash").agg(F.count(F.lit(1)).alias("files")).where("files > 1").select("hash", F.lit(1).alias("common"))
    joined = prints.join(common, "hash", "left")
    return joined.groupBy("file_id").agg(F.count(F.lit(1)).alias("fingerprints"), F.count("common").alias("shared"))


def token_lines(tokens: DataFrame, normalize_identifiers: bool = False) -> DataFrame:
    """``(file_id, line, value, start_unit, end_unit)``: the tokens of each line as one value, words as one placeholder if they are to be alike."""
    if normalize_identifiers:
        tokens = tokens.withColumn("text", F.when(F.col("text").rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.lit("$id")).otherwise(F.col("text")))
    rows = tokens.groupBy("file_id", "line").agg(
        F.array_sort(F.collect_list(F.struct("unit", "text"))).alias("t"), F.min("unit").alias("start_unit"), F.max("unit").alias("end_unit")
    )
    return rows.select("file_id", "line", F.concat_ws("", F.transform("t", lambda x: x["text"])).alias("value"), "start_unit", "end_unit")


def collapse_runs(lines: DataFrame, keep_pairs: bool = True) -> DataFrame:
    """Of consecutive equal lines of a file only the first and the last are kept; without ``keep_pairs`` of two equal lines only the first."""
    if not keep_pairs:
        w = Window.partitionBy("file_id").orderBy("line")
        twice = F.coalesce(F.lag("value").over(w) == F.col("value"), F.lit(False)) & F.coalesce(F.lag("value", 2).over(w) != F.col("value"), F.lit(True))
        lone = twice & F.coalesce(F.lead("value").over(w) != F.col("value"), F.lit(True))
        lines = lines.withColumn("lone", lone).where("not lone").drop("lone")
    w = Window.partitionBy("file_id").orderBy("line")
    before, after = F.lag("value").over(w), F.lead("value").over(w)
    rows = lines.withColumn("keep", before.isNull() | after.isNull() | (before != F.col("value")) | (after != F.col("value")))
    return rows.where("keep").drop("keep")


def line_blocks(lines: DataFrame, size: int = BLOCK_LINES) -> DataFrame:
    """``(file_id, idx, hash, start_line, end_line, start_unit, end_unit)``: hashes of every ``size`` consecutive (collapsed) lines."""
    w = Window.partitionBy("file_id").orderBy("line")
    last = F.lead("line", size - 1).over(w)
    values = F.array("value", *[F.lead("value", i).over(w) for i in range(1, size)])
    rows = lines.select(
        "file_id", (F.row_number().over(w) - 1).alias("idx"), F.md5(F.concat_ws("\n", values)).alias("hash"), F.col("line").alias("start_line"),
        last.alias("end_line"), "start_unit", F.lead("end_unit", size - 1).over(w).alias("end_unit"),
    )
    return rows.where("end_line is not null")


def duplicated_runs(tokens: DataFrame, size: int = BLOCK_LINES, min_tokens: int = MIN_TOKENS, normalize_identifiers: bool = False) -> DataFrame:
    """``(file_id, start_line, end_line, tokens)``: unbroken runs of blocks that stand elsewhere too, of ``min_tokens`` at least.

    A block is repeated if its hash occurs twice, in whatever files. Runs are islands of
    consecutive repeated blocks in a file, so no pair of occurrences is ever built, however often a block is repeated.
    """
    blocks = line_blocks(collapse_runs(token_lines(tokens, normalize_identifiers)), size)
    common = blocks.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    hit = blocks.join(common, "hash", "left_semi")
    island = F.col("idx") - F.row_number().over(Window.partitionBy("file_id").orderBy("idx"))
    runs = hit.withColumn("island", island).groupBy("file_id", "island").agg(
        F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), (F.max("end_unit") - F.min("start_unit") + 1).alias("tokens")
    )
    return runs.where(F.col("tokens") >= min_tokens).select("file_id", "start_line", "end_line", "tokens")


def duplication_density(tokens: DataFrame, normalize_identifiers: bool = False) -> DataFrame:
    """``(file_id, lines, duplicated_lines, density)``: the lines of each file that lie in duplicated runs."""
    lines = tokens.groupBy("file_id").agg(F.max("line").alias("lines"))
    covered = duplicated_runs(tokens, normalize_identifiers=normalize_identifiers).select("file_id", F.explode(F.sequence("start_line", "end_line")).alias("line")).distinct()
    counted = covered.groupBy("file_id").agg(F.count(F.lit(1)).alias("duplicated_lines"))
    rows = lines.join(counted, "file_id", "left").select("file_id", "lines", F.coalesce("duplicated_lines", F.lit(0)).alias("duplicated_lines"))
    return rows.withColumn("density", F.round(T.percent(F.col("duplicated_lines"), F.col("lines")), 4))


def duplication_report(tokens: DataFrame, mode: str, min_tokens: int = MIN_TOKENS, normalize_identifiers: bool = False) -> DataFrame:
    """One row ``(mode, total, duplicated, percent)``: tokens in the modes ``token``, ``tokens`` and ``shingle``, else the lines of duplicated runs."""
    if mode.lower() in ("token", "tokens", "shingle"):
        one = duplication_totals(tokens, min_tokens=min_tokens)
        return one.select(F.lit("token").alias("mode"), F.col("tokens").alias("total"), "duplicated", "percent")
    density = duplication_density(tokens, normalize_identifiers)
    one = density.agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("total"), F.coalesce(F.sum("duplicated_lines"), F.lit(0)).alias("duplicated"))
    return one.select(F.lit("sonar").alias("mode"), "total", "duplicated", F.round(T.percent(F.col("duplicated"), F.col("total")), 4).alias("percent"))


def reported_blocks(blocks: DataFrame) -> DataFrame:
    """``(block_id, token_count, occurrences, files)`` of blocks as an earlier run reported them, each once; occurrences with paths in one spelling."""
    rows = blocks.where("block_id is not null").select("block_id", "token_count", F.explode_outer("occurrences").alias("o"))
    rows = rows.select("block_id", "token_count", T.normalize_path(F.col("o.file")).alias("file"), "o.start_line", "o.end_line").distinct()
    return rows.groupBy("block_id").agg(F.max("token_count").alias("token_count"), F.count("file").alias("occurrences"), F.countDistinct("file").alias("files"))
