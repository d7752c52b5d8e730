"""Bursts of file events: a quiet period ends a burst, in batch or as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.session import scratch_dir

GAP = "2 hours"
#: The user of the marks that end a stream.
NOBODY = -(1 << 63)


def bursts(events: DataFrame, gap: str = GAP) -> DataFrame:
    """``(user_id, start, end, events)``: events of one user closer than ``gap`` to each other; ``end`` is when the quiet period is over."""
    window = F.session_window("ts", gap)
    grouped = events.where("user_id is not null and ts is not null").groupBy("user_id", window.alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return grouped.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def bursts_of_stream(events: DataFrame, gap: str = GAP, lateness: str = "1 day") -> DataFrame:
    """:func:`bursts` of a stream; an event later than ``lateness`` behind the newest one is dropped, and a burst is given once no event can join it."""
    return bursts(events.withWatermark("ts", lateness), gap)


def bursts_streamed(spark: SparkSession, path: str, gap: str = GAP, lateness: str = "1 day") -> DataFrame:
    """Runs the stream over the files at ``path`` until all are read, and returns the bursts.

    State and output lie in the shared folder. A burst is written once, when the watermark has passed its end, and leaves the state then. So that the
    last ones are given too, the stream is resumed with marks of a later time, of a user there is not; their own burst stays open.
    """
    schema = spark.read.parquet(path).schema
    folder, name = (path, "*.parquet") if _is_folder(spark, path) else path.rsplit("/", 1)
    root = f"{scratch_dir(spark)}/codelode-stream-{uuid.uuid4().hex}"
    out, marks = f"{root}/out", f"{root}/marks"
    spark.createDataFrame([], schema).write.parquet(marks)
    events = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    both = events.unionByName(spark.readStream.schema(schema).parquet(marks)).withColumn("ts", F.col("ts").cast("timestamp"))

    def keep(batch: DataFrame, number: int) -> None:
        # A batch that is run again replaces what it wrote.
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    def run() -> None:
        writer = bursts_of_stream(both, gap, lateness).writeStream.outputMode("append").option("checkpointLocation", f"{root}/state")
        writer.trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()

    run()
    ends = spark.read.parquet(path).agg(F.max("ts").alias("ts")).where("ts is not null")
    for k in (1, 2):  # the first moves the watermark, the second is the batch that sees it
        late = ends.select((F.col("ts") + F.expr(f"interval {lateness}") + F.expr(f"interval {gap}") * 2 + F.expr(f"interval {k} second")).alias("ts"))
        value = {"ts": F.col("ts"), "user_id": F.lit(NOBODY)}
        late.select(*(value.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema)).write.mode("append").parquet(marks)
        run()
    found = spark.read.schema("user_id long, start timestamp, end timestamp, events long").option("recursiveFileLookup", True).parquet(out)
    return found.withColumns({c: F.col(c).cast(schema["ts"].dataType) for c in ("start", "end")})


def changed_sources(events: DataFrame) -> DataFrame:
    """Modify events on sources, the only ones that trigger work."""
    return events.where((F.col("kind") == "modify") & F.col("path").rlike(r"\.(ts|tsx|js|jsx)$"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
