"""Reading the tables, and cutting lineage where a plan is iterative."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CUTS: dict[str, SparkSession] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the project's tables; Catalyst prunes the columns the caller does not use."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over the cores where a small scan gives fewer partitions than there are; a larger one is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``, and without it this raises there, as a folder of one machine would
    lose rows. Only a local session (tests on one machine) gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    have = sc.getCheckpointDir()
    if have is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="codelode-"))
        have = sc.getCheckpointDir()
    return have.rstrip("/")


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, any executor may be lost later.

    The table is deleted by :func:`drop_cut` where a query knows that no later plan reads it, and by :func:`drop_cuts` at the end of the session.
    """
    path = f"{scratch_dir(df.sparkSession)}/codelode-{label}-{uuid.uuid4().hex}"
    _CUTS[path] = df.sparkSession
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_cut(df: DataFrame) -> None:
    """Delete a table written by :func:`cut` that no later plan reads."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/codelode-" in folder:
            _delete(df.sparkSession, folder)
            for known in [k for k in _CUTS if folder.endswith(k.rsplit("/", 1)[1])]:
                del _CUTS[known]


@atexit.register
def drop_cuts() -> None:
    """Delete all tables that :func:`cut` has written and that are left; results not yet computed that read them are lost."""
    for path, spark in [*_CUTS.items()]:
        del _CUTS[path]
        with contextlib.suppress(Exception):  # the session may be gone, and its folder with it
            _delete(spark, path)
