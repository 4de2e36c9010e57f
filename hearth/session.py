"""Session settings and the shared working folder.

Nothing here picks a physical plan: the settings switch on adaptive execution
and Arrow, and leave join and partition choices to the optimizer.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # work on texts is heavy per byte: keep small shuffles on all cores; large ones
    # are still merged up to the advisory partition size
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app: str = "hearth", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library defaults; ``conf`` entries win over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can see, from ``spark.checkpoint.dir``.

    Only a local master may fall back to a machine-local folder; on a cluster a
    missing setting is an error, since executors could not read it back.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = getattr(spark.sparkContext, "_hearth_local_folder", None)
    if folder is None:
        folder = tempfile.mkdtemp(prefix="hearth-")
        spark.sparkContext._hearth_local_folder = folder
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def parallelism(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def shuffle_width(spark: SparkSession) -> int:
    """Partitions of a shuffle whose output is worked on heavily."""
    return max(parallelism(spark), int(spark.conf.get("spark.sql.shuffle.partitions")))


def materialised(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage with a table that outlives lost executors, and costs one
    job where a checkpoint computes its input twice. The owner of the shared
    folder clears it.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan of too few splits over all cores, for work that is heavy per row.

    A table of at least as many splits as cores, which any large one has, is
    returned as it is.
    """
    cores = parallelism(df.sparkSession)
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
